"""Rule registry and plug-in point.

A rule is a function ``f(tables, keys, **params)`` that returns one verdict row per key *that
has data for it*: ``keys + status, message, remediation, evidence``. Clusters it says nothing
about are filled in by the runner: ``missing`` applies when the rule's table has no row for the
cluster, ``empty`` when it has rows but none of them concern the rule.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens import schema as S

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    table: str
    missing: tuple[str, str]
    empty: tuple[str, str]
    fn: Callable[..., DataFrame]
    group: str | None = None
    tier: str = "core"
    listed: bool = True


REGISTRY: dict[str, Rule] = {}


def rule(
    id: str,
    name: str,
    table: str,
    missing: tuple[str, str] = (S.DATA_MISSING, "The telemetry this check needs is absent."),
    empty: tuple[str, str] = (S.PASS, "Nothing to check in this snapshot."),
    group: str | None = None,
    tier: str = "plugin",
    listed: bool = True,
):
    """Register a rule; the decorated function stays callable on its own.

    Rules of one ``group`` are built by one function, called once with all wanted ids, so that
    they share a scan; such a function takes ``ids`` and returns an ``id`` column as well.
    """

    def register(fn):
        REGISTRY[id] = Rule(id, name, table, missing, empty, fn, group, tier, listed)
        return fn

    return register


def evidence(**values: Column | str) -> Column:
    """Numbers behind a verdict, as map<string,double>."""
    entries: list[Column] = []
    for name, value in values.items():
        col = F.col(value) if isinstance(value, str) else value
        entries += [F.lit(name), col.cast("double")]
    return F.create_map(*entries)


def verdict(
    status: Column,
    message: Column,
    remediation: str,
    ev: Column,
    rule_id: str | None = None,
) -> Column:
    """Verdict as a struct; advice is attached to anything but a PASS."""
    fields = [] if rule_id is None else [F.lit(rule_id).alias("id")]
    return F.struct(
        *fields,
        status.alias("status"),
        message.alias("message"),
        F.when(status != S.PASS, F.lit(remediation)).alias("remediation"),
        ev.alias("evidence"),
    )


def unpack(df: DataFrame, keys: Sequence[str], *verdicts: tuple[Column, Column]) -> DataFrame:
    """Rows of several verdicts per key, from (relevant, verdict) pairs over one wide row."""
    picked = F.filter(
        F.array(*[F.when(relevant, v) for relevant, v in verdicts]), lambda x: x.isNotNull()
    )
    return df.select(*keys, F.inline(picked))
