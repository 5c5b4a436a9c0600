"""Runs rules over telemetry tables and completes their verdicts for silent clusters."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens import schema as S
from clusterlens.operators.aggregates import CHUNK_CHARS, text_chunks
from clusterlens.operators.picks import union_results
from clusterlens.rules.core import ENTITY_RULE_TABLES, RULE_ORDER, entities
from clusterlens.rules.registry import REGISTRY, Rule, Tables
from clusterlens.sources.store import staged

log = logging.getLogger(__name__)

#: Tables whose rows make a cluster known; metadata and features say nothing about rules.
COVERED = [
    "node_stats",
    "namespace_stats",
    "set_stats",
    "security_stats",
    "node_configs",
    "static_configs",
    "system_info",
    "cluster_metadata",
]


def coverage(tables: Tables, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Rows and nodes per table and key. Reads only key columns; the ingest stores the result."""

    def counted(name: str) -> DataFrame:
        df = tables[name]
        if "node_id" not in df.columns:
            out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            return out.withColumn("n_nodes", F.lit(None).cast("bigint"))
        # Rows of a node are counted before nodes are, so no task holds the nodes of a big cluster.
        per_node = df.groupBy(*keys, "node_id").agg(F.count(F.lit(1)).alias("n"))
        return per_node.groupBy(*keys).agg(
            F.sum("n").alias("n_rows"), F.count("node_id").alias("n_nodes")
        )

    parts = [
        counted(name).select(*keys, F.lit(name).alias("table_name"), "n_rows", "n_nodes")
        for name in COVERED
        if name in tables
    ]
    return union_results(*parts)


def presence(
    tables: Tables, keys: Sequence[str] = S.KEYS, names: Sequence[str] = tuple(COVERED)
) -> DataFrame:
    """Rows per table and key, for tables that come without a stored coverage."""
    return union_results(
        *[
            tables[name]
            .groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_rows"))
            .select(*keys, F.lit(name).alias("table_name"), "n_rows")
            for name in names
            if name in tables
        ]
    )


def metric_names(tables: Tables) -> DataFrame:
    """Distinct metric names of the wide tables."""
    return union_results(
        *[
            tables[name]
            .select("run_id", F.lit(name).alias("table_name"), "metric")
            .distinct()
            for name in ("node_stats", "namespace_stats")
            if name in tables
        ]
    )


def clusters(tables: Tables, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Every known key, from the coverage."""
    return _coverage_of(tables, keys).select(*keys).distinct()


def _coverage_of(tables: Tables, keys: Sequence[str], rules: Sequence[Rule] = ()) -> DataFrame:
    """Rows per table and key: as stored for the tables that the coverage lists, counted here for
    every other table that makes clusters known or that one of the rules reads.

    Which tables the coverage lists is a lookup of a few names, made while the plan is built.
    """
    names = list(dict.fromkeys([*COVERED, *(r.table for r in rules)]))
    if "coverage" not in tables:
        return presence(tables, keys, names)
    stored = tables["coverage"].select(*keys, "table_name", "n_rows")
    listed = {r.table_name for r in stored.select("table_name").distinct().collect()}
    rest = [name for name in names if name in tables and name not in listed]
    return stored.unionByName(presence(tables, keys, rest)) if rest else stored


def _error_text(e: Exception) -> str:
    return f"Error: {e}"


def _run_alone(df: DataFrame, rule_id: str) -> DataFrame:
    """The verdicts of a plug-in, made by a job of its own, whose failure is this rule's alone.

    Its message begins with what Spark calls the error; the stack of the job stays in the log.
    """
    try:
        return staged(df, "rule")
    except PySparkException as e:
        log.warning("rule %s failed: %s", rule_id, e)
        raise RuntimeError(e.getCondition() or str(e).strip().splitlines()[0]) from e


def _available(rule: Rule, tables: Tables) -> bool:
    needed = ENTITY_RULE_TABLES.get(rule.id, [rule.table])
    return all(t in tables for t in needed)


def _verdicts(
    tables: Tables,
    rules: Sequence[Rule],
    keys: Sequence[str],
    params: Mapping[str, Mapping],
    strict_names: bool,
) -> tuple[list[DataFrame], dict[str, str]]:
    """Verdict rows of all rules, and the rules that failed analysis with their error."""
    cols = [*keys, "id", "status", "message", "remediation", "evidence"]
    frames: list[DataFrame] = []
    errors: dict[str, str] = {}

    def grouped(fn, ids: list[str]) -> DataFrame:
        df = fn(tables, keys, ids=ids, params=params, strict_names=strict_names)
        return df.select(*cols)

    groups: dict[str, list[Rule]] = {}
    for r in rules:
        if not _available(r, tables):
            continue
        if r.group is not None:
            groups.setdefault(r.group, []).append(r)
            continue
        try:
            extra = {} if r.tier == "plugin" else {"strict_names": strict_names}
            df = r.fn(tables, keys, **params.get(r.id, {}), **extra)
            for c, t in [("remediation", "string"), ("evidence", "map<string,double>")]:
                if c not in df.columns:
                    df = df.withColumn(c, F.lit(None).cast(t))
            df = df.withColumn("id", F.lit(r.id)).select(*cols)
            frames.append(_run_alone(df, r.id) if r.tier == "plugin" else df)
        except Exception as e:  # one rule must not stop the others
            errors[r.id] = _error_text(e)

    for members in groups.values():
        try:
            frames.append(grouped(members[0].fn, [r.id for r in members]))
        except Exception:
            for r in members:
                try:
                    frames.append(grouped(r.fn, [r.id]))
                except Exception as e:
                    errors[r.id] = _error_text(e)
    return frames, errors


def _grid(
    cov: DataFrame, rules: Sequence[Rule], keys: Sequence[str], errors: Mapping[str, str]
) -> DataFrame:
    """One row per key and rule, with what to say when the rule says nothing."""
    names = sorted({r.table for r in rules})
    n_rows = [
        F.max(F.when(F.col("table_name") == t, F.col("n_rows"))).alias(f"n_{t}") for t in names
    ]
    wide = cov.groupBy(*keys).agg(*n_rows)

    def spec(r: Rule) -> str:
        """SQL text of one rule's struct: one expression instead of dozens of Column calls."""
        present = f"coalesce(`n_{r.table}`, 0) > 0"
        status = f"if({present}, {_quoted(r.empty[0])}, {_quoted(r.missing[0])})"
        message = f"if({present}, {_quoted(r.empty[1])}, {_quoted(r.missing[1])})"
        if r.id in errors:
            present, status, message = "false", _quoted(S.CRITICAL), _quoted(errors[r.id])
        return (
            f"named_struct('id', {_quoted(r.id)}, 'name', {_quoted(r.name)}, 'present', {present}, "
            f"'default_status', {status}, 'default_message', {message})"
        )

    return wide.select(*keys, F.expr(f"inline(array({', '.join(spec(r) for r in rules)}))"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def complete(
    cov: DataFrame,
    frames: Sequence[DataFrame],
    rules: Sequence[Rule],
    keys: Sequence[str],
    errors: Mapping[str, str] | None = None,
) -> DataFrame:
    """Results in the fixed schema: exactly one row per key and rule."""
    grid = _grid(cov, rules, keys, errors or {})
    no_evidence = F.create_map().cast("map<string,double>")
    if not frames:
        return grid.select(
            *keys,
            "id",
            "name",
            F.col("default_status").alias("status"),
            F.col("default_message").alias("message"),
            F.lit(None).cast("string").alias("remediation"),
            no_evidence.alias("evidence"),
        )
    verdicts = union_results(*frames)
    joined = grid.join(verdicts, on=[*keys, "id"], how="left")
    said = F.col("present") & F.col("status").isNotNull()
    return joined.select(
        *keys,
        "id",
        "name",
        F.when(said, F.col("status")).otherwise(F.col("default_status")).alias("status"),
        F.when(said, F.col("message")).otherwise(F.col("default_message")).alias("message"),
        F.when(said, F.col("remediation")).alias("remediation"),
        F.coalesce(F.when(said, F.col("evidence")), no_evidence).alias("evidence"),
    )


def run_all(
    tables: Tables,
    rules: Iterable[str] | None = None,
    keys: Sequence[str] = S.KEYS,
    params: Mapping[str, Mapping] | None = None,
    strict_names: bool = False,
) -> DataFrame:
    """All listed rules and all plug-ins over all keys, in one job.

    Each plug-in is a job of its own, run while the plan is made; if it fails, its rule is CRITICAL for
    every key and the others are as they would be without it.
    ``tables`` maps table names to DataFrames; an absent table is missing for every cluster. With
    a ``coverage`` table (the ingest writes one) no rule scans more than the rows it needs.
    """
    if rules is None:
        rules = RULE_ORDER + [r.id for r in REGISTRY.values() if r.tier == "plugin" and r.listed]
    chosen = [REGISTRY[i] for i in rules]
    cov = _coverage_of(tables, keys, chosen)
    frames, errors = _verdicts(tables, chosen, keys, params or {}, strict_names)
    return complete(cov, frames, chosen, keys, errors)


def run_rule(
    tables: Tables,
    rule_id: str,
    keys: Sequence[str] = S.KEYS,
    strict_names: bool = False,
    **params,
) -> DataFrame:
    """One rule over all keys."""
    return run_all(tables, [rule_id], keys, {rule_id: params}, strict_names)


def run_catalog(
    tables: Tables,
    rules: Iterable[str] | None = None,
    keys: Sequence[str] = S.KEYS,
    params: Mapping[str, Mapping] | None = None,
) -> DataFrame:
    """The declared catalogue rules. Those that need a parameter run only when it is given."""
    params = params or {}
    if rules is None:
        rules = [
            r.id
            for r in REGISTRY.values()
            if r.tier == "catalog" and (r.listed or r.id in params)
        ]
    return run_all(tables, rules, keys, params)


def findings(
    tables: Tables,
    keys: Sequence[str] = S.KEYS,
    ids: Sequence[str] | None = None,
    params: Mapping[str, Mapping] | None = None,
    strict_names: bool = False,
) -> DataFrame:
    """Every flagged namespace, setting, set and version as a row: what messages only count."""
    chosen = [i for i in (ids or ENTITY_RULE_TABLES) if _available(REGISTRY[i], tables)]
    rows = entities(tables, keys, chosen, params, strict_names).filter("flagged")
    rows = rows.select(*keys, "id", "entity", F.col("label").alias("detail"), "score")
    if "1.c" not in chosen:
        return rows
    # A version is a finding only where a cluster runs several.
    several = (
        rows.filter(F.col("id") == "1.c")
        .groupBy(*keys, "id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )
    mixed = rows.filter(F.col("id") == "1.c").join(
        several.select(*keys, "id"), on=[*keys, "id"], how="left_semi"
    )
    return rows.filter(F.col("id") != "1.c").unionByName(mixed)


def finding_texts(
    found: DataFrame, keys: Sequence[str] = S.KEYS, chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """All findings of a rule as text in numbered chunks: keys, id, chunk, n, text. No finding is left out."""
    return text_chunks(found, [*keys, "id"], "detail", ["entity", "detail"], ", ", chunk_chars)
