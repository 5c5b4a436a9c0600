"""Joins. No side is hinted: AQE broadcasts what it measures to be small, and splits hot keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_drift(
    live: DataFrame, static: DataFrame, on: Sequence[str], value: str = "value"
) -> DataFrame:
    """Settings present on both sides whose values differ."""
    left = live.select(*on, F.col(value).alias("live_value"))
    right = static.select(*on, F.col(value).alias("static_value"))
    return left.join(right, on=list(on)).filter(F.col("live_value") != F.col("static_value"))


def paired_settings(
    cfg: DataFrame,
    keys: Sequence[str],
    name: str,
    value: str,
    order: Sequence[str],
    defaults: Mapping[str, str | None],
) -> DataFrame:
    """Sibling settings of one entity side by side, one column per name.

    The first value by ``order`` counts, and a setting that is absent takes its default. One
    conditional aggregation instead of a self-join per setting.
    """
    rows = cfg.filter(F.col(name).isin(list(defaults)) & F.col(value).isNotNull())
    picks = [
        F.min(F.when(F.col(name) == n, F.struct(*[F.col(o) for o in order], F.col(value))))
        .getField(value)
        .alias(n)
        for n in defaults
    ]
    out = rows.groupBy(*keys).agg(*picks)
    for n, default in defaults.items():
        if default is not None:
            out = out.withColumn(n, F.coalesce(F.col(f"`{n}`"), F.lit(default)))
    return out


def with_metadata(
    df: DataFrame,
    meta: DataFrame,
    key: str,
    default: str = "Unknown",
    keys: Sequence[str] = ("cluster_id",),
    alias: str | None = None,
) -> DataFrame:
    """One metadata value of the cluster next to every row."""
    name = alias or key
    wanted = meta.filter(F.col("key") == key).select(*keys, F.col("value").alias(name))
    joined = df.join(wanted, on=list(keys), how="left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.lit(default)))


def pick_rule(
    clusters: DataFrame,
    results: DataFrame,
    rule_id: str,
    keys: Sequence[str],
    status: str,
    message: str,
) -> DataFrame:
    """Result of one rule for every cluster, with a default where there is none."""
    found = results.filter(F.col("id") == rule_id).select(*keys, "status", "message")
    return clusters.select(*keys).join(found, on=list(keys), how="left").select(
        *keys,
        F.coalesce("status", F.lit(status)).alias("status"),
        F.coalesce("message", F.lit(message)).alias("message"),
    )


def keep_in(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows with a partner in ``other``."""
    return df.join(other.select(*on), on=list(on), how="left_semi")


def keep_not_in(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a partner in ``other``."""
    return df.join(other.select(*on), on=list(on), how="left_anti")
