"""The DataFrames a report is drawn from. One row per cluster unless said otherwise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens import schema as S
from clusterlens.extract.metadata import UNKNOWN, index_location
from clusterlens.functions import lenient_bigint, status_mark
from clusterlens.operators import (
    count_distinct,
    metric_ilike,
    metric_in,
    sort_findings,
    status_counts,
    sum_by,
)
from clusterlens.rules.runner import clusters

# Defaults, patterns and names the datasets depend on.
UNNAMED = "Unnamed Cluster"
NO_FEATURES = "None detected"
DISK_PATTERNS = ["%data_used_pct%"]
KEY_BUSY_PATTERNS = ["%fail_key_busy%", "%client_key_busy%"]
CONNECTIONS = "as_stat.statistics.service.client_connections"
XDR = "XDR Enabled"
STRONG = "Strong Consistency"

CONTEXT_KEYS = {
    "cluster_name": ("cluster_name", UNNAMED),
    "server_version": ("server_version", UNKNOWN),
    "cloud_platform": ("cloud_platform", UNKNOWN),
    "consistency_model": ("consistency", UNKNOWN),
    "storage_flavor": ("storage", UNKNOWN),
    "topology": ("topology", UNKNOWN),
}

VITALS = [
    ("integrity", "3.a", "Node configurations are in step."),
    ("capacity", "5.a", "Resource use is nominal."),
    ("security", "6.a", "No connection count stands out."),
]

DEFAULT_REMEDIATION = "See the product documentation for this metric."


def cluster_context(tables: Mapping[str, DataFrame], keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Name, version, platform, size, consistency, storage, index, topology and features."""
    base = clusters(tables, keys)
    meta = tables["cluster_metadata"]
    wide = (
        metric_in(meta, list(CONTEXT_KEYS), col="key")
        .groupBy(*keys)
        .agg(
            *[
                F.max(F.when(F.col("key") == key, F.col("value"))).alias(name)
                for key, (name, _) in CONTEXT_KEYS.items()
            ]
        )
    )
    if "coverage" in tables:
        stats = tables["coverage"].filter(F.col("table_name") == "node_stats")
        sizes = stats.select(*keys, F.col("n_nodes").alias("node_count"))
    else:
        sizes = count_distinct(tables["node_stats"], keys, "node_id", "node_count")
    # Features are a closed vocabulary, so the set of a cluster stays small.
    features = tables["active_features"].groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set("feature")), ", ").alias("active_features")
    )
    index = index_location(base, meta, tables["namespace_stats"], keys)
    joined = base
    for part in (wide, sizes, index, features):
        joined = joined.join(part, on=list(keys), how="left")
    return joined.select(
        *keys,
        *[F.coalesce(name, F.lit(default)).alias(name) for name, default in CONTEXT_KEYS.values()],
        F.coalesce("node_count", F.lit(0)).alias("node_count"),
        F.coalesce("index_location", F.lit(UNKNOWN)).alias("index_location"),
        F.coalesce("active_features", F.lit(NO_FEATURES)).alias("active_features"),
    )


def assessment(
    results: DataFrame, mode: str = "current", keys: Sequence[str] = S.KEYS
) -> DataFrame:
    """Overall verdict. ``current`` counts missing data as a warning and needs one warning to speak
    of pressure; ``older`` counts warnings alone and needs more than three."""
    counts = status_counts(results, keys)
    if mode == "current":
        warnings, limit = F.col("n_warning") + F.col("n_missing"), 0
    elif mode == "older":
        warnings, limit = F.col("n_warning"), 3
    else:
        raise ValueError(f"unknown mode {mode!r}")
    critical = F.col("n_critical")
    level = (
        F.when(critical > 0, F.lit("immediate intervention"))
        .when(warnings > limit, F.lit("resource pressure"))
        .otherwise(F.lit("healthy"))
    )
    text = (
        F.when(
            critical > 0,
            F.concat(critical.cast("string"), F.lit(" critical findings need immediate intervention.")),
        )
        .when(
            warnings > limit,
            F.concat(warnings.cast("string"), F.lit(" findings are signs of resource pressure.")),
        )
        .otherwise(F.lit("The cluster is healthy."))
    )
    return counts.select(
        *keys,
        critical.alias("crit_count"),
        warnings.alias("warn_count"),
        level.alias("level"),
        text.alias("assessment"),
    )


def vitals(results: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Status, message and mark of the integrity, capacity and security rules, side by side.

    All three come from one aggregation, so the results are not joined with themselves.
    """
    aggs: list[Column] = []
    for name, rule_id, _ in VITALS:
        mine = F.col("id") == rule_id
        aggs += [
            F.max(F.when(mine, F.col("status"))).alias(f"{name}_status"),
            F.max(F.when(mine, F.col("message"))).alias(f"{name}_message"),
        ]
    wide = results.groupBy(*keys).agg(*aggs)
    cols: list[Column] = []
    for name, _, message in VITALS:
        status = F.coalesce(f"{name}_status", F.lit(S.PASS))
        cols += [
            status.alias(f"{name}_status"),
            F.coalesce(f"{name}_message", F.lit(message)).alias(f"{name}_message"),
            status_mark(status).alias(f"{name}_mark"),
        ]
    return wide.select(*keys, *cols)


def narrative(context: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """A sentence about each cluster."""
    strong = F.col("consistency").contains(STRONG)
    sentence = F.format_string(
        "Cluster %s runs version %s on %s nodes as a %s deployment; the findings put %s first.",
        F.col("cluster_name"),
        F.col("server_version"),
        F.col("node_count").cast("string"),
        F.when(strong, F.lit("strongly consistent (SC)")).otherwise(
            F.lit("highly available (AP)")
        ),
        F.when(strong, F.lit("safe writes while the network is split")).otherwise(
            F.lit("throughput and headroom")
        ),
    )
    suffix = F.when(
        F.col("topology") == XDR,
        F.lit(" Replication between data centers is on, so watch the bandwidth between them."),
    ).otherwise(F.lit(""))
    return context.select(*keys, F.concat(sentence, suffix).alias("narrative"))


def issues(results: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Every result that is not a PASS: one row per cluster and rule."""
    return results.filter(F.col("status") != S.PASS).select(
        *keys,
        "id",
        "name",
        "status",
        F.when(F.col("status") == S.CRITICAL, F.lit("important"))
        .otherwise(F.lit("warning"))
        .alias("callout"),
        "message",
        F.coalesce("remediation", F.lit(DEFAULT_REMEDIATION)).alias("remediation"),
    )


def appendix(results: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """All results in the order of their ids, with a mark."""
    rows = results.select(
        *keys,
        "id",
        "name",
        F.concat_ws(" ", status_mark("status", "appendix"), F.col("status")).alias("status"),
        F.trim(F.coalesce("message", F.lit(""))).alias("summary"),
    )
    return sort_findings(rows, keys)


def disk_usage(ns_stats: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Peak disk use per node and namespace."""
    rows = metric_ilike(ns_stats, DISK_PATTERNS)
    return rows.groupBy(*keys, "node_id", "namespace").agg(F.max("value").alias("used_pct"))


def client_connections(
    node_stats: DataFrame, keys: Sequence[str] = S.KEYS, metric: str = CONNECTIONS
) -> DataFrame:
    """Client connections per node."""
    return metric_in(node_stats, [metric]).select(
        *keys, "node_id", lenient_bigint("value").alias("connections")
    )


def hot_key_by_node(stats: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Key busy events per node."""
    rows = metric_ilike(stats, KEY_BUSY_PATTERNS)
    return sum_by(rows, [*keys, "node_id"], "value", lenient=True, alias="key_busy")
