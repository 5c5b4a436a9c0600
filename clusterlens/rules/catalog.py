"""Rules that the catalogue declares with a threshold of their own.

They join telemetry tables per node and namespace, or look across the snapshots of a run. Each is
a small frame of (entity, value, breach) rows that ``_judge`` reduces to one verdict per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens import schema as S
from clusterlens.functions import dotted_part, last_part, lenient_double, msg
from clusterlens.operators.filters import metric_in
from clusterlens.operators.series import counter_rates, days_to_limit, days_to_limit_after
from clusterlens.operators.sketches import merged_sketches, sketched_quantile
from clusterlens.operators.skew import deviation_skew
from clusterlens.rules.core import first_alias, node_errors, number
from clusterlens.rules.metrics import namespace_metrics
from clusterlens.rules.registry import Tables, evidence, rule, verdict
from clusterlens.rules.series import days, state_of

# How huge pages are reported as enabled.
THP_METRICS = ["transparent_hugepage", "transparent-huge-pages", "thp"]
THP_ENABLED = r"\[always\]|^always$|^enabled$|^true$"
FREE_MEMORY = "system_free_mem_pct"
HEAP_EFFICIENCY = ["heap_efficiency_pct", "heap-efficiency-pct"]
READS = ("client_read_success", "client_read_not_found")
DELETES = ("client_delete_success", "client_delete_not_found")


def service_names(*metrics: str) -> list[str]:
    """Spellings of a node-wide statistic."""
    return [p + m for m in metrics for p in ("as_stat.statistics.service.", "service.", "")]


def node_metric(
    tables: Tables, keys: Sequence[str], *metrics: str, alias: str = "x"
) -> DataFrame:
    """One value per node, from the first spelling it reports."""
    names = service_names(*metrics)
    rows = metric_in(tables["node_stats"], names)
    return rows.groupBy(*keys, "node_id").agg(
        first_alias(names, number(rows), F.max).alias(alias)
    )


def namespace_config(tables: Tables, keys: Sequence[str], setting: str, alias: str) -> DataFrame:
    """One setting per node and namespace."""
    cfg = tables["node_configs"].filter(F.col("config_name").ilike(f"namespace.%.{setting}"))
    return (
        cfg.filter(last_part("config_name") == setting)
        .groupBy(*keys, "node_id", dotted_part("config_name", 2).alias("namespace"))
        .agg(F.max(lenient_double("value")).alias(alias))
    )


def node_config(tables: Tables, keys: Sequence[str], setting: str, alias: str) -> DataFrame:
    """One service setting per node."""
    names = [f"service.{setting}", setting]
    cfg = tables["node_configs"].filter(F.col("config_name").isin(names))
    return cfg.groupBy(*keys, "node_id").agg(F.max(lenient_double("value")).alias(alias))


def _judge(
    rows: DataFrame,
    keys: Sequence[str],
    entity: Column,
    value: Column,
    breach: Column,
    what: str,
    advice: str,
    lowest: bool = False,
) -> DataFrame:
    """WARNING when any entity breaches; the worst one is named. One partial row per key and task."""
    order = value if lowest else -value
    judged = rows.select(
        *keys,
        value.cast("double").alias("value"),
        F.coalesce(breach, F.lit(False)).alias("breach"),
        F.struct(order.cast("double").alias("o"), entity.cast("string").alias("e")).alias("w"),
    ).filter(F.col("value").isNotNull())
    out = judged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("breach").alias("n_breach"),
        F.min(F.when(F.col("breach"), F.col("w"))).alias("worst"),
        (F.min("value") if lowest else F.max("value")).alias("extreme"),
    )
    found = F.col("n_breach") > 0
    status = F.when(found, F.lit(S.WARNING)).otherwise(F.lit(S.PASS))
    message = F.when(
        found,
        msg(
            f"{what}: %s of %s checked, worst on %s.",
            F.col("n_breach").cast("string"),
            F.col("n_rows").cast("string"),
            F.col("worst.e"),
        ),
    ).otherwise(msg(f"{what}: none of %s checked.", F.col("n_rows").cast("string")))
    ev = evidence(n_rows="n_rows", n_breach="n_breach", extreme="extreme")
    v = verdict(status, message, advice, ev)
    return out.select(*keys, v.alias("v")).select(*keys, "v.*")


def _node_and_namespace() -> Column:
    return F.concat_ws("/", "node_id", "namespace")


def _catalog(id: str, name: str, table: str, listed: bool = True, empty=None):
    return rule(
        id,
        name,
        table,
        missing=(S.DATA_MISSING, "The bundle holds no telemetry for this check."),
        empty=empty or (S.DATA_MISSING, "The metrics this check needs were not reported."),
        tier="catalog",
        listed=listed,
    )


@_catalog("C-1a", "Service Error Deviation", "node_stats")
def error_deviation(tables, keys=S.KEYS, max_dev_pct: float = 20.0, strict_names=False):
    nodes = node_errors(tables["node_stats"], keys, strict_names).filter(
        F.col("service_errors").isNotNull()
    )
    out = deviation_skew(nodes, keys, "service_errors", 0.0, max_dev_pct)
    return _judge(
        out,
        keys,
        F.lit("the cluster"),
        F.coalesce("dev_pct", F.lit(0.0)),
        F.col("skewed"),
        f"Error counts that deviate more than {max_dev_pct:g} percent",
        "Find the node that fails more than its peers, then read its logs.",
    )


@_catalog("C-1e", "THP Status", "system_info")
def huge_pages(
    tables,
    keys=S.KEYS,
    metrics: Sequence[str] = tuple(THP_METRICS),
    enabled: str = THP_ENABLED,
    strict_names=False,
):
    rows = tables["system_info"].filter(F.lower("metric").isin([m.lower() for m in metrics]))
    on = F.lower("value").rlike(enabled)
    return _judge(
        rows,
        keys,
        F.col("node_id"),
        on.cast("double"),
        on,
        "Nodes with transparent huge pages",
        "The kernel moves memory about while requests wait. Set the mode of these nodes to never and restart them.",
    )


@_catalog("C-1f", "Clock Skew", "node_stats")
def clock_skew(tables, keys=S.KEYS, limit: float = 0.0, strict_names=False):
    nodes = node_metric(tables, keys, "cluster_clock_skew", "cluster_clock_skew_ms")
    return _judge(
        nodes,
        keys,
        F.col("node_id"),
        F.col("x"),
        F.col("x") > limit,
        "Nodes with clock skew",
        "Synchronise the clocks of all nodes.",
    )


@_catalog("C-2b", "Sprig Ratio", "namespace_stats")
def sprig_ratio(
    tables, keys=S.KEYS, max_ratio: float = 256.0, default: float = 64.0, strict_names=False
):
    stats = namespace_metrics(tables, keys, objects="objects")
    cfg = namespace_config(tables, keys, "partition-tree-sprigs", "sprigs")
    rows = stats.join(cfg, on=[*keys, "node_id", "namespace"], how="left")
    ratio = F.try_divide(F.col("objects"), F.coalesce("sprigs", F.lit(float(default))))
    return _judge(
        rows,
        keys,
        _node_and_namespace(),
        ratio,
        ratio > max_ratio,
        f"Namespaces with more than {max_ratio:g} objects per sprig",
        "Raise the sprig count; this needs a restart.",
    )


@_catalog("C-2c", "Defragmentation Margin", "namespace_stats")
def defrag_margin(tables, keys=S.KEYS, margin: float = 5.0, strict_names=False):
    stats = namespace_metrics(tables, keys, used="data_used_pct")
    cfg = namespace_config(tables, keys, "defrag-lwm-pct", "lwm")
    rows = stats.join(cfg, on=[*keys, "node_id", "namespace"])
    gap = F.abs(F.col("used") - F.col("lwm"))
    return _judge(
        rows,
        keys,
        _node_and_namespace(),
        gap,
        gap <= margin,
        f"Namespaces within {margin:g} points of their defragmentation mark",
        "Lower the defragmentation mark or give the namespace more room.",
        lowest=True,
    )


@_catalog("C-2e", "Free Memory", "node_stats")
def free_memory(tables, keys=S.KEYS, min_pct: float = 20.0, strict_names=False):
    nodes = node_metric(tables, keys, FREE_MEMORY)
    return _judge(
        nodes,
        keys,
        F.col("node_id"),
        F.col("x"),
        F.col("x") < min_pct,
        f"Nodes with less than {min_pct:g} percent free memory",
        "Shrink the indexes held in memory, or add memory.",
        lowest=True,
    )


@_catalog("C-2f", "Heap Efficiency", "node_stats")
def heap_efficiency(tables, keys=S.KEYS, min_pct: float = 60.0, strict_names=False):
    nodes = node_metric(tables, keys, *HEAP_EFFICIENCY)
    return _judge(
        nodes,
        keys,
        F.col("node_id"),
        F.col("x"),
        F.col("x") < min_pct,
        f"Nodes with a heap efficiency below {min_pct:g} percent",
        "Memory is fragmented. Watch the growth of indexes and namespaces.",
        lowest=True,
    )


@_catalog("C-2g", "NSUP Cycle Lag", "namespace_stats")
def nsup_lag(tables, keys=S.KEYS, strict_names=False):
    stats = namespace_metrics(tables, keys, cycle="nsup_cycle_duration")
    cfg = namespace_config(tables, keys, "nsup-period", "period")
    rows = stats.join(cfg, on=[*keys, "node_id", "namespace"])
    return _judge(
        rows,
        keys,
        _node_and_namespace(),
        F.col("cycle") - F.col("period"),
        F.col("cycle") > F.col("period"),
        "Namespaces whose expiry cycle is longer than its period",
        "Give expiry more threads or a longer period.",
    )


@_catalog("C-3c", "FD Max Capacity", "node_stats")
def fd_capacity(tables, keys=S.KEYS, max_ratio: float = 0.8, strict_names=False):
    conns = node_metric(tables, keys, "client_connections")
    cfg = node_config(tables, keys, "proto-fd-max", "fd_max")
    rows = conns.join(cfg, on=[*keys, "node_id"])
    ratio = F.try_divide(F.col("x"), F.col("fd_max"))
    return _judge(
        rows,
        keys,
        F.col("node_id"),
        ratio,
        ratio >= max_ratio,
        f"Nodes that use {max_ratio:g} of their file descriptors or more",
        "Raise the descriptor limit.",
    )


@_catalog("C-3d", "Min Cluster Size", "node_configs")
def min_cluster_size(tables, keys=S.KEYS, strict_names=False):
    cfg = node_config(tables, keys, "min-cluster-size", "size")
    return _judge(
        cfg,
        keys,
        F.col("node_id"),
        F.col("size"),
        F.col("size") == 1,
        "Nodes that accept a cluster of one",
        "Set the minimum cluster size above 1.",
        lowest=True,
    )


def _rate_rule(tables, keys, metric: str, limit: float, what: str, advice: str) -> DataFrame:
    """Verdict per snapshot, from the counter's growth since the previous one, also of an earlier run."""
    series = [k for k in keys if k != "snapshot_ts"] + ["node_id", "namespace"]
    stats = namespace_metrics(tables, keys, x=metric)
    rates = counter_rates(stats, series, "snapshot_ts", "x", state=state_of(tables, metric))
    return _judge(
        rates,
        keys,
        _node_and_namespace(),
        F.col("rate"),
        F.col("rate") > limit,
        what,
        advice,
    )


@_catalog("C-4a", "Hot Key Rate", "namespace_stats")
def hot_key_rate(tables, keys=S.KEYS, per_second: float = 100.0, strict_names=False):
    return _rate_rule(
        tables,
        keys,
        "fail_key_busy",
        per_second,
        f"Namespaces with more than {per_second:g} key busy events per second",
        "A few records take most of the writes. Find them in the logs of the worst node, then spread their "
        "updates over several keys or over time.",
    )


@_catalog("C-4i", "Proxy Rate", "namespace_stats")
def proxy_rate(tables, keys=S.KEYS, per_second: float = 1000.0, strict_names=False):
    return _rate_rule(
        tables,
        keys,
        "client_proxy",
        per_second,
        f"Namespaces with more than {per_second:g} proxied requests per second",
        "Requests take a second hop between nodes. Compare the node lists of the clients with the cluster and "
        "restart those that still use an old one.",
    )


def miss_ratio(
    tables: Tables, keys: Sequence[str], hits: str, misses: str, max_pct: float
) -> DataFrame:
    """Misses as a percentage of all attempts, per key."""
    stats = namespace_metrics(tables, keys, hits=hits, misses=misses)
    out = stats.groupBy(*keys).agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
    hit, miss = F.coalesce("hits", F.lit(0.0)), F.coalesce("misses", F.lit(0.0))
    pct = F.coalesce(F.try_divide(miss, hit + miss) * F.lit(100.0), F.lit(0.0))
    return out.select(
        *keys,
        hit.alias("hits"),
        miss.alias("misses"),
        pct.alias("pct"),
        F.when(pct > max_pct, F.lit(S.WARNING)).otherwise(F.lit(S.PASS)).alias("status"),
    )


def _ratio_rule(tables, keys, names, max_pct, what, advice) -> DataFrame:
    out = miss_ratio(tables, keys, *names, max_pct)
    message = msg(
        f"%s of %s {what} found no record.",
        F.format_number(F.col("misses").cast("bigint"), 0),
        F.format_number((F.col("hits") + F.col("misses")).cast("bigint"), 0),
    )
    ev = evidence(hits="hits", misses="misses", pct="pct")
    v = verdict(F.col("status"), message, advice, ev)
    return out.select(*keys, v.alias("v")).select(*keys, "v.*")


@_catalog("C-4b", "Read Miss Ratio", "namespace_stats")
def read_miss_ratio(tables, keys=S.KEYS, max_pct: float = 5.0, strict_names=False):
    advice = (
        "Many reads cost a lookup and bring nothing. Compare how long records are kept with how long clients go "
        "on asking for them."
    )
    return _ratio_rule(tables, keys, READS, max_pct, "reads", advice)


@_catalog("C-4c", "Delete Miss Ratio", "namespace_stats")
def delete_miss_ratio(tables, keys=S.KEYS, max_pct: float = 1.0, strict_names=False):
    advice = (
        "Deletes reach records that are gone already. Look for retries and for several clients that clean up the "
        "same records."
    )
    return _ratio_rule(tables, keys, DELETES, max_pct, "deletes", advice)


@_catalog("C-4d", "Batch Success Rate", "namespace_stats", listed=False)
def batch_success(
    tables,
    keys=S.KEYS,
    *,
    min_pct: float,
    success: str = "batch_sub_read_success",
    failures: Sequence[str] = ("batch_sub_read_error", "batch_sub_read_timeout"),
    strict_names=False,
):
    """Share of batch sub-transactions that succeed; the threshold is the caller's."""
    fails = {f"f{i}": m for i, m in enumerate(failures)}
    stats = namespace_metrics(tables, keys, ok=success, **fails)
    failed = sum((F.coalesce(F.col(f), F.lit(0.0)) for f in fails), F.lit(0.0))
    ok = F.coalesce("ok", F.lit(0.0))
    pct = F.try_divide(ok, ok + failed) * F.lit(100.0)
    return _judge(
        stats,
        keys,
        _node_and_namespace(),
        pct,
        pct < min_pct,
        f"Namespaces where less than {min_pct:g} percent of batch work succeeds",
        "Look for timeouts and errors in batch requests.",
        lowest=True,
    )


@_catalog("C-4e", "Query Latency", "namespace_stats", listed=False)
def query_latency(
    tables,
    keys=S.KEYS,
    *,
    metric: str,
    max_latency: float,
    quantile: float = 0.95,
    accuracy: int = 10000,
    strict_names=False,
):
    """Quantile of a latency metric over nodes and namespaces; metric and limit are the caller's.

    Where a table of ``sketches`` is given, its sketches of the metric answer and no statistic is read.
    """
    if "sketches" in tables:
        stored = tables["sketches"].filter(F.col("metric") == metric)
        out = sketched_quantile(merged_sketches(stored, keys), keys, quantile)
    else:
        rows = namespace_metrics(tables, keys, x=metric).filter(F.col("x").isNotNull())
        out = rows.groupBy(*keys).agg(
            F.percentile_approx("x", F.lit(quantile), F.lit(accuracy)).alias("q")
        )
    return _judge(
        out,
        keys,
        F.lit("the cluster"),
        F.col("q"),
        F.col("q") > max_latency,
        f"Latency quantiles above {max_latency:g}",
        "Look at the load and the storage of the slow nodes.",
    )


@_catalog("C-4h", "Cache Read Ratio", "namespace_stats")
def cache_reads(tables, keys=S.KEYS, min_pct: float = 90.0, strict_names=False):
    stats = namespace_metrics(tables, keys, x="cache_read_pct")
    return _judge(
        stats,
        keys,
        _node_and_namespace(),
        F.col("x"),
        F.col("x") < min_pct,
        f"Namespaces that read less than {min_pct:g} percent from cache",
        "Check that the page cache for reads is on.",
        lowest=True,
    )


@_catalog(
    "C-5a",
    "Capacity Projection",
    "namespace_stats",
    empty=(S.PASS, "The projection is given with the latest snapshot of the cluster."),
)
def capacity_projection(
    tables,
    keys=S.KEYS,
    hwm: float = 60.0,
    max_days: float = 30.0,
    min_points: int = 3,
    metric: str = "data_used_pct",
    strict_names=False,
):
    """Will a namespace pass its high-water mark within ``max_days``? Judged at the last snapshot, from
    the readings of this run and, where a ``series`` table is given, of all before it."""
    cluster = [k for k in keys if k != "snapshot_ts"]
    stats = namespace_metrics(tables, keys, used=metric).filter(F.col("used").isNotNull())
    stats = stats.withColumn("day", days("snapshot_ts"))
    entity = [*cluster, "node_id", "namespace"]
    state = state_of(tables, metric)
    if state is None:
        fits = days_to_limit(stats, entity, "day", "used", hwm, min_points)
    else:
        fits = days_to_limit_after(stats, entity, "snapshot_ts", "day", "used", hwm, state, min_points)
    out = fits.groupBy(*cluster).agg(
        F.max("n_points").alias("n_points"),
        F.min("days_left").alias("days_left"),
        F.min(
            F.when(
                F.col("days_left").isNotNull(),
                F.struct("days_left", _node_and_namespace().alias("e")),
            )
        ).alias("worst"),
    )
    last = stats.groupBy(*cluster).agg(F.max("snapshot_ts").alias("snapshot_ts"))
    out = out.join(last, on=cluster)
    enough = F.col("n_points") >= min_points
    soon = F.coalesce(F.col("days_left") < max_days, F.lit(False))
    status = (
        F.when(~enough, F.lit(S.DATA_MISSING))
        .when(soon, F.lit(S.WARNING))
        .otherwise(F.lit(S.PASS))
    )
    message = (
        F.when(~enough, F.lit(f"Fewer than {min_points} snapshots, so there is no projection."))
        .when(
            soon,
            msg(
                "%s reaches its high-water mark in %s days.",
                F.col("worst.e"),
                F.greatest(F.col("days_left"), F.lit(0.0)).cast("bigint").cast("string"),
            ),
        )
        .otherwise(F.lit(f"No namespace reaches its high-water mark within {max_days:g} days."))
    )
    ev = evidence(days_left="days_left", n_points="n_points")
    v = verdict(status, message, "Add nodes or storage before records are evicted.", ev)
    return out.select(*keys, v.alias("v")).select(*keys, "v.*")


@_catalog("C-5b", "License Usage", "namespace_stats", listed=False)
def license_usage(
    tables, keys=S.KEYS, *, limit: float, metric: str = "data_used_bytes", strict_names=False
):
    """Total data of a cluster against a licensed amount, which the caller supplies."""
    stats = namespace_metrics(tables, keys, x=metric)
    out = stats.groupBy(*keys).agg(F.sum("x").alias("x"))
    return _judge(
        out,
        keys,
        F.lit("the cluster"),
        F.col("x"),
        F.col("x") > limit,
        "Clusters above their licensed amount",
        "Remove data or extend the license.",
    )


@_catalog("C-6a", "User Connection Limit", "security_stats")
def user_limit(tables, keys=S.KEYS, max_conns: int = 500, strict_names=False):
    rows = tables["security_stats"]
    return _judge(
        rows,
        keys,
        F.concat_ws("/", "node_id", "user"),
        F.col("connections"),
        F.col("connections") > max_conns,
        f"Users with more than {max_conns} connections to one node",
        "Look for connections that are never closed.",
    )
