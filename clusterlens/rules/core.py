"""The sixteen listed health rules and one unlisted variant.

Rules over the same table share one scan: ``namespace_rules`` and ``node_error_rules`` reduce the
table to one wide row per key; ``entity_rules`` judges namespaces, settings, sets and versions
first and then counts what it flagged.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterlens import schema as S
from clusterlens.functions import (
    as_int_text,
    dotted_part,
    last_part,
    lenient_double,
    msg,
    strict_int,
    thousands,
)
from clusterlens.operators import filters as flt
from clusterlens.operators import skew
from clusterlens.operators.aggregates import CHUNK_CHARS, distinct_drift
from clusterlens.operators.joins import value_drift
from clusterlens.operators.picks import lead_rows, union_results
from clusterlens.rules.registry import Tables, evidence, rule, unpack, verdict

# Metric names, thresholds, ignore lists and patterns the verdicts depend on.
SERVICE_ERROR = ["service.service_error", "as_stat.statistics.service.service_error"]
PROXY_ERROR = [
    "service.client_proxy_error",
    "client_proxy_error",
    "as_stat.statistics.service.client_proxy_error",
]
READ_NOT_FOUND = ["service.client_read_not_found", "client_read_not_found"]
DELETE_NOT_FOUND = ["service.client_delete_not_found", "client_delete_not_found"]
DISK_USED = "service.data_used_pct"
MEMORY_USED = "service.memory_used_pct"
CAPACITY_PATTERNS = ["%data_used_pct%", "%memory_used_pct%"]
KEY_BUSY_PATTERN = "%fail_key_busy%"
VERSION_PATTERNS = ["%version", "%build"]
DRIVER_METRIC = "network_driver"
DRIVER_REGEX = "ena|vfio-pci"
IDENTITY_SETTINGS = [
    "service.node-id",
    "service.cluster-name",
    "network.service.address",
    "network.service.access-address",
    "network.service.alternate-access-address",
    "network.heartbeat.address",
    "network.heartbeat.mesh-seed-address-port",
    "network.fabric.address",
    "network.service.port",
]
STATISTIC_PATTERNS = [
    ".objects",
    ".data_used_bytes",
    ".memory_data_bytes",
    ".stop-writes-count",
    ".evict-count",
]
NAMESPACE_SETTINGS = [
    "index-type",
    "sindex-type",
    "partition-tree-sprigs",
    "defrag-lwm-free-pct",
    "high-water-disk-pct",
]
DEFAULTS: dict[str, dict[str, object]] = {
    "1.a": {"factor": 2.0, "floor": 100.0},
    "1.a2": {"factor": 2.0, "floor": 100.0},
    "1.b": {"driver_regex": DRIVER_REGEX},
    "2.b": {"min_sprigs": 256, "default": "64"},
    "2.c": {"floor": 40, "default": "50"},
    "2.d": {"warn": 60.0, "crit": 75.0},
    "2.e": {"warn": 60.0, "crit": 80.0},
    "3.a": {"ignore": IDENTITY_SETTINGS, "stat_patterns": STATISTIC_PATTERNS},
    "4.a": {"pattern": KEY_BUSY_PATTERN},
    "4.c": {"limit": 1_000_000},
    "4.f": {"min_avg": 1000.0, "max_dev_pct": 10.0},
    "5.a": {"warn": 70.0, "crit": 85.0},
    "6.a": {"max_pct": 80, "min_conns": 100},
}

_ERRORS_ADVICE = (
    "A single node that fails more than its peers usually has a local fault. Read its logs, then check "
    "disks, network interface and kernel messages of that host."
)


def _mark_advice(what: str) -> str:
    return (
        f"Above its {what} mark a namespace evicts records, and later refuses writes. Look for uneven "
        "nodes, check that records expire, and add capacity."
    )


#: What to do about a result that is no PASS.
ADVICE: dict[str, str] = {
    "1.a": _ERRORS_ADVICE,
    "1.a2": _ERRORS_ADVICE,
    "1.b": "Plain drivers cost interrupt latency. Check that the instance type offers enhanced networking "
    "and that its driver is loaded.",
    "1.c": "Mixed versions are for rolling upgrades only. Bring all nodes to one release.",
    "2.a": "An index that needs flash seldom fits beside others in memory. Move the secondary indexes of "
    "these namespaces to flash and restart node by node.",
    "2.b": "Few sprigs make deep trees and cost disk reads. Raise the sprig count; this needs a cold start.",
    "2.c": "Raise the defragmentation mark of these namespaces, or lower their high-water mark.",
    "2.d": _mark_advice("disk"),
    "2.e": _mark_advice("memory"),
    "3.a": "Uneven settings make some nodes slower than others. Compare the nodes and settle on one value "
    "for each.",
    "3.b": "Run-time changes are lost at the next restart. Bring the static configuration up to date.",
    "4.a": "Many transactions wait for the same record. Find the namespace and node with the most of these "
    "errors, then cache or split the hot keys.",
    "4.b": "",
    "4.c": "Deletes of absent records still cost a transaction. Look for double deletes and for records that "
    "had already expired.",
    "4.f": "Uneven sets fill some nodes early. Check how the partitions are spread.",
    "5.a": "High use leaves no room for a lost node or a burst. Plan an expansion and find the namespaces that "
    "grow.",
    "6.a": "One user that takes most connections can lock others out. Review the pool size of that application "
    "and look for connections that are never closed.",
}

#: Names that a pattern may become; more are judged row by row.
MOST_NAMES = 500
#: Characters of names that a message spells out: the first chunk of ``runner.finding_texts``.
NAMES_CHARS = CHUNK_CHARS
DRIFT_NAMES_IN_MESSAGE = 3


def _params(params: Mapping[str, Mapping[str, object]] | None, rule_id: str) -> dict:
    given = (params or {}).get(rule_id, {})
    return {**DEFAULTS.get(rule_id, {}), **given}


def number(df: DataFrame, col: str = "value") -> Column:
    """Telemetry value as double; text is read leniently."""
    if isinstance(df.schema[col].dataType, T.StringType):
        return lenient_double(col)
    return F.col(col).cast("double")


def first_alias(metrics: Sequence[str], value: Column, agg=F.sum) -> Column:
    """Aggregate of the first alias that is present in the group."""
    return F.coalesce(*[agg(F.when(F.col("metric") == m, value)) for m in metrics])


def matching(tables: Tables, table: str, patterns: Sequence[str]) -> Column:
    """Condition on ``metric``: LIKE any of the patterns.

    Where a dictionary of the table's names is given, the patterns are judged on it, and what is left is a list
    of names, by which Parquet skips row groups. Stored dictionaries are those of the very files that are read.
    """
    like = flt.like_any("metric", patterns)
    if "metric_names" not in tables:
        return like
    names = tables["metric_names"].filter(F.col("table_name") == table)
    found = names.filter(like).select("metric").distinct().limit(MOST_NAMES + 1).collect()
    if len(found) > MOST_NAMES or (not found and names.isEmpty()):
        return like
    return F.col("metric").isin([r["metric"] for r in found])


# --- 1.a, 1.a2: error skew over nodes --------------------------------------------------------


def node_errors(node_stats: DataFrame, keys: Sequence[str], strict_names: bool) -> DataFrame:
    """Service and proxy errors per node, one alias per node."""
    service = SERVICE_ERROR[:1] if strict_names else SERVICE_ERROR
    proxy = PROXY_ERROR[:2] if strict_names else PROXY_ERROR
    rows = flt.metric_in(node_stats, [*service, *proxy])
    value = number(rows)
    if strict_names:
        return rows.select(
            *keys,
            "node_id",
            F.when(F.col("metric").isin(service), value).alias("service_errors"),
            F.when(F.col("metric").isin(proxy), value).alias("proxy_errors"),
        )
    return rows.groupBy(*keys, "node_id").agg(
        first_alias(service, value).alias("service_errors"),
        first_alias(proxy, value).alias("proxy_errors"),
    )


def node_error_rules(
    tables: Tables,
    keys: Sequence[str] = S.KEYS,
    ids: Sequence[str] = ("1.a", "1.a2"),
    params: Mapping | None = None,
    strict_names: bool = False,
) -> DataFrame:
    nodes = node_errors(tables["node_stats"], keys, strict_names)
    aggs, verdicts = [], []
    for rule_id, col, what in [
        ("1.a", "service_errors", "service"),
        ("1.a2", "proxy_errors", "proxy"),
    ]:
        if rule_id not in ids:
            continue
        p = _params(params, rule_id)
        x, pre = F.col(col), col + "_"
        worst = F.min(F.when(x.isNotNull(), F.struct((-x).alias("neg"), F.col("node_id"))))
        aggs += [
            F.sum(x).alias(pre + "total"),
            F.avg(x).alias(pre + "mean"),
            F.count(x).alias(pre + "n"),
            worst.alias(pre + "worst"),
        ]
        total, mean, n = F.col(pre + "total"), F.col(pre + "mean"), F.col(pre + "n")
        peak, node = -F.col(pre + "worst.neg"), F.col(pre + "worst.node_id")
        skewed = (
            (total != 0) & (peak > mean * float(p["factor"])) & (peak > float(p["floor"]))
        )
        status = F.when(skewed, F.lit(S.WARNING)).otherwise(F.lit(S.PASS))
        message = (
            F.when(total == 0, F.lit(f"No {what} errors were counted on any node."))
            .when(
                skewed,
                msg(
                    f"Node %s stands out with %s {what} errors against a mean of %s.",
                    node,
                    as_int_text(peak),
                    as_int_text(mean),
                ),
            )
            .otherwise(
                msg(
                    f"{what.capitalize()} errors are evenly spread over %s nodes: "
                    "total %s, highest %s, mean %s.",
                    n.cast("string"),
                    as_int_text(total),
                    as_int_text(peak),
                    as_int_text(mean),
                )
            )
        )
        ev = evidence(total=total, mean=mean, peak=peak, n_rows=n)
        verdicts.append((n > 0, verdict(status, message, ADVICE[rule_id], ev, rule_id)))
    return unpack(nodes.groupBy(*keys).agg(*aggs), keys, *verdicts)


_NO_TABLE = (S.DATA_MISSING, "The bundle holds no telemetry for this check.")

rule(
    "1.a",
    "Service Error Skew",
    "node_stats",
    missing=_NO_TABLE,
    empty=(S.PASS, "No service errors were counted on any node."),
    group="node_errors",
    tier="core",
)(node_error_rules)
rule(
    "1.a2",
    "Proxy Error Skew",
    "node_stats",
    missing=_NO_TABLE,
    empty=(S.PASS, "No proxy errors were counted on any node."),
    group="node_errors",
    tier="core",
    listed=False,
)(node_error_rules)


# --- 1.b: network driver ---------------------------------------------------------------------


@rule(
    "1.b",
    "Network Acceleration Check",
    "system_info",
    missing=(S.WARNING, "System telemetry is absent, so the network driver is unknown."),
    empty=(S.PASS, "Network acceleration needs no attention on platform Unknown."),
    tier="core",
)
def network_acceleration(
    tables: Tables,
    keys: Sequence[str] = S.KEYS,
    driver_regex: str = DRIVER_REGEX,
    strict_names: bool = False,
) -> DataFrame:
    info = tables["system_info"]
    drivers = flt.metric_in(info, [DRIVER_METRIC])
    found = drivers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("value").rlike(driver_regex)).alias("n_fast"),
    )
    # Clusters without a driver row count too, hence the platform side leads the join.
    meta = tables.get("cluster_metadata")
    if meta is None:
        platforms = info.filter(F.lit(False)).select(*keys, F.lit(None).cast("string").alias("platform"))
    else:
        platforms = meta.filter(F.col("key") == "cloud_platform").select(
            *keys, F.col("value").alias("platform")
        )
    joined = platforms.join(found, on=list(keys), how="full_outer")
    n_rows, n_fast = F.coalesce("n_rows", F.lit(0)), F.coalesce("n_fast", F.lit(0))
    platform = F.coalesce("platform", F.lit("Unknown"))
    slow = F.upper(platform).contains("AWS") & (n_fast == 0)
    status = F.when(slow, F.lit(S.WARNING)).otherwise(F.lit(S.PASS))
    message = F.when(
        slow, F.lit("No accelerated network driver was found on an AWS platform.")
    ).otherwise(msg("Network acceleration needs no attention on platform %s.", platform))
    ev = evidence(driver_rows=n_rows, fast_rows=n_fast)
    v = verdict(status, message, ADVICE["1.b"], ev)
    return joined.select(*keys, v.alias("v")).select(*keys, "v.*")


# --- 2.d, 2.e, 4.a, 4.b, 4.c, 5.a: namespace statistics --------------------------------------


def namespace_facts(
    tables: Tables,
    keys: Sequence[str],
    ids: Sequence[str],
    params: Mapping | None,
    strict_names: bool,
) -> DataFrame:
    """Wanted numbers per key, node and namespace, from one scan with hash aggregation."""
    ns_stats = tables["namespace_stats"]
    m = F.col("metric")
    value = number(ns_stats)

    def like(rule_id: str, patterns: Sequence[str]) -> Column:
        return matching(tables, "namespace_stats", patterns) if rule_id in ids else F.lit(False)

    busy = like("4.a", [_params(params, "4.a")["pattern"]])
    used = like("5.a", CAPACITY_PATTERNS)
    read = READ_NOT_FOUND[1:] if strict_names else READ_NOT_FOUND
    delete = DELETE_NOT_FOUND[1:] if strict_names else DELETE_NOT_FOUND
    wanted = {
        "2.d": (m == DISK_USED, lambda v, c: F.max(F.when(c, v)), "disk"),
        "2.e": (m == MEMORY_USED, lambda v, c: F.max(F.when(c, v)), "memory"),
        "4.a": (busy, lambda v, c: F.sum(F.when(c, v)), "busy"),
        "4.b": (m.isin(read), lambda v, c: first_alias(read, v), "read_miss"),
        "4.c": (m.isin(delete), lambda v, c: first_alias(delete, v), "delete_miss"),
        "5.a": (used, lambda v, c: F.max(F.when(c, v)), "peak"),
    }
    wanted = {i: w for i, w in wanted.items() if i in ids}
    some = None
    for cond, _, _ in wanted.values():
        some = cond if some is None else some | cond
    return (
        ns_stats.filter(some)
        .groupBy(*keys, "node_id", "namespace")
        .agg(*[build(value, cond).alias(name) for cond, build, name in wanted.values()])
    )


def namespace_rules(
    tables: Tables,
    keys: Sequence[str] = S.KEYS,
    ids: Sequence[str] = ("2.d", "2.e", "4.a", "4.b", "4.c", "5.a"),
    params: Mapping | None = None,
    strict_names: bool = False,
) -> DataFrame:
    facts = namespace_facts(tables, keys, ids, params, strict_names)
    aggs: list[Column] = []
    verdicts: list[tuple[Column, Column]] = []

    for rule_id, col, what in [("2.d", "disk", "disk"), ("2.e", "memory", "memory")]:
        if rule_id not in ids:
            continue
        p = _params(params, rule_id)
        x = F.col(col)
        worst = F.struct((-x).alias("neg"), F.col("node_id"), F.col("namespace"))
        aggs.append(F.min(F.when(x.isNotNull(), worst)).alias(f"{col}_worst"))
        peak = -F.col(f"{col}_worst.neg")
        status = flt.band(peak, float(p["warn"]), float(p["crit"]))
        message = F.when(
            status == S.PASS,
            msg(f"Peak {what} use is %s%%, below the mark of {p['warn']:g}%%.", as_int_text(peak)),
        ).otherwise(
            msg(
                f"Namespace %s uses %s%% of its {what} on node %s.",
                F.col(f"{col}_worst.namespace"),
                as_int_text(peak),
                F.col(f"{col}_worst.node_id"),
            )
        )
        verdicts.append(
            (
                F.col(f"{col}_worst").isNotNull(),
                verdict(status, message, ADVICE[rule_id], evidence(peak=peak), rule_id),
            )
        )

    for rule_id, col, what in [
        ("4.a", "busy", "key busy"),
        ("4.b", "read_miss", "read not found"),
        ("4.c", "delete_miss", "delete not found"),
    ]:
        if rule_id not in ids:
            continue
        total = F.col(f"{col}_total")
        aggs.append(F.sum(col).alias(f"{col}_total"))
        if rule_id == "4.a":
            over = total > 0
        elif rule_id == "4.b":
            over = F.lit(False)
        else:
            over = total > float(_params(params, "4.c")["limit"])
        status = F.when(over, F.lit(S.WARNING)).otherwise(F.lit(S.PASS))
        message = F.when(total == 0, F.lit(f"No '{what}' events were counted.")).otherwise(
            msg(f"%s '{what}' events were counted in the cluster.", thousands(total))
        )
        verdicts.append(
            (
                total.isNotNull(),
                verdict(status, message, ADVICE[rule_id], evidence(total=total), rule_id),
            )
        )

    if "5.a" in ids:
        p = _params(params, "5.a")
        aggs.append(F.max("peak").alias("capacity_peak"))
        peak = F.col("capacity_peak")
        status = flt.band(peak, float(p["warn"]), float(p["crit"]), strict=True)
        message = (
            F.when(status == S.CRITICAL, msg("Resource use is critical: peak %s%%.", as_int_text(peak)))
            .when(status == S.WARNING, msg("Plan an expansion: peak use is %s%%.", as_int_text(peak)))
            .otherwise(msg("Resource use is healthy: peak %s%%.", as_int_text(peak)))
        )
        verdicts.append(
            (
                peak.isNotNull(),
                verdict(status, message, ADVICE["5.a"], evidence(peak=peak), "5.a"),
            )
        )
    return unpack(facts.groupBy(*keys).agg(*aggs), keys, *verdicts)


for _id, _name, _missing, _empty in [
    ("2.d", "Disk HWM Check", S.DATA_MISSING, "No disk use was reported for any namespace."),
    ("2.e", "Memory HWM Check", S.DATA_MISSING, "No memory use was reported for any namespace."),
    ("4.a", "Hot Key Detection", S.CRITICAL, "No 'key busy' events were counted."),
    ("4.b", "Read Not Found Rate", S.DATA_MISSING, "No 'read not found' events were counted."),
    ("4.c", "Delete Not Found Rate", S.DATA_MISSING, "No 'delete not found' events were counted."),
    ("5.a", "Cluster Capacity Forecast", S.CRITICAL, "No resource use was reported."),
]:
    rule(
        _id,
        _name,
        "namespace_stats",
        missing=(
            _missing,
            "Error: namespace statistics are absent."
            if _missing == S.CRITICAL
            else _NO_TABLE[1],
        ),
        empty=(S.PASS, _empty),
        group="namespace",
        tier="core",
    )(namespace_rules)


# --- 1.c, 2.a, 2.b, 2.c, 3.a, 3.b, 4.f: judged per entity first --------------------------------
#
# An entity row: keys, id, entity, label, rank (display order, descending), weight (what it counts
# for), flagged, broken (a value that should be an integer is not), score.


def _entity_row(
    rule_id: str,
    entity: Column,
    label: Column,
    flagged: Column,
    rank: Column | None = None,
    weight: Column | None = None,
    broken: Column | None = None,
    score: Column | None = None,
) -> Column:
    return F.struct(
        F.lit(rule_id).alias("id"),
        entity.cast("string").alias("entity"),
        label.alias("label"),
        (rank if rank is not None else F.lit(0)).cast("double").alias("rank"),
        (weight if weight is not None else F.lit(1)).cast("bigint").alias("weight"),
        F.coalesce(flagged, F.lit(False)).alias("flagged"),
        F.coalesce(broken if broken is not None else F.lit(False), F.lit(False)).alias("broken"),
        (score if score is not None else F.lit(None)).cast("double").alias("score"),
    )


def version_entities(tables: Tables, keys: Sequence[str]) -> DataFrame:
    """1.c: nodes per version; a node's version is its first version metric by name."""
    named = matching(tables, "node_stats", VERSION_PATTERNS)
    rows = tables["node_stats"].filter(named & F.col("value").isNotNull())
    per_node = rows.groupBy(*keys, "node_id").agg(
        F.min(F.struct("metric", "value")).getField("value").alias("version")
    )
    versions = per_node.groupBy(*keys, "version").agg(F.count(F.lit(1)).alias("n"))
    row = _entity_row(
        "1.c",
        F.col("version"),
        msg("%s (%s nodes)", "version", F.col("n").cast("string")),
        flagged=F.lit(True),
        rank=F.col("n"),
        weight=F.col("n"),
        score=F.col("n"),
    )
    return versions.select(*keys, row.alias("e")).select(*keys, "e.*")


def namespace_settings(
    node_configs: DataFrame, keys: Sequence[str], strict_names: bool = False
) -> DataFrame:
    """Storage settings per namespace, the five of them in one conditional aggregation.

    A setting's name is ``namespace.<ns>.<setting>`` with anything between; the namespace is the
    second segment and the setting the last one. ``strict_names`` reads a sibling value only from
    the shortest spelling.
    """
    # LIKE 'namespace.%.<setting>' for all settings at once: the first segment, the last one, and
    # at least one character's room for a segment between their dots.
    name = F.col("config_name")
    last = last_part("config_name")
    wanted = (
        (F.lower(F.substring(name, 1, 10)) == "namespace.")
        & F.lower(last).isin(NAMESPACE_SETTINGS)
        & (F.length(name) >= F.length(last) + 11)
    )
    rows = (
        node_configs.filter(wanted & F.col("value").isNotNull())
        .select(
            *keys,
            "node_id",
            "config_name",
            "value",
            dotted_part("config_name", 2).alias("ns"),
            F.lower(last_part("config_name")).alias("like_key"),
        )
        .withColumn(
            "exact_key",
            F.when(
                F.col("config_name") == F.concat(F.lit("namespace."), "ns", F.lit("."), "like_key"),
                F.col("like_key"),
            )
            if strict_names
            else last_part("config_name"),
        )
    )
    like_key, key, value = F.col("like_key"), F.col("exact_key"), F.col("value")
    flash = value == "flash"

    def first(setting: str) -> Column:
        ordered = F.struct("node_id", "config_name", "value")
        return F.min(F.when(key == setting, ordered)).getField("value")

    def any_row(cond: Column) -> Column:
        return F.coalesce(F.bool_or(cond), F.lit(False))

    index, sindex, sprigs, defrag, hwm = NAMESPACE_SETTINGS
    return rows.groupBy(*keys, "ns").agg(
        any_row(like_key.isin(index, sindex)).alias("has_index_rows"),
        any_row(like_key.isin(index, sindex) & flash).alias("index_flash"),
        any_row(key == sindex).alias("has_sindex"),
        any_row((key == sindex) & flash).alias("sindex_flash"),
        any_row(like_key.isin(index, sprigs)).alias("has_sprig_rows"),
        any_row(like_key.isin(index, sprigs) & flash).alias("sprig_flash"),
        first(sprigs).alias("sprigs"),
        any_row(like_key.isin(defrag, hwm)).alias("has_storage_rows"),
        first(defrag).alias("defrag"),
        first(hwm).alias("hwm"),
    )


def namespace_setting_entities(
    tables: Tables,
    keys: Sequence[str],
    ids: Sequence[str],
    params: Mapping | None,
    strict_names: bool,
) -> DataFrame:
    """2.a, 2.b, 2.c: one row per rule and namespace it concerns."""
    ns = namespace_settings(tables["node_configs"], keys, strict_names)
    pb, pc = _params(params, "2.b"), _params(params, "2.c")
    sprigs_text = F.coalesce("sprigs", F.lit(str(pb["default"])))
    sprigs = strict_int(sprigs_text)
    defrag_text = F.coalesce("defrag", F.lit(str(pc["default"])))
    hwm_text = F.coalesce("hwm", F.lit(str(pc["default"])))
    defrag, hwm = strict_int(defrag_text), strict_int(hwm_text)
    below_floor = defrag < int(pc["floor"])
    rows = {
        "2.a": lambda: (
            F.col("has_index_rows"),
            _entity_row(
                "2.a",
                F.col("ns"),
                F.col("ns"),
                F.col("index_flash") & F.col("has_sindex") & ~F.col("sindex_flash"),
            ),
        ),
        "2.b": lambda: (
            F.col("has_sprig_rows"),
            _entity_row(
                "2.b",
                F.col("ns"),
                msg("%s (%s sprigs)", "ns", sprigs_text),
                F.col("sprig_flash") & (sprigs <= int(pb["min_sprigs"])),
                broken=F.col("sprig_flash") & sprigs.isNull(),
                score=sprigs,
            ),
        ),
        "2.c": lambda: (
            F.col("has_storage_rows"),
            _entity_row(
                "2.c",
                F.col("ns"),
                msg("%s (defrag %s%%, high water %s%%)", "ns", defrag_text, hwm_text),
                below_floor | (defrag < hwm),
                broken=defrag.isNull() | (~below_floor & hwm.isNull()),
                score=defrag,
            ),
        ),
    }
    return unpack(ns, keys, *[rows[i]() for i in rows if i in ids])


def symmetry_entities(
    tables: Tables, keys: Sequence[str], ignore: Sequence[str], stat_patterns: Sequence[str]
) -> DataFrame:
    """3.a: settings with more than one value in a cluster. Names are dropped before the shuffle."""
    cfg = flt.drop_names(tables["node_configs"], "config_name", ignore)
    cfg = flt.drop_patterns(cfg, "config_name", stat_patterns)
    varied = distinct_drift(cfg, [*keys, "config_name"], "value")
    row = _entity_row(
        "3.a",
        F.col("config_name"),
        F.col("config_name"),
        F.lit(True),
        score=F.col("variations"),
    )
    return varied.select(*keys, row.alias("e")).select(*keys, "e.*")


def drift_entities(tables: Tables, keys: Sequence[str]) -> DataFrame:
    """3.b: settings whose running value differs from the static one."""
    on = [*keys, "node_id", "config_name"]
    drift = value_drift(tables["node_configs"], tables["static_configs"], on)
    per_name = drift.groupBy(*keys, "config_name").agg(F.count(F.lit(1)).alias("n"))
    row = _entity_row(
        "3.b",
        F.col("config_name"),
        F.col("config_name"),
        F.lit(True),
        weight=F.col("n"),
        score=F.col("n"),
    )
    return per_name.select(*keys, row.alias("e")).select(*keys, "e.*")


def set_entities(
    tables: Tables, keys: Sequence[str], min_avg: float, max_dev_pct: float
) -> DataFrame:
    """4.f: sets and how far their nodes deviate from the mean object count."""
    rows = tables["set_stats"].filter(F.col("key") == "objects")
    rows = rows.select(*keys, "ns", "set_name", number(rows).alias("objects"))
    judged = skew.deviation_skew(rows, [*keys, "ns", "set_name"], "objects", min_avg, max_dev_pct)
    name = F.concat_ws(":", "ns", "set_name")
    row = _entity_row(
        "4.f",
        name,
        msg("%s (%.1f%% skew)", name, F.coalesce("dev_pct", F.lit(0.0))),
        F.col("skewed"),
        score=F.col("dev_pct"),
    )
    return judged.select(*keys, row.alias("e")).select(*keys, "e.*")


ENTITY_RULE_TABLES = {
    "1.c": ["node_stats"],
    "2.a": ["node_configs"],
    "2.b": ["node_configs"],
    "2.c": ["node_configs"],
    "3.a": ["node_configs"],
    "3.b": ["node_configs", "static_configs"],
    "4.f": ["set_stats"],
}


def entities(
    tables: Tables,
    keys: Sequence[str],
    ids: Sequence[str],
    params: Mapping | None = None,
    strict_names: bool = False,
) -> DataFrame:
    """Entity rows of all wanted rules."""
    parts = []
    if "1.c" in ids:
        parts.append(version_entities(tables, keys))
    settings = [i for i in ("2.a", "2.b", "2.c") if i in ids]
    if settings:
        parts.append(
            namespace_setting_entities(tables, keys, settings, params, strict_names)
        )
    if "3.a" in ids:
        parts.append(symmetry_entities(tables, keys, **_params(params, "3.a")))
    if "3.b" in ids:
        parts.append(drift_entities(tables, keys))
    if "4.f" in ids:
        parts.append(set_entities(tables, keys, **_params(params, "4.f")))
    return union_results(*parts)


def _entity_verdict(rule_id: str) -> Column:
    """Verdict of an entity rule over its counts: n_seen, n_flagged, n_broken, total, names."""
    n, total, names = F.col("n_flagged"), F.col("total"), F.col("names")
    count = n.cast("string")
    broken = F.col("n_broken") > 0
    ev = evidence(
        n_findings="n_flagged",
        n_seen="n_seen",
        n_broken="n_broken",
        total="total",
        max_score="max_score",
    )

    def judge(found: Column, warn: Column, passed: Column, can_break=False) -> Column:
        status = F.when(found, F.lit(S.WARNING)).otherwise(F.lit(S.PASS))
        message = F.when(found, warn).otherwise(passed)
        if can_break:
            status = F.when(broken, F.lit(S.CRITICAL)).otherwise(status)
            message = F.when(
                broken,
                msg("Error: %s settings are not integers.", F.col("n_broken").cast("string")),
            ).otherwise(message)
        return verdict(status, message, ADVICE[rule_id], ev)

    verdicts = {
        "1.c": lambda: judge(
            n > 1,
            msg("Nodes run %s different versions: %s.", count, names),
            msg("All nodes run the same version: %s.", names),
        ),
        "2.a": lambda: judge(
            n > 0,
            msg("%s namespaces keep secondary indexes in memory, the primary on flash: %s.", count, names),
            F.lit("Secondary indexes are placed like the primary index."),
        ),
        "2.b": lambda: judge(
            n > 0,
            msg("%s namespaces with an index on flash have few sprigs: %s.", count, names),
            F.lit("Sprig counts fit the index storage."),
            can_break=True,
        ),
        "2.c": lambda: judge(
            n > 0,
            msg("%s namespaces may fill up before space is reclaimed: %s.", count, names),
            F.lit("Space is reclaimed before records are evicted."),
            can_break=True,
        ),
        "3.a": lambda: judge(
            n > 0,
            msg("%s settings differ between nodes: %s.", count, names),
            F.lit("All settings are the same on every node."),
        ),
        "3.b": lambda: judge(
            total > 0,
            msg("%s running settings differ from the static ones: %s.", total.cast("string"), names),
            F.lit("Running and static settings agree."),
        ),
        "4.f": lambda: judge(
            n > 0,
            msg("%s sets are unevenly spread over the nodes: %s.", count, names),
            F.lit("Sets are evenly spread over the nodes."),
        ),
    }
    return verdicts[rule_id]()


def entity_rules(
    tables: Tables,
    keys: Sequence[str] = S.KEYS,
    ids: Sequence[str] = tuple(ENTITY_RULE_TABLES),
    params: Mapping | None = None,
    strict_names: bool = False,
) -> DataFrame:
    """Counts and leading names of the flagged entities, then one verdict per key and rule.

    Counting is algebraic, and the names use a rank limit below the shuffle, so a cluster with
    millions of findings costs each task no more than a few rows.
    """
    rows = entities(tables, keys, ids, params, strict_names)
    by = [*keys, "id"]
    flagged = F.col("flagged")
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_seen"),
        F.count_if(flagged).alias("n_flagged"),
        F.count_if("broken").alias("n_broken"),
        F.sum(F.when(flagged, F.col("weight")).otherwise(F.lit(0))).alias("total"),
        F.max(F.when(flagged, F.col("score"))).alias("max_score"),
    )
    lead = lead_rows(
        rows.filter(flagged).select(*by, "entity", "label", "rank"),
        by,
        [F.col("rank").desc(), F.col("entity")],
        NAMES_CHARS // 3,  # a name and the text behind it have three characters at least
    ).filter((F.col("id") != "3.b") | (F.col("rn") <= DRIFT_NAMES_IN_MESSAGE))
    before = Window.partitionBy(*by).orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    size = F.sum(F.char_length("label") + 2).over(before)
    lead = lead.withColumn("before", F.coalesce(size, F.lit(0))).filter(F.col("before") < NAMES_CHARS)
    texts = lead.groupBy(*by).agg(
        F.array_join(
            F.array_sort(F.collect_list(F.struct("rn", "label"))).getField("label"), ", "
        ).alias("names")
    )
    joined = counts.join(texts, on=by, how="left")
    v = None
    for rule_id in ids:
        cond, judged = F.col("id") == rule_id, _entity_verdict(rule_id)
        v = F.when(cond, judged) if v is None else v.when(cond, judged)
    return joined.select(*by, v.alias("v")).select(*by, "v.*")


for _id, _name, _table, _missing, _empty in [
    (
        "1.c",
        "Version Consistency",
        "node_stats",
        (S.CRITICAL, "Error: node statistics are absent, so versions are unknown."),
        (S.DATA_MISSING, "No node reported a version."),
    ),
    ("2.a", "SIndex on Flash", "node_configs", _NO_TABLE, (S.PASS, "No index type is configured.")),
    ("2.b", "Sprig Limit Warning", "node_configs", _NO_TABLE, (S.PASS, "No sprigs are configured.")),
    (
        "2.c",
        "Storage Deadlock Risk",
        "node_configs",
        _NO_TABLE,
        (S.PASS, "No namespace has storage marks."),
    ),
    (
        "3.a",
        "Config Symmetry",
        "node_configs",
        _NO_TABLE,
        (S.PASS, "All settings are the same on every node."),
    ),
    (
        "3.b",
        "Config Drift",
        "static_configs",
        (S.DATA_MISSING, "No static configuration was supplied."),
        (S.PASS, "Running and static settings agree."),
    ),
    (
        "4.f",
        "Set Object Skew",
        "set_stats",
        (S.SCHEMA_MISMATCH, "Set statistics are absent."),
        (S.PASS, "No object counts were reported for sets."),
    ),
]:
    rule(_id, _name, _table, missing=_missing, empty=_empty, group="entity", tier="core")(
        entity_rules
    )


# --- 6.a: connection monopoly ------------------------------------------------------------------


@rule(
    "6.a",
    "Security Connection Audit",
    "security_stats",
    missing=(S.DATA_MISSING, "No user telemetry was collected."),
    empty=(S.PASS, "No client connections were reported."),
    tier="core",
)
def connection_audit(
    tables: Tables,
    keys: Sequence[str] = S.KEYS,
    max_pct: int = 80,
    min_conns: int = 100,
    strict_names: bool = False,
) -> DataFrame:
    top = skew.share_monopoly(
        tables["security_stats"], keys, "user", "connections", max_pct, min_conns
    )
    idle = F.col("total") == 0
    status = F.when(idle, F.lit(S.PASS)).otherwise(F.col("status"))
    user, pct = F.col("top_entity"), F.col("top_pct").cast("string")
    message = (
        F.when(idle, F.lit("No client connections were reported."))
        .when(
            status == S.WARNING,
            msg(
                "User %s holds %s%% of all connections (%s).",
                user,
                pct,
                F.col("top_amount").cast("string"),
            ),
        )
        .otherwise(msg("Connections are spread well: user %s leads with %s%%.", user, pct))
    )
    ev = evidence(total="total", top_amount="top_amount", top_pct="top_pct", n_users="n_entities")
    v = verdict(status, message, ADVICE["6.a"], ev)
    return top.select(*keys, v.alias("v")).select(*keys, "v.*")


#: Registered order of the listed rules.
RULE_ORDER = [
    "1.a",
    "1.c",
    "1.b",
    "2.c",
    "2.a",
    "2.b",
    "2.d",
    "2.e",
    "3.a",
    "3.b",
    "4.a",
    "4.b",
    "4.c",
    "4.f",
    "5.a",
    "6.a",
]
