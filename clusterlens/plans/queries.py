"""Driver queries: every operator, rule and dataset over lens views of the provided tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens import rules
from clusterlens.plans.lens import lens

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
C = ["cluster_id"]


def query(name: str):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return register


# --- lens tables ---------------------------------------------------------------------------------


def node_stats(spark, d):
    return lens(spark, d, "lens_node_stats")


def security(spark, d):
    return lens(spark, d, "lens_sec").withColumnRenamed("usr", "user")


def drivers(spark, d):
    rows = lens(spark, d, "lens_driver")
    info = rows.select("cluster_id", "node_id", "metric", "value")
    meta = rows.select(
        "cluster_id", F.lit("cloud_platform").alias("key"), F.col("cloud_platform").alias("value")
    ).distinct()
    return info, meta


def lens_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """All lens views together as the telemetry tables of one fleet."""
    info, meta = drivers(spark, d)
    return {
        "node_stats": node_stats(spark, d).unionByName(lens(spark, d, "lens_ver")),
        "namespace_stats": lens(spark, d, "lens_ns").unionByName(
            lens(spark, d, "lens_ns_counters")
        ),
        "set_stats": lens(spark, d, "lens_sets"),
        "security_stats": security(spark, d),
        "node_configs": lens(spark, d, "lens_cfg").drop("ord"),
        "static_configs": lens(spark, d, "lens_static"),
        "system_info": info,
        "cluster_metadata": meta,
    }


# --- rules ---------------------------------------------------------------------------------------


def _verdict(results: DataFrame, keys: Sequence[str], evidence: Sequence[str], message=True):
    cols = [*keys, "id", "status"] + (["message"] if message else [])
    return results.select(*cols, *[F.col("evidence")[e].alias(e) for e in evidence])


RULE_QUERIES: dict[str, tuple[str, dict[str, str], list[str], bool]] = {
    "r1a_error_skew": ("1.a", {"node_stats": "lens_node_stats"}, ["total", "mean", "peak"], True),
    "r1a2_proxy_skew": ("1.a2", {"node_stats": "lens_node_stats"}, ["total", "mean", "peak"], True),
    "r1c_version_consistency": ("1.c", {"node_stats": "lens_ver"}, ["n_findings", "total"], True),
    "r2a_sindex_flash": ("2.a", {"node_configs": "lens_cfg"}, ["n_findings", "n_seen"], True),
    "r2b_sprigs": ("2.b", {"node_configs": "lens_cfg"}, ["n_findings", "n_seen"], True),
    "r2c_deadlock": ("2.c", {"node_configs": "lens_cfg"}, ["n_findings", "n_seen"], True),
    "r2d_disk_hwm": ("2.d", {"namespace_stats": "lens_ns"}, ["peak"], True),
    "r2e_memory_hwm": ("2.e", {"namespace_stats": "lens_ns"}, ["peak"], True),
    "r3a_symmetry": ("3.a", {"node_configs": "lens_cfg"}, ["n_findings", "max_score"], True),
    "r3b_config_drift": (
        "3.b",
        {"node_configs": "lens_live", "static_configs": "lens_static"},
        ["total", "n_findings"],
        True,
    ),
    "r4a_hot_key": ("4.a", {"namespace_stats": "lens_ns_counters"}, ["total"], True),
    "r4b_read_miss": ("4.b", {"namespace_stats": "lens_ns_counters"}, ["total"], True),
    "r4c_delete_miss": ("4.c", {"namespace_stats": "lens_ns_counters"}, ["total"], True),
    "r4f_set_skew": ("4.f", {"set_stats": "lens_sets"}, ["n_findings", "max_score"], True),
    "r5a_capacity": ("5.a", {"namespace_stats": "lens_ns"}, ["peak"], True),
}


def _rule_query(rule_id, lenses, evidence, message) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        tables = {t: lens(spark, d, v) for t, v in lenses.items()}
        return _verdict(rules.run_rule(tables, rule_id, C), C, evidence, message)

    return run


for _name, _spec in RULE_QUERIES.items():
    QUERIES[_name] = _rule_query(*_spec)


@query("r1b_network")
def r1b_network(spark, d):
    info, meta = drivers(spark, d)
    tables = {"system_info": info, "cluster_metadata": meta}
    return _verdict(rules.run_rule(tables, "1.b", C), C, ["driver_rows", "fast_rows"])


@query("r6a_connections")
def r6a_connections(spark, d):
    results = rules.run_rule({"security_stats": security(spark, d)}, "6.a", C)
    return _verdict(results, C, ["total", "top_amount", "top_pct"])
