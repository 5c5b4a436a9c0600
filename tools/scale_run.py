"""Synthetic fleet with one hot cluster: how long does the ruleset take, and who is slow?

    python tools/scale_run.py OUT_DIR [clusters] [hot_nodes]

The fleet is made with spark.range and stored like an ingested run, then judged.
"""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from clusterlens.plans.pipeline import write_coverage  # noqa: E402
from clusterlens.rules import run_all  # noqa: E402
from clusterlens.sources import read_parquet_tables, write_tables  # noqa: E402

NODES = 10


def fleet_nodes(spark: SparkSession, clusters: int, hot: int) -> DataFrame:
    """Node number to cluster: cluster 0 holds ``hot`` nodes, the others ten each."""
    n = spark.range(0, hot + clusters * NODES, 1, 64)
    i = F.col("id")
    cluster = F.when(i < hot, F.lit(0)).otherwise(F.floor((i - hot) / NODES) + 1)
    return n.select(
        F.lit("r1").alias("run_id"),
        F.lit("2024-01-01").cast("timestamp").alias("snapshot_ts"),
        F.concat(F.lit("c"), cluster).alias("cluster_id"),
        F.concat(F.lit("n"), i).alias("node_id"),
        i.alias("i"),
    )


def per_node(nodes: DataFrame, n: int) -> DataFrame:
    return nodes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def make(spark: SparkSession, clusters: int, hot: int) -> dict[str, DataFrame]:
    nodes = fleet_nodes(spark, clusters, hot)
    base = ["run_id", "snapshot_ts", "cluster_id", "node_id"]
    k, i = F.col("k"), F.col("i")
    text = F.pmod(F.xxhash64("i", "k"), F.lit(100000)).cast("string")
    stats = per_node(nodes, 500).select(
        *base,
        F.when(k == 0, "as_stat.meta_data.asd_build")
        .when(k == 1, "as_stat.statistics.service.service_error")
        .when(k == 2, "as_stat.statistics.service.client_proxy_error")
        .otherwise(F.concat(F.lit("as_stat.statistics.service.metric_"), k))
        .alias("metric"),
        F.when(k == 0, F.concat(F.lit("E-7.2.0."), i % 2)).otherwise(text).alias("value"),
        F.lit("BIGINT").alias("value_type"),
    )
    names = ["data_used_pct", "memory_used_pct", "fail_key_busy", "client_read_not_found",
             "client_delete_not_found"]
    metric = F.concat(F.lit("service.metric_"), (k / 2).cast("int"))
    for j, name in enumerate(names):
        metric = F.when((k / 2).cast("int") == j, F.lit(f"service.{name}")).otherwise(metric)
    ns = per_node(nodes, 80).select(
        *base,
        F.concat(F.lit("ns"), k % 2).alias("namespace"),
        metric.alias("metric"),
        F.pmod(F.xxhash64("i", "k"), F.lit(90)).cast("double").alias("value"),
        F.lit("statistics").alias("source"),
    )
    settings = ["index-type", "sindex-type", "partition-tree-sprigs", "defrag-lwm-free-pct",
                "high-water-disk-pct"]
    name = F.concat(F.lit("service.setting_"), k)
    value = F.when(k % 7 == 0, (i % 3).cast("string")).otherwise(F.lit("x"))
    for j, s in enumerate(settings):
        name = F.when(k == j, F.lit(f"namespace.ns0.service.{s}")).otherwise(name)
        value = F.when(k == j, F.lit("flash" if j == 0 else "50")).otherwise(value)
    cfg = per_node(nodes, 100).select(
        *base, name.alias("config_name"), value.alias("value"), F.lit("config").alias("source")
    )
    sets = per_node(nodes, 20).select(
        *base,
        F.lit("ns0").alias("ns"),
        F.concat(F.lit("s"), (k / 2).cast("int")).alias("set_name"),
        F.when(k % 2 == 0, "objects").otherwise("tombstones").alias("key"),
        (F.lit(5000) + i % 900).cast("string").alias("value"),
    )
    users = per_node(nodes, 20).select(
        *base, F.concat(F.lit("u"), k).alias("user"), (i % 50).alias("connections")
    )
    info = per_node(nodes, 10).select(
        *base,
        F.when(k == 0, "network_driver").otherwise(F.concat(F.lit("m"), k)).alias("metric"),
        F.when(i % 2 == 0, "ena").otherwise("virtio").alias("value"),
    )
    meta = nodes.select("run_id", "snapshot_ts", "cluster_id").distinct().select(
        "*",
        F.lit("cloud_platform").alias("key"),
        F.lit("AWS").alias("value"),
        F.lit(1).cast("bigint").alias("n_values"),
    )
    return {
        "node_stats": stats,
        "namespace_stats": ns,
        "node_configs": cfg,
        "set_stats": sets,
        "security_stats": users,
        "system_info": info,
        "cluster_metadata": meta,
    }


def main(argv: list[str]) -> None:
    out = argv[0]
    clusters = int(argv[1]) if len(argv) > 1 else 2000
    hot = int(argv[2]) if len(argv) > 2 else clusters * NODES // 2
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "32")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not os.path.exists(f"{out}/coverage"):
        t = time.time()
        write_tables(make(spark, clusters, hot), out, "r1")
        write_coverage(spark, out, "r1")
        print(f"made and stored in {time.time() - t:.1f}s", flush=True)
    tables = read_parquet_tables(spark, out, ["r1"])
    for name, df in tables.items():
        print(name, df.count(), flush=True)
    for ids in (None, None, ["1.a"], ["1.c"], ["2.d"], ["5.a"], ["2.b"], ["3.a"], ["4.f"], ["6.a"], ["1.b"]):
        t = time.time()
        n = run_all(tables, ids).groupBy("status").count().collect()
        print(ids or "all", f"{time.time() - t:.1f}s", dict(map(tuple, n)), flush=True)
    t = time.time()
    no_coverage = {k: v for k, v in tables.items() if k != "coverage"}
    run_all(no_coverage).groupBy("status").count().collect()
    print("all, no coverage", f"{time.time() - t:.1f}s", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
