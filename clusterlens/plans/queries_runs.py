"""Queries of stored runs: series over several runs, plug-ins, extracted documents, the stored report."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens import rules, sources
from clusterlens import schema as S
from clusterlens.extract import EXTRACTORS
from clusterlens.extract.registry import extractor
from clusterlens.plans import pipeline
from clusterlens.plans.lens import lens
from clusterlens.plans.queries import C
from clusterlens.plans.queries_fleet import _FLEET_SOURCES, RULE_SQL, run_all_sql
from clusterlens.plans.queries_operators import query
from clusterlens.plans.queries_telemetry import DAY_SQL, day, documents
from clusterlens.rules import series
from clusterlens.rules.metrics import metric_sketches
from clusterlens.rules.registry import REGISTRY, evidence, rule

RUNS = ["r1", "r2", "r3"]


# --- series over runs ------------------------------------------------------------------------------


def _run_tables(spark: SparkSession, d: str, run: str) -> dict[str, DataFrame]:
    """Namespace statistics of one run: disk use in percent, and a counter of key busy events."""
    rows = lens(spark, d, "lens_runs").filter(F.col("run_id") == run)
    both = F.inline(
        F.array(
            F.struct(F.lit("service.data_used_pct").alias("metric"), F.col("used_pct").alias("value")),
            F.struct(F.lit("service.fail_key_busy").alias("metric"), F.col("busy").alias("value")),
        )
    )
    time = F.col("d").cast("timestamp").alias("snapshot_ts")
    return {
        "namespace_stats": rows.select(
            "run_id", time, "cluster_id", "node_id", F.lit("ns").alias("namespace"), both
        )
    }


def over_runs(spark: SparkSession, d: str, rule_id: str) -> DataFrame:
    """A rule judged run after run: each reads its own rows and the series that the one before has left."""
    out, before = None, None
    for run in RUNS:
        tables = _run_tables(spark, d, run)
        if before is not None:
            tables["series"] = before
        results = rules.run_rule(tables, rule_id)
        out = results if out is None else out.unionByName(results)
        before = sources.staged(series.advance(tables, run), "series")
    return out


@query(
    "c4a_over_runs",
    """WITH s AS (SELECT *, (busy - lag(busy) OVER w) / (epoch(d) - epoch(lag(d) OVER w)) AS rate
                  FROM lens_runs WINDOW w AS (PARTITION BY cluster_id, node_id ORDER BY d))
       SELECT run_id, cluster_id, datediff('day', date '1970-01-01', d) AS day,
              CASE WHEN count(rate) = 0 THEN 'DATA MISSING' WHEN count(*) FILTER (rate > 100) > 0 THEN 'WARNING'
                   ELSE 'PASS' END AS status,
              CASE WHEN count(rate) > 0 THEN CAST(count(rate) AS DOUBLE) END AS n_rows,
              CASE WHEN count(rate) > 0 THEN CAST(count(*) FILTER (rate > 100) AS DOUBLE) END AS n_breach,
              max(rate) AS extreme
       FROM s GROUP BY ALL""",
)
def c4a_over_runs(spark, d):
    results = over_runs(spark, d, "C-4a")
    shown = [F.col("evidence")[e].alias(e) for e in ("n_rows", "n_breach", "extreme")]
    return results.select("run_id", "cluster_id", day(), "status", *shown)


@query(
    "c5a_over_runs",
    """WITH now AS (SELECT run_id, cluster_id, node_id, max(d) AS last FROM lens_runs GROUP BY ALL),
       f AS (SELECT n.run_id, n.cluster_id, n.last, count(*) AS n_points,
                    regr_slope(used_pct, datediff('day', date '2024-01-01', d)) AS slope,
                    regr_intercept(used_pct, datediff('day', date '2024-01-01', d)) AS icept
             FROM now n JOIN lens_runs r
               ON r.cluster_id = n.cluster_id AND r.node_id = n.node_id AND r.d <= n.last
             GROUP BY n.run_id, n.cluster_id, n.node_id, n.last),
       x AS (SELECT *, CASE WHEN n_points >= 3 AND slope > 0
                  THEN (60.0 - (slope * datediff('day', date '2024-01-01', last) + icept)) / slope END AS left_
             FROM f)
       SELECT run_id, cluster_id, datediff('day', date '1970-01-01', max(last)) AS day,
              CASE WHEN max(n_points) < 3 THEN 'DATA MISSING' WHEN min(left_) < 30 THEN 'WARNING' ELSE 'PASS'
                END AS status,
              CAST(max(n_points) AS DOUBLE) AS n_points, round(min(left_), 3) AS days_left
       FROM x GROUP BY run_id, cluster_id""",
)
def c5a_over_runs(spark, d):
    results = over_runs(spark, d, "C-5a").filter(F.col("evidence")["n_points"].isNotNull())
    return results.select(
        "run_id", "cluster_id", day(), "status", F.col("evidence")["n_points"].alias("n_points"),
        F.round(F.col("evidence")["days_left"], 3).alias("days_left"),
    )


def _sketches_over_runs(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of disk use, made run by run and merged over the runs of a cluster."""
    out = None
    for run in RUNS:
        made = metric_sketches(_run_tables(spark, d, run), S.KEYS, ["data_used_pct"])
        out = made if out is None else out.unionByName(made)
    return out


@query(
    "c4e_over_runs",
    """SELECT cluster_id, CASE WHEN quantile_disc(used_pct, 0.9) > 10 THEN 'WARNING' ELSE 'PASS' END AS status,
              CAST(quantile_disc(used_pct, 0.9) AS DOUBLE) AS extreme
       FROM lens_runs GROUP BY cluster_id""",
)
def c4e_over_runs(spark, d):
    """Latency rule on merged sketches; with as many readings as a sketch holds, they are exact."""
    sketches = sources.staged(_sketches_over_runs(spark, d), "sketches")
    tables = {"namespace_stats": lens(spark, d, "lens_runs"), "sketches": sketches}
    results = rules.run_rule(tables, "C-4e", C, metric="data_used_pct", max_latency=10.0, quantile=0.9)
    return results.select(*C, "status", F.col("evidence")["extreme"].alias("extreme"))


# --- plug-ins --------------------------------------------------------------------------------------


@query(
    "u1_rule_plugins",
    f"""SELECT cluster_id, 'x.1' AS id, 'CRITICAL' AS status, 'Error: DIVIDE_BY_ZERO' AS message FROM lens_ns GROUP BY ALL
        UNION ALL
        SELECT cluster_id, 'x.2', CASE WHEN max(value) > 90 THEN 'WARNING' ELSE 'PASS' END,
               CAST(count(*) AS VARCHAR) || ' rows' FROM lens_ns GROUP BY cluster_id
        UNION ALL
        SELECT cluster_id, id, status, message FROM ({RULE_SQL["2.d"].replace("{namespace_stats}", "lens_ns")})""",
)
def u1(spark, d):
    """Two own rules beside a listed one; an expression of the first fails on a single row."""
    try:

        @rule("x.1", "Fails on a row", "namespace_stats")
        def broken(tables, keys):
            rows = tables["namespace_stats"]
            least = rows.agg(F.min("value").alias("least"))  # dividing by zero, on the row that holds it
            odd = rows.join(least).withColumn("y", F.lit(1) / (F.col("value") - F.col("least")))
            return odd.groupBy(*keys).agg(F.lit(S.PASS).alias("status"), F.max("y").cast("string").alias("message"))

        @rule("x.2", "Works", "namespace_stats")
        def works(tables, keys):
            rows = tables["namespace_stats"].groupBy(*keys).agg(F.max("value").alias("top"), F.count("*").alias("n"))
            status = F.when(F.col("top") > 90, F.lit(S.WARNING)).otherwise(F.lit(S.PASS))
            message = F.concat(F.col("n").cast("string"), F.lit(" rows"))
            return rows.select(*keys, status.alias("status"), message.alias("message"), evidence(n="n").alias("evidence"))

        tables = {"namespace_stats": lens(spark, d, "lens_ns")}
        results = rules.run_all(tables, ["2.d", "x.1", "x.2"], C)
    finally:
        REGISTRY.pop("x.1", None)
        REGISTRY.pop("x.2", None)
    return results.select(*C, "id", "status", "message")


def _store(spark: SparkSession) -> str:
    return f"{sources.shared_folder(spark)}/store-{uuid.uuid4().hex}"


@query(
    "u2_extractor_plugins",
    f"""SELECT 'own_ports' AS table_name, cluster_id, {DAY_SQL} AS day, count(*) AS n,
               CAST(sum(CAST(payload ->> '$.as_stat.config.network.service.tls-port' AS BIGINT)) AS BIGINT) AS total
        FROM lens_nodes GROUP BY ALL
        UNION ALL
        SELECT 'system_info', cluster_id, {DAY_SQL}, 3 * count(*), NULL FROM lens_nodes GROUP BY ALL""",
)
def u2(spark, d):
    """Two own extractors beside a listed one, stored and read again; an expression of the first fails on
    some rows, and its table is empty."""
    try:

        @extractor("own_broken")
        def broken(nodes):
            text = F.try_variant_get("payload", "$.sys_stat.host", "string")
            return nodes.select(*S.KEYS, "node_id", F.expr("1").alias("one"), text.cast("bigint").alias("n"))

        @extractor("own_ports")
        def ports(nodes):
            n = F.try_variant_get("payload", "$.as_stat.config.network.service['tls-port']", "bigint")
            return nodes.select(*S.KEYS, "node_id", n.alias("n"))

        store = _store(spark)
        wanted = {t: EXTRACTORS[t] for t in ("system_info", "own_broken", "own_ports")}
        pipeline.ingest_documents(documents(spark, d), store, "r1", wanted)
    finally:
        EXTRACTORS.pop("own_broken", None)
        EXTRACTORS.pop("own_ports", None)
    stored = sources.read_parquet_tables(spark, store, ["r1"], list(wanted))
    out = None
    for name, df in stored.items():
        total = F.sum("n") if name == "own_ports" else F.lit(None)
        part = df.groupBy("cluster_id", day()).agg(F.count("*").alias("n"), total.cast("bigint").alias("total"))
        part = part.select(F.lit(name).alias("table_name"), "cluster_id", "day", "n", "total")
        out = part if out is None else out.unionByName(part)
    return out


# --- extracted documents, and the report as a stored job ---------------------------------------------


#: Folders that written documents are dealt to; one folder of them all could not be listed in parallel.
FOLDERS = 1024


def _local_path(spark: SparkSession, folder: str) -> str | None:
    """The folder's path if it lies in the (shared) file system of the machines, else null."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def write_documents(docs: DataFrame, folder: str) -> None:
    """Documents (doc_id, json) as files below ``folder``, one for each id, with a line for each of its rows.

    A folder for each document would be moved and listed one by one by the driver. On a plain file system Hadoop
    starts two processes for each file, to set permissions, so the tasks write there themselves.
    """
    line = F.coalesce("json", F.lit(""))
    texts = docs.groupBy("doc_id").agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDERS))
    path = _local_path(docs.sparkSession, folder)
    if path is None:
        files = texts.select((F.spark_partition_id() * FOLDERS + place).alias("folder"), "text")
        files.write.partitionBy("folder").option("maxRecordsPerFile", 1).text(folder)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                number, name, text = (v.as_py() for v in row)
                own = f"{path}/folder={number}"
                os.makedirs(own, exist_ok=True)
                with open(f"{own}/{name}.txt", "wb") as f:
                    f.write(text.encode() + b"\n")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    os.makedirs(path, exist_ok=True)  # a folder without documents can be read as well
    texts.select(place, F.col("doc_id").cast("string"), "text").mapInArrow(write, "n long").agg(F.sum("n")).collect()


@query(
    "s5_read_json",
    f"SELECT cluster_id, node_id, {DAY_SQL} AS day, c_custkey % 900 AS connections FROM lens_nodes",
)
def s5(spark, d):
    """Documents written as files, one each, and read as already extracted telemetry."""
    folder = _store(spark)
    write_documents(lens(spark, d, "lens_docs").select("doc_id", "json"), folder)
    nodes = sources.explode_snapshots(sources.read_telemetry_json(spark, folder), "r1")
    number = F.try_variant_get("payload", "$.as_stat.statistics.service.client_connections", "bigint")
    return nodes.select("cluster_id", "node_id", day(), number.alias("connections"))


_REPORT_SQL = f"""
    WITH n AS (SELECT cluster_id || '@' || {DAY_SQL} AS k, cluster_id, {DAY_SQL} AS day, node_id FROM lens_nodes),
    res AS (SELECT x.cluster_id AS k, x.id, x.status FROM ({run_all_sql(_FLEET_SOURCES)}) x),
    per AS (SELECT k, cluster_id, day, count(*) AS nodes FROM n GROUP BY ALL)
    SELECT cluster_id, day, 'report_appendix' AS dataset, CAST(16 AS BIGINT) AS n FROM per
    UNION ALL SELECT cluster_id, day, t, 1 FROM per, (SELECT unnest(['report_context', 'report_assessment',
      'report_vitals', 'report_narrative']) AS t)
    UNION ALL SELECT cluster_id, day, 'report_connections', nodes FROM per
    UNION ALL SELECT cluster_id, day, 'report_hot_keys', nodes FROM per
    UNION ALL SELECT cluster_id, day, 'report_disk_usage', 2 * nodes FROM per
    UNION ALL SELECT cluster_id, day, 'report_issues', count(*) FROM res JOIN per USING (k)
      WHERE status <> 'PASS' GROUP BY ALL"""


@query("stored_report", _REPORT_SQL)
def stored_report(spark, d):
    """Documents to a stored run, to stored verdicts, to the stored datasets of the report."""
    store = _store(spark)
    pipeline.ingest_documents(documents(spark, d), store, "r1")
    pipeline.analyze(spark, store, "r1")
    pipeline.report_run(spark, store, "r1")
    out = None
    for name, df in sources.read_parquet_tables(spark, store, ["r1"], REPORT).items():
        part = df.groupBy("cluster_id", day()).agg(F.count("*").alias("n"))
        part = part.select("cluster_id", "day", F.lit(name).alias("dataset"), "n")
        out = part if out is None else out.unionByName(part)
    return out


REPORT = [
    "report_context", "report_assessment", "report_vitals", "report_narrative", "report_issues",
    "report_appendix", "report_disk_usage", "report_connections", "report_hot_keys",
]

