"""Queries of sources and extractors, over documents and archives that Spark makes from the tables."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens import sources
from clusterlens.extract import EXTRACTORS, metadata, run_extractors, tables
from clusterlens.extract.features import detect_features
from clusterlens.plans.lens import SNAPSHOTS, lens
from clusterlens.plans.queries_operators import query
from clusterlens.rules import run_rule
from clusterlens.sources.bundles import BATCH_BYTES

RUN = "r1"
CD = ["cluster_id", "day"]

# Day number of the two snapshots, on both sides.
DAY_SQL = f"CASE snapshot WHEN '{SNAPSHOTS[0]}' THEN 19723 ELSE 19724 END"


def day() -> Column:
    return F.floor(F.unix_micros("snapshot_ts") / F.lit(86400e6)).cast("int").alias("day")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return lens(spark, d, "lens_docs").select(
        F.concat(F.lit("b"), F.col("doc_id")).alias("bundle"),
        F.lit("ascinfo.json").alias("member"),
        F.length("json").cast("bigint").alias("size"),
        "json",
        F.lit(None).cast("string").alias("error"),
    )


def exploded(spark: SparkSession, d: str) -> DataFrame:
    return sources.explode_snapshots(documents(spark, d), RUN)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of all documents. Each is in one document, so no duplicates need to be dropped."""
    return exploded(spark, d).filter(F.col("error").isNull())


# --- archives --------------------------------------------------------------------------------------


def archives(spark: SparkSession, d: str) -> DataFrame:
    """One archive per document: telemetry plain, gzipped or zipped, a decoy, settings and logs."""

    def batch_of(part: list[tuple]) -> pa.RecordBatch:
        names, contents = zip(*part, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["bundle", "content"]
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, size = [], 0
            for doc_id, text in zip(batch.column("doc_id"), batch.column("json"), strict=True):
                n, data = doc_id.as_py(), text.as_py().encode()
                name = f"{n}/ascinfo.json"
                if n % 3 == 1:
                    name, data = name + ".gz", gzip.compress(data, mtime=0)
                elif n % 3 == 2:
                    inner = io.BytesIO()
                    with zipfile.ZipFile(inner, "w") as z:
                        z.writestr("ascinfo.json", data)
                    name, data = name + ".zip", inner.getvalue()
                members = [("manifest.json", b" " * 20_000), ("empty.json", b"{}")]
                if n % 7 != 0:
                    members.append((name, data))
                else:
                    members = members[:1]
                members += [(f"n{i}.conf", b"x") for i in range(n % 3)]
                members += [("server.log", b"x")] * (n % 2)
                out = io.BytesIO()
                with tarfile.open(fileobj=out, mode="w") as tar:
                    for member, body in members:
                        info = tarfile.TarInfo(member)
                        info.size = len(body)
                        tar.addfile(info, io.BytesIO(body))
                part.append((f"b{n}", out.getvalue()))
                size += len(part[-1][1])
                if size >= BATCH_BYTES:
                    yield batch_of(part)
                    part, size = [], 0
            if part:
                yield batch_of(part)

    docs = lens(spark, d, "lens_docs").select("doc_id", "json")
    return docs.mapInArrow(pack, "bundle string, content binary")


@query(
    "s1_list_members",
    """SELECT 'b' || c_custkey AS bundle,
              CAST(1 + CASE WHEN c_custkey % 7 <> 0 THEN 2 ELSE 0 END + c_custkey % 3 + c_custkey % 2
                   AS BIGINT) AS members,
              CAST(c_custkey % 3 + c_custkey % 2 + 20000 AS BIGINT) AS known_bytes
       FROM customer""",
)
def s1(spark, d):
    listed = sources.list_members(archives(spark, d))
    known = ~F.col("member").contains("ascinfo") & (F.col("member") != "empty.json")
    return listed.groupBy("bundle").agg(
        F.count("member").alias("members"),
        F.sum(F.when(known, F.col("size"))).alias("known_bytes"),
    )


@query(
    "s2_pick_telemetry",
    """SELECT 'b' || c_custkey AS bundle, CAST(2 AS BIGINT) AS ord,
              c_custkey || '/ascinfo.json' || CASE c_custkey % 3 WHEN 1 THEN '.gz' WHEN 2 THEN '.zip'
                ELSE '' END AS member
       FROM customer WHERE c_custkey % 7 <> 0""",
)
def s2(spark, d):
    picked = sources.pick_telemetry(sources.list_members(archives(spark, d)))
    return picked.select("bundle", "ord", "member")


@query(
    "s3_decode_members",
    """SELECT 'b' || doc_id AS bundle, CASE WHEN doc_id % 7 <> 0 THEN md5(json) END AS digest,
              CASE WHEN doc_id % 7 = 0 THEN 'no telemetry member' END AS error
       FROM lens_docs""",
)
def s3(spark, d):
    docs = sources.telemetry_documents(archives(spark, d))
    return docs.select("bundle", F.md5("json").alias("digest"), "error")


@query(
    "s4_explode_snapshots",
    f"""SELECT '{RUN}' AS run_id, {DAY_SQL} AS day, cluster_id, node_id, snapshot, md5(payload ->>
          '$.as_stat.config.network.service.address') AS address
        FROM lens_nodes""",
)
def s4(spark, d):
    address = F.try_variant_get("payload", "$.as_stat.config.network.service.address", "string")
    return exploded(spark, d).select(
        "run_id", day(), "cluster_id", "node_id", "snapshot", F.md5(address).alias("address")
    )


@query(
    "s6_store_runs",
    f"""SELECT 'first' AS run_id, cluster_id, {DAY_SQL} AS day, CAST(count(*) AS BIGINT) AS n
        FROM lens_nodes GROUP BY ALL
        UNION ALL
        SELECT 'second', cluster_id, {DAY_SQL}, CAST(2 * count(*) AS BIGINT)
        FROM lens_nodes WHERE snapshot = '{SNAPSHOTS[0]}' GROUP BY ALL""",
)
def s6(spark, d):
    """Two runs written, the second one twice, and read back."""
    path = f"{sources.shared_folder(spark)}/s6-{spark.sparkContext.applicationId}"
    rows = sources.staged(tables.extract_system_info(nodes(spark, d)), "s6")
    hosts = rows.filter(F.col("metric") == "host")
    first = hosts.withColumn("run_id", F.lit("first"))
    second = rows.filter(F.col("metric") != "host").withColumn("run_id", F.lit("second"))
    sources.write_tables({"system_info": first}, path, "first")
    sources.write_tables({"system_info": second}, path, "second")
    early = second.filter(day_is_first())
    sources.write_tables({"system_info": early}, path, "second")
    stored = sources.read_parquet_tables(spark, path)["system_info"]
    return stored.groupBy("run_id", "cluster_id", day()).agg(F.count(F.lit(1)).alias("n"))


def day_is_first() -> Column:
    return F.col("snapshot_ts") == F.lit(SNAPSHOTS[0]).cast("timestamp")


@query(
    "s7_inventory",
    """SELECT 'b' || c_custkey AS bundle,
              CAST(CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT)
                AS telemetry,
              CAST(c_custkey % 3 AS BIGINT) AS configs, CAST(c_custkey % 2 AS BIGINT) AS logs,
              CAST(1 + CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END
                   ELSE 0 END AS BIGINT) AS other
       FROM customer""",
)
def s7(spark, d):
    return sources.bundle_inventory(sources.list_members(archives(spark, d)))


# A dotted name of a DuckDB JSON path, without array members.
_TREE = """
    SELECT n.cluster_id, n.node_id, n.snapshot, t.type,
           replace(substr(t.fullkey, 3), '"', '') AS path,
           CASE WHEN t.type <> 'NULL' THEN t.value ->> '$' END AS value, t.value AS raw
    FROM lens_nodes n, json_tree(n.payload{root}) t
    WHERE t.key IS NOT NULL AND NOT regexp_full_match(t.key, '[0-9]+')"""


@query(
    "s8_profile_structure",
    f"""WITH t AS ({_TREE.replace('{root}', '')})
        SELECT path, CASE WHEN type = 'OBJECT' THEN 'OBJECT' WHEN type = 'ARRAY' THEN 'ARRAY'
                 WHEN type = 'NULL' THEN 'VOID' WHEN type = 'VARCHAR' THEN 'STRING' ELSE 'BIGINT' END
                 AS type,
               CAST(max(CASE WHEN type = 'OBJECT' THEN len(json_keys(raw)) ELSE 0 END) AS INTEGER)
                 AS n_children,
               count(DISTINCT cluster_id || '/' || node_id) AS n_nodes
        FROM t GROUP BY ALL""",
)
def s8(spark, d):
    out = sources.profile_structure(nodes(spark, d))
    kind = F.when(F.col("type").startswith("ARRAY"), F.lit("ARRAY")).otherwise(F.col("type"))
    return out.groupBy("path", kind.alias("type")).agg(
        F.max("n_children").alias("n_children"), F.max("n_nodes").alias("n_nodes")
    )


@query(
    "s10_store_findings",
    """WITH p AS (SELECT cluster_id, max(value) AS peak FROM lens_ns
                  WHERE metric = 'service.data_used_pct' GROUP BY cluster_id)
       SELECT 'r1' AS run_id, cluster_id, '2.d' AS id, peak,
              CASE WHEN peak >= 75 THEN 'CRITICAL' WHEN peak >= 60 THEN 'WARNING' ELSE 'PASS' END
                AS status
       FROM p""",
)
def s10(spark, d):
    """Results written as JSON and read back."""
    path = f"{sources.shared_folder(spark)}/s10-{spark.sparkContext.applicationId}"
    ns = lens(spark, d, "lens_ns").select(
        F.lit(RUN).alias("run_id"),
        F.lit(SNAPSHOTS[0]).cast("timestamp").alias("snapshot_ts"),
        "cluster_id",
        "node_id",
        "namespace",
        "metric",
        "value",
    )
    sources.write_findings(run_rule({"namespace_stats": ns}, "2.d"), path, RUN, "json")
    return sources.read_results(spark, path, "json").select(
        "run_id", "cluster_id", "id", "status", F.col("evidence")["peak"].alias("peak")
    )


# --- extractors --------------------------------------------------------------------------------------


@query(
    "n1_flatten",
    """SELECT event_id, 'k' AS metric, regexp_extract(props, '[0-9]+') AS value FROM events""",
)
def n1(spark, d):
    rows = lens(spark, d, "events").select(
        F.lit(RUN).alias("run_id"),
        F.col("ts").cast("timestamp").alias("snapshot_ts"),
        F.lit("c").alias("cluster_id"),
        F.col("event_id").cast("string").alias("node_id"),
        F.try_parse_json("props").alias("payload"),
    )
    return tables.flatten_payload(rows).select(
        F.col("node_id").cast("bigint").alias("event_id"), "metric", "value"
    )


@query(
    "n1_node_stats",
    f"""WITH t AS ({_TREE.replace('{root}', '')})
        SELECT cluster_id, {DAY_SQL} AS day, path AS metric, count(*) AS n,
               count(DISTINCT value) AS n_values, min(value) AS lowest, max(value) AS highest
        FROM t WHERE type NOT IN ('OBJECT', 'NULL') GROUP BY ALL""",
)
def n1_payload(spark, d):
    rows = tables.extract_node_stats(nodes(spark, d))
    return rows.groupBy("cluster_id", day(), "metric").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("value").alias("n_values"),
        F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
    )


@query(
    "n2_configs",
    f"""WITH t AS ({_TREE.replace('{root}', ", '$.as_stat.config'")})
        SELECT cluster_id, {DAY_SQL} AS day, replace(path, 'as_stat.config.', '') AS config_name,
               count(*) AS n, count(DISTINCT coalesce(value, 'None')) AS n_values,
               min(coalesce(value, 'None')) AS lowest, max(coalesce(value, 'None')) AS highest,
               'config' AS source
        FROM t WHERE type <> 'OBJECT' GROUP BY ALL""",
)
def n2(spark, d):
    rows = tables.extract_configs(nodes(spark, d))
    return rows.groupBy("cluster_id", day(), "config_name", "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("value").alias("n_values"),
        F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
    )


_NS_STATS = f"""
    SELECT n.cluster_id, n.node_id, {DAY_SQL} AS day, s.key AS namespace,
           'service.' || m.key AS metric, CAST(m.value ->> '$' AS DOUBLE) AS value
    FROM lens_nodes n, json_each(n.payload, '$.as_stat.statistics.namespace') s,
         json_each(s.value, '$.service') m
    WHERE regexp_full_match(m.value ->> '$', '[0-9]+[.]?[0-9]*')"""


@query(
    "n3_namespace_stats",
    f"""SELECT cluster_id, day, namespace, metric, 'statistics' AS source, count(*) AS n,
               sum(value) AS total, min(value) AS lowest, max(value) AS highest
        FROM ({_NS_STATS}) GROUP BY ALL""",
)
def n3(spark, d):
    rows = tables.extract_namespace_stats(nodes(spark, d))
    return rows.groupBy("cluster_id", day(), "namespace", "metric", "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("value").alias("total"),
        F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
    )


@query(
    "n4_set_stats",
    f"""SELECT n.cluster_id, n.node_id, {DAY_SQL} AS day, s.key AS ns, t.key AS set_name, m.key AS key,
               m.value ->> '$' AS value
        FROM lens_nodes n, json_each(n.payload, '$.as_stat.statistics.set') s,
             json_each(s.value) t, json_each(t.value) m""",
)
def n4(spark, d):
    return tables.extract_set_stats(nodes(spark, d)).select(
        "cluster_id", "node_id", day(), "ns", "set_name", "key", "value"
    )


@query(
    "n5_security",
    f"""SELECT n.cluster_id, n.node_id, {DAY_SQL} AS day, u.key AS "user",
               coalesce(CAST(u.value ->> '$.connections' AS BIGINT), 0) AS connections
        FROM lens_nodes n, json_each(n.payload, '$.as_stat.acl.users') u""",
)
def n5(spark, d):
    return tables.extract_security(nodes(spark, d)).select(
        "cluster_id", "node_id", day(), "user", "connections"
    )


@query(
    "n6_system_info",
    f"""SELECT n.cluster_id, n.node_id, {DAY_SQL} AS day, m.key AS metric, m.value ->> '$' AS value
        FROM lens_nodes n, json_each(n.payload, '$.sys_stat') m""",
)
def n6(spark, d):
    return tables.extract_system_info(nodes(spark, d)).select(
        "cluster_id", "node_id", day(), "metric", "value"
    )


# Metadata per node, straight from the customer table the payloads were made of.
_NODE_META = """
    SELECT concat('c', c_nationkey) AS cluster_id, concat('n', c_custkey) AS node_id,
      CASE WHEN c_nationkey = 7 THEN 'E-6.4.0.1' ELSE concat('E-7.2.0.',
        CASE WHEN c_nationkey % 5 = 0 THEN c_custkey % 3 ELSE 6 END) END AS server_version,
      CASE WHEN c_nationkey = 7 THEN 'E-6' ELSE 'E-7' END AS major_version,
      CASE WHEN c_nationkey % 3 = 0 OR c_nationkey = 2 THEN 'AWS'
           WHEN c_nationkey % 3 = 1 OR c_nationkey = 5 THEN 'Azure'
           ELSE 'Bare Metal / On-Prem' END AS cloud_platform,
      CASE WHEN c_nationkey % 3 < 2 THEN 'Strong Consistency (SC)'
           ELSE 'Available/Partition-Tolerant (AP)' END AS consistency_model,
      CASE c_custkey % 3 WHEN 0 THEN 'DEVICE' WHEN 1 THEN 'FILE' ELSE 'MEMORY' END AS storage_flavor,
      CASE WHEN c_nationkey % 4 = 0 THEN 'XDR Enabled' ELSE 'Standalone' END AS topology
    FROM customer"""
_DAYS = "(SELECT unnest([19723, 19724]) AS day)"


def _meta_column(*names: str) -> str:
    cols = ", ".join(names)
    return f"SELECT m.cluster_id, m.node_id, y.day, {cols} FROM ({_NODE_META}) m, {_DAYS} y"


def _node_meta(*names: str):
    def run(spark, d):
        return metadata.node_metadata(nodes(spark, d)).select("cluster_id", "node_id", day(), *names)

    return run


for _name, _cols in {
    "n8_server_version": ["server_version"],
    "n9_major_version": ["major_version"],
    "n10_consistency": ["consistency_model"],
    "n11_storage": ["storage_flavor"],
    "n12_platform": ["cloud_platform"],
    "n13_topology": ["topology"],
}.items():
    query(_name, _meta_column(*_cols))(_node_meta(*_cols))


@query(
    "n12b_platform_tiered",
    f"""SELECT cluster_id, node_id, {DAY_SQL} AS day,
               CASE c_nationkey WHEN 2 THEN 'AWS' WHEN 5 THEN 'Azure' WHEN 8 THEN 'GCP'
                 ELSE 'Bare Metal / On-Prem' END AS cloud_platform
        FROM lens_nodes""",
)
def n12b(spark, d):
    """This mode searches settings and statistics, but not the host names."""
    return metadata.node_metadata(nodes(spark, d), "tiered").select(
        "cluster_id", "node_id", day(), "cloud_platform"
    )


_META_KEYS = ", ".join(metadata.METADATA_KEYS)


_META_SQL = f"""
    WITH u AS (
      UNPIVOT ({_NODE_META}) ON {_META_KEYS} INTO NAME key VALUE value),
    l AS (
      SELECT cluster_id, key, arg_max(value, node_id) AS value, count(DISTINCT value) AS n_values
      FROM u GROUP BY ALL
      UNION ALL
      SELECT DISTINCT cluster_id, 'cluster_name', cluster_id, 1 FROM u)
    SELECT l.*, y.day FROM l, {_DAYS} y"""


@query("n7_metadata", _META_SQL)
def n7(spark, d):
    return metadata.extract_metadata(nodes(spark, d)).select(
        "cluster_id", "key", "value", "n_values", day()
    )


@query(
    "n14_index_location",
    f"""SELECT DISTINCT cluster_id, {DAY_SQL} AS day,
               CASE WHEN cluster_id < 'c2' THEN 'Flash (All-Flash)' ELSE 'RAM (shmem)' END
                 AS index_location
        FROM lens_nodes""",
)
def n14(spark, d):
    """The documents of half of the clusters name mounts, so both answers occur."""
    all_nodes = sources.staged(nodes(spark, d), "n14")
    clusters = all_nodes.select("run_id", "snapshot_ts", "cluster_id").distinct()
    meta = metadata.extract_metadata(all_nodes)
    stats = tables.extract_namespace_stats(all_nodes)
    return metadata.index_location(clusters, meta, stats).select(*["cluster_id"], day(), "index_location")


_FEATURE_SQL = f"""
    WITH c AS (SELECT concat('c', c_nationkey) AS cluster_id, concat('n', c_custkey) AS node_id,
                      c_custkey AS k, c_nationkey AS n FROM customer),
    f AS (
      SELECT cluster_id, node_id, 'KVS' AS feature FROM c WHERE k > 0
      UNION ALL SELECT cluster_id, node_id, 'Batch' FROM c WHERE k % 2 = 1
      UNION ALL SELECT cluster_id, node_id, 'PIndex Query' FROM c WHERE k % 2 = 1
      UNION ALL SELECT cluster_id, node_id, 'Rack-aware' FROM c WHERE n % 2 = 1
      UNION ALL SELECT cluster_id, node_id, 'Security' FROM c WHERE n % 2 = 0
      UNION ALL SELECT cluster_id, node_id, 'TLS' FROM c WHERE n % 3 > 0
      UNION ALL SELECT cluster_id, node_id, 'SC' FROM c WHERE n % 3 < 2
      UNION ALL SELECT cluster_id, node_id, 'Index-on-flash' FROM c)
    SELECT f.*, y.day FROM f, {_DAYS} y"""


@query("n15_features", _FEATURE_SQL)
def n15(spark, d):
    return detect_features(nodes(spark, d)).select("cluster_id", "node_id", day(), "feature")


@query(
    "j6_run_extractors",
    f"""SELECT 'namespace_stats' AS table_name, cluster_id, count(*) AS n
        FROM ({_NS_STATS}) GROUP BY ALL
        UNION ALL SELECT 'active_features', cluster_id, count(*) FROM ({_FEATURE_SQL}) GROUP BY ALL
        UNION ALL SELECT 'cluster_metadata', cluster_id, count(*) FROM ({_META_SQL}) GROUP BY ALL
        UNION ALL SELECT 'security_stats', cluster_id, 3 * count(*) FROM lens_nodes GROUP BY ALL
        UNION ALL SELECT 'set_stats', cluster_id, 3 * count(*) FROM lens_nodes GROUP BY ALL
        UNION ALL SELECT 'system_info', cluster_id, 3 * count(*) FROM lens_nodes GROUP BY ALL
        UNION ALL SELECT 'node_stats', cluster_id, count(*) FROM ({_TREE.replace('{root}', '')})
        WHERE type NOT IN ('OBJECT', 'NULL') GROUP BY ALL
        UNION ALL SELECT 'node_configs', cluster_id, count(*) FROM ({_TREE.replace('{root}', '')})
        WHERE path LIKE 'as_stat.config.%' AND type <> 'OBJECT' GROUP BY ALL""",
)
def j6(spark, d):
    """Rows of every table."""
    made = run_extractors(sources.staged(nodes(spark, d), "j6"))
    parts = [
        df.groupBy("cluster_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(name).alias("table_name"), "cluster_id", "n")
        for name, df in made.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fleet_tables(spark: SparkSession, d: str, *names: str) -> dict[str, DataFrame]:
    """Telemetry tables of the fleet, as a run stores them: nodes are written once and every table
    is extracted from them and written. Without names, all tables."""
    wanted = {n: fn for n, fn in EXTRACTORS.items() if not names or n in names}
    made = run_extractors(sources.staged(nodes(spark, d), "fleet"), wanted)
    return {name: sources.staged(df, name) for name, df in made.items()}
