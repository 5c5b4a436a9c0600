"""Lens views: the provided tables seen as cluster telemetry.

The view texts run unchanged in Spark SQL and in DuckDB, so a query and its oracle start from the
same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
]

SNAPSHOTS = ["2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"]


def _payload(s: int) -> str:
    """SQL expression: the telemetry of one node (a customer) at snapshot number ``s``."""
    namespaces = ",".join(
        f""""ns{i}":{{"service":{{"data_used_pct":"',
        (c_custkey + {i}) % 60 + {s} * 20, '.5","memory_used_pct":', c_custkey % 84,
        ',"objects":', c_custkey * {i + 1} + 2000, ',"fail_key_busy":',
        CASE WHEN c_nationkey % 4 = 1 THEN c_custkey * ({s} + 1) * 10000 ELSE 0 END,
        ',"client_read_success":', c_custkey * 20, ',"client_read_not_found":', c_custkey % 50,
        ',"client_delete_success":', c_custkey * 30, ',"client_delete_not_found":',
        CASE WHEN c_nationkey = 3 THEN c_custkey * 5000 ELSE 1 END,
        ',"cache_read_pct":', 85 + c_custkey % 16, ',"nsup_cycle_duration":', c_custkey % 130,
        ',"client_proxy":', c_custkey * {s} * 100000, ',"batch_sub_read_success":', c_custkey % 90,
        ',"batch_sub_read_error":', c_custkey % 10, ',"data_used_bytes":', c_custkey * 1000,
        ',"pi_query_total":', c_custkey % 2, ',"index-type":"flash","below":-1,"power":"1e3",',
        '"index-type.', CASE WHEN concat('c', c_nationkey) < 'c2' THEN 'mount' ELSE 'shm' END,
        '[0].age":', c_custkey % 5, '}}}}"""
        for i in range(2)
    )
    config = ",".join(
        f""""ns{i}":{{"service":{{"strong-consistency":"',
        CASE WHEN c_nationkey % 3 = {i} THEN 'true' ELSE 'false' END, '","storage-engine":',
        CASE WHEN c_custkey % 3 = 0 THEN '"device"' WHEN c_custkey % 3 = 1 THEN '{{"files":["a","b"]}}'
             ELSE '"memory"' END,
        ',"index-type":"', CASE WHEN c_nationkey % 2 = {i} THEN 'flash' ELSE 'shmem' END,
        '","sindex-type":"', CASE WHEN c_nationkey % 5 = 0 THEN 'flash' ELSE 'shmem' END,
        '","partition-tree-sprigs":"', CASE WHEN c_nationkey % 3 = 0 THEN 64 ELSE 4096 END,
        '","defrag-lwm-free-pct":', CASE WHEN c_nationkey % 4 = 0 THEN 35 ELSE 65 END,
        ',"high-water-disk-pct":60,"defrag-lwm-pct":50,"nsup-period":120,"rack-id":"',
        c_nationkey % 2, '"}}}}"""
        for i in range(2)
    )
    return f"""concat(
        '{{"as_stat":{{"meta_data":{{"asd_build":"', CASE WHEN c_nationkey = 7 THEN '' ELSE
            concat('E-7.2.0.', CASE WHEN c_nationkey % 5 = 0 THEN c_custkey % 3 ELSE 6 END) END,
        '","edition":"full"}},"statistics":{{"service":{{"asd_build":"E-6.4.0.1","client_connections":',
        c_custkey % 900, ',"service_error":',
        CASE WHEN c_nationkey % 2 = 0 AND c_custkey % 60 = 0 THEN 5000 ELSE c_custkey % 7 END,
        ',"batch_initiate":', c_custkey % 2, ',"stat_read_reqs":"', c_custkey % 4,
        '","cluster_clock_skew":', CASE WHEN c_custkey % 500 = 0 THEN 3 ELSE 0 END,
        ',"system_free_mem_pct":', 15 + c_custkey % 80, ',"heap_efficiency_pct":', 58 + c_custkey % 40,
        ',"note":null,"tags":[1,2],"empty":{{}},"as.dotted":{{"x":"{{', chr(92), '"q', chr(92), '":1}}"}}}},"namespace":{{',
        '{namespaces}',
        '}},"set":{{"ns0":{{"s1":{{"objects":',
        CASE WHEN c_nationkey % 6 = 0 THEN c_custkey + 1000 ELSE 5000 END,
        ',"tombstones":0}},"s2":{{"objects":', c_custkey % 10, '}}}}}},"xdr":',
        CASE WHEN c_nationkey % 4 = 0 THEN '{{"dc1":{{"lag":1}}}}' ELSE '{{}}' END,
        '}},"config":{{"service":{{"proto-fd-max":1000,"min-cluster-size":', 1 + c_nationkey % 2,
        ',"cluster-name":null,"feature-key":"k', c_nationkey % 3 * c_custkey % 2,
        '"}},"security":{{"enable-security":"', CASE WHEN c_nationkey % 2 = 0 THEN 'True' ELSE 'no' END,
        '"}},"network":{{"service":{{"address":"', CASE c_nationkey WHEN 2 THEN '10.94.0.'
            WHEN 5 THEN '10.181.0.' WHEN 8 THEN 'x.gce.internal.' ELSE '10.0.0.' END,
        c_custkey, '","tls-port":', c_nationkey % 3 * 4000,
        '}},"fabric":{{"tls-port":0}}}},"namespace":{{',
        '{config}',
        '}}}},"acl":{{"users":{{"app":{{"connections":', c_custkey % 700,
        '}},"admin":{{}},"ops":{{"connections":', c_custkey % 3, '}}}}}}}},"sys_stat":{{"network_driver":"',
        CASE WHEN c_nationkey % 6 = 0 THEN 'ena' ELSE 'virtio_net' END, '","thp":"',
        CASE WHEN c_nationkey % 5 = 1 THEN '[always] never' ELSE 'always [never]' END,
        '","host":"h', c_custkey, CASE c_nationkey % 3 WHEN 0 THEN '.EC2.internal'
            WHEN 1 THEN '.cloudapp.net' ELSE '.local' END, '"}}}}')"""


def _docs() -> str:
    parts = ", ',', ".join(
        f"""'"{ts}":{{"c', c_nationkey, '":{{"n', c_custkey, '":', {_payload(s)}, '}}}}'"""
        for s, ts in enumerate(SNAPSHOTS)
    )
    return f"SELECT c_custkey AS doc_id, concat('{{', {parts}, '}}') AS json FROM customer"


def _nodes() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{ts}' AS snapshot, concat('c', c_nationkey) AS cluster_id, "
        f"concat('n', c_custkey) AS node_id, c_custkey, c_nationkey, {_payload(s)} AS payload "
        f"FROM customer"
        for s, ts in enumerate(SNAPSHOTS)
    )


LENS: dict[str, str] = {
    "lens_node_stats": """
        SELECT concat('c', cast(user_id % 3 AS varchar(20))) AS cluster_id,
               CASE WHEN user_id % 3 = 2 THEN concat('n', cast(user_id % 8 AS varchar(20)))
                    WHEN user_id % 10 < 5 THEN 'n0'
                    ELSE concat('n', cast(user_id % 10 - 4 AS varchar(20))) END AS node_id,
               CASE event_type WHEN 'error' THEN 'service.service_error'
                               WHEN 'view' THEN 'as_stat.statistics.service.client_connections'
                               WHEN 'click' THEN 'service.client_proxy_error'
                               ELSE concat('service.', event_type) END AS metric,
               cast(count(*) AS varchar(20)) AS value
        FROM events GROUP BY 1, 2, 3""",
    "lens_ns": """
        SELECT concat('c', cast(s_nationkey AS varchar(20))) AS cluster_id, s_name AS node_id,
               concat('ns', cast(s_suppkey % 2 AS varchar(20))) AS namespace,
               'service.data_used_pct' AS metric, greatest(s_acctbal, 0) / 100 AS value
        FROM supplier
        UNION ALL
        SELECT concat('c', cast(s_nationkey AS varchar(20))), s_name,
               concat('ns', cast(s_suppkey % 2 AS varchar(20))),
               'service.memory_used_pct', cast((s_suppkey * 37) % 84 AS double)
        FROM supplier""",
    "lens_ns_counters": """
        SELECT concat('c', cast(user_id % 3 AS varchar(20))) AS cluster_id,
               concat('n', cast(user_id % 8 AS varchar(20))) AS node_id,
               concat('ns', cast(user_id % 2 AS varchar(20))) AS namespace,
               CASE event_type WHEN 'error' THEN 'service.fail_key_busy'
                               WHEN 'view' THEN 'service.client_read_not_found'
                               WHEN 'click' THEN 'service.client_read_success'
                               WHEN 'signup' THEN 'service.client_delete_not_found'
                               ELSE 'service.client_delete_success' END AS metric,
               cast(count(*) * CASE WHEN user_id % 3 = 0 THEN 10000 ELSE 1 END AS double) AS value
        FROM events
        GROUP BY user_id % 3, user_id % 8, user_id % 2, event_type""",
    "lens_sets": """
        SELECT 'c0' AS cluster_id,
               CASE WHEN l_returnflag <> 'A' THEN concat('n', cast(l_suppkey % 5 AS varchar(20)))
                    WHEN l_suppkey % 10 < 5 THEN 'n0'
                    ELSE concat('n', cast(l_suppkey % 10 - 4 AS varchar(20))) END AS node_id,
               l_returnflag AS ns, l_linestatus AS set_name, 'objects' AS key,
               cast(count(*) AS varchar(20)) AS value
        FROM lineitem GROUP BY 2, 3, 4""",
    "lens_sec": """
        SELECT concat('c', cast(user_id % 3 AS varchar(20))) AS cluster_id,
               concat('n', cast(user_id % 8 AS varchar(20))) AS node_id,
               CASE WHEN user_id % 3 = 1 AND user_id % 50 <> 1 THEN 'app' ELSE event_type END AS usr,
               count(*) AS connections
        FROM events GROUP BY 1, 2, 3""",
    "lens_ver": """
        SELECT concat('c', cast(s_nationkey AS varchar(20))) AS cluster_id, s_name AS node_id,
               'as_stat.meta_data.asd_build' AS metric,
               CASE WHEN s_nationkey % 5 = 0
                    THEN concat('E-7.2.0.', cast(s_suppkey % 2 AS varchar(20)))
                    ELSE 'E-7.2.0.6' END AS value
        FROM supplier""",
    "lens_driver": """
        SELECT concat('c', cast(s_nationkey AS varchar(20))) AS cluster_id, s_name AS node_id,
               CASE s_nationkey % 3 WHEN 0 THEN 'AWS' WHEN 1 THEN 'Azure'
                                    ELSE 'Bare Metal / On-Prem' END AS cloud_platform,
               'network_driver' AS metric,
               CASE WHEN s_nationkey % 2 = 0 THEN 'ena' ELSE 'virtio_net' END AS value
        FROM supplier""",
    "lens_cfg": """
        SELECT 'c0' AS cluster_id, concat('n', cast(p_partkey % 4 AS varchar(20))) AS node_id,
               p_partkey AS ord,
               concat('namespace.', p_brand,
                      CASE WHEN p_partkey % 2 = 0 THEN '.service.' ELSE '.' END,
                      CASE p_size % 5 WHEN 0 THEN 'index-type' WHEN 1 THEN 'sindex-type'
                                      WHEN 2 THEN 'partition-tree-sprigs'
                                      WHEN 3 THEN 'defrag-lwm-free-pct'
                                      ELSE 'high-water-disk-pct' END) AS config_name,
               CASE WHEN p_size % 5 = 2 THEN cast(p_size * 16 AS varchar(20))
                    WHEN p_size % 5 > 2 THEN cast(p_size + 20 AS varchar(20))
                    WHEN (p_size + length(p_brand) + p_partkey) % 3 = 0 THEN 'flash'
                    ELSE 'shmem' END AS value
        FROM part""",
    "lens_live": """
        SELECT cluster_id, node_id, config_name, min(value) AS value
        FROM lens_cfg GROUP BY 1, 2, 3""",
    "lens_static": """
        SELECT cluster_id, node_id, config_name,
               CASE WHEN max(ord) % 7 = 0 THEN concat(min(value), '_old') ELSE min(value) END AS value
        FROM lens_cfg GROUP BY 1, 2, 3""",
    "lens_ts": """
        SELECT cluster_id, node_id, d,
               sum(n) OVER (PARTITION BY cluster_id, node_id ORDER BY d)
                 / CASE WHEN cluster_id = 'c0' THEN 8.0 ELSE 16.0 END AS used_pct
        FROM (SELECT concat('c', cast(user_id % 3 AS varchar(20))) AS cluster_id,
                     concat('n', cast(user_id % 8 AS varchar(20))) AS node_id,
                     cast(ts AS date) AS d, cast(count(*) AS double) AS n
              FROM events GROUP BY 1, 2, 3) t""",
    # Readings of a node over the days, in three runs: two days, some weeks, and the rest.
    "lens_runs": """
        SELECT cluster_id, node_id, d, used_pct, busy,
               CASE WHEN d < first_day + INTERVAL '2' DAY THEN 'r1'
                    WHEN d < first_day + INTERVAL '15' DAY THEN 'r2' ELSE 'r3' END AS run_id
        FROM (SELECT cluster_id, node_id, d, min(d) OVER () AS first_day,
                     sum(n) OVER (PARTITION BY cluster_id, node_id ORDER BY d)
                       / CASE WHEN cluster_id = 'c0' THEN 16.0 ELSE 64.0 END AS used_pct,
                     sum(errors) OVER (PARTITION BY cluster_id, node_id ORDER BY d) * 2000000.0 AS busy
              FROM (SELECT concat('c', cast(user_id % 3 AS varchar(20))) AS cluster_id,
                           concat('n', cast(user_id % 8 AS varchar(20))) AS node_id,
                           cast(ts AS date) AS d, cast(count(*) AS double) AS n,
                           cast(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS double) AS errors
                    FROM events GROUP BY 1, 2, 3) t) u""",
    # One JSON document per customer, holding two snapshots of one node.
    "lens_docs": _docs(),
    # The node payloads inside these documents.
    "lens_nodes": _nodes(),
}

# A customer of a few bytes becomes a document of kilobytes, so one small file is spread over all
# cores before its documents are made.
SPREAD = {"lens_docs": ["c_custkey"], "lens_nodes": ["c_custkey"]}


def _needs(text: str, names) -> list[str]:
    words = set(re.findall(r"\b[a-z_]+\b", text))
    return [n for n in names if n in words]


def lens(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A lens view, or one of the provided tables, as a DataFrame."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = LENS[name]
    for dep in _needs(text, [*BASE_TABLES, *LENS]):
        df = lens(spark, sf_dir, dep)
        if name in SPREAD:
            df = df.repartition(2 * spark.sparkContext.defaultParallelism, *SPREAD[name])
        df.createOrReplaceTempView(dep)
    return spark.sql(text)


def with_lenses(sql: str) -> str:
    """DuckDB text of a query, with the definitions of the lens views it names."""
    wanted: list[str] = []

    def add(text: str) -> None:
        for dep in _needs(text, LENS):
            if dep not in wanted:
                add(LENS[dep])
                wanted.append(dep)

    add(sql)
    if not wanted:
        return sql
    ctes = ",\n".join(f"{n} AS ({LENS[n]})" for n in wanted)
    body = sql.strip()
    if re.match(r"(?i)with\b", body):
        return f"WITH {ctes},\n{body[4:].strip()}"
    return f"WITH {ctes}\n{body}"
