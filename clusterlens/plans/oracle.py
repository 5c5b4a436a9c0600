"""DuckDB texts of the driver queries, written independently of the Spark plans."""

from __future__ import annotations

from clusterlens.plans.lens import with_lenses

ORACLE: dict[str, str] = {}

INT = "CAST(trunc({}) AS BIGINT)"


def _int(x: str) -> str:
    return INT.format(x)


def _thousands(x: str) -> str:
    return "format('{:,}', " + _int(x) + ")"


# --- rules: one SELECT per rule of cluster_id, id, status, message and evidence -------------------


def _error_skew(rule_id: str, metrics: list[str], word: str) -> str:
    firsts = ", ".join(
        f"sum(CASE WHEN metric = '{m}' THEN CAST(value AS DOUBLE) END)" for m in metrics
    )
    names = ", ".join(f"'{m}'" for m in metrics)
    return f"""
    WITH per_node AS (
      SELECT cluster_id, node_id, coalesce({firsts}) AS x FROM {{node_stats}}
      WHERE metric IN ({names}) GROUP BY ALL),
    ranked AS (
      SELECT cluster_id, node_id, x, row_number() OVER (
        PARTITION BY cluster_id ORDER BY x DESC, node_id) AS rn FROM per_node),
    agg AS (
      SELECT cluster_id, sum(x) AS total, avg(x) AS mean, max(x) AS peak, count(*) AS n,
             max(CASE WHEN rn = 1 THEN node_id END) AS worst
      FROM ranked GROUP BY cluster_id)
    SELECT cluster_id, '{rule_id}' AS id,
      CASE WHEN peak > 2 * mean AND peak > 100 THEN 'WARNING' ELSE 'PASS' END AS status,
      CASE WHEN total = 0 THEN 'No {word} errors were counted on any node.'
           WHEN peak > 2 * mean AND peak > 100 THEN
             'Node ' || worst || ' stands out with ' || {_int('peak')}
             || ' {word} errors against a mean of ' || {_int('mean')} || '.'
           ELSE '{word.capitalize()} errors are evenly spread over ' || n || ' nodes: total '
             || {_int('total')} || ', highest ' || {_int('peak')} || ', mean '
             || {_int('mean')} || '.' END AS message,
      total, mean, peak
    FROM agg"""


def _hwm(rule_id: str, metric: str, word: str, warn: int, crit: int) -> str:
    return f"""
    WITH ranked AS (
      SELECT cluster_id, node_id, namespace, value, row_number() OVER (
        PARTITION BY cluster_id ORDER BY value DESC, node_id, namespace) AS rn
      FROM {{namespace_stats}} WHERE metric = '{metric}')
    SELECT cluster_id, '{rule_id}' AS id,
      CASE WHEN value >= {crit} THEN 'CRITICAL' WHEN value >= {warn} THEN 'WARNING'
           ELSE 'PASS' END AS status,
      CASE WHEN value < {warn}
           THEN 'Peak {word} use is ' || {_int('value')} || '%, below the mark of {warn}%.'
           ELSE 'Namespace ' || namespace || ' uses ' || {_int('value')}
             || '% of its {word} on node ' || node_id || '.' END AS message,
      value AS peak
    FROM ranked WHERE rn = 1"""


def _sum_rule(rule_id: str, where: str, word: str, over: str) -> str:
    return f"""
    WITH agg AS (
      SELECT cluster_id, sum(value) AS total FROM {{namespace_stats}} WHERE {where}
      GROUP BY cluster_id)
    SELECT cluster_id, '{rule_id}' AS id,
      CASE WHEN {over} THEN 'WARNING' ELSE 'PASS' END AS status,
      CASE WHEN total = 0 THEN 'No ''{word}'' events were counted.'
           ELSE {_thousands('total')} || ' ''{word}'' events were counted in the cluster.' END
        AS message,
      total
    FROM agg"""


_SETTINGS = """
    rows_ AS (
      SELECT cluster_id, node_id, config_name, value, split_part(config_name, '.', 2) AS ns,
             split_part(config_name, '.', -1) AS k
      FROM {node_configs} WHERE config_name ILIKE 'namespace.%.%'),
    firsts AS (
      SELECT cluster_id, ns, k, value, row_number() OVER (
        PARTITION BY cluster_id, ns, k ORDER BY node_id, config_name, value) AS rn FROM rows_),
    ns_ AS (
      SELECT cluster_id, ns,
        coalesce(max(CASE WHEN rn = 1 AND k = 'partition-tree-sprigs' THEN value END), '64') AS sprigs,
        coalesce(max(CASE WHEN rn = 1 AND k = 'defrag-lwm-free-pct' THEN value END), '50') AS defrag,
        coalesce(max(CASE WHEN rn = 1 AND k = 'high-water-disk-pct' THEN value END), '50') AS hwm,
        bool_or(k IN ('index-type', 'sindex-type')) AS seen_a,
        bool_or(k IN ('index-type', 'sindex-type') AND value = 'flash') AS flash_a,
        bool_or(k = 'sindex-type') AS has_sindex,
        bool_or(k = 'sindex-type' AND value = 'flash') AS sindex_flash,
        bool_or(k IN ('index-type', 'partition-tree-sprigs')) AS seen_b,
        bool_or(k IN ('index-type', 'partition-tree-sprigs') AND value = 'flash') AS flash_b,
        bool_or(k IN ('defrag-lwm-free-pct', 'high-water-disk-pct')) AS seen_c
      FROM firsts GROUP BY cluster_id, ns)"""


def _settings_rule(rule_id, seen, flagged, label, passed, found) -> str:
    return f"""
    WITH {_SETTINGS},
    hit AS (
      SELECT cluster_id, ns AS entity, {label} AS label, {flagged} AS flagged FROM ns_
      WHERE {seen}),
    lead_ AS (
      SELECT cluster_id, string_agg(label, ', ' ORDER BY rn) AS names FROM (
        SELECT cluster_id, label, row_number() OVER (
          PARTITION BY cluster_id ORDER BY entity) AS rn FROM hit WHERE flagged) t
      GROUP BY cluster_id),
    agg AS (
      SELECT cluster_id, count(*) AS n_seen, count(*) FILTER (flagged) AS n FROM hit
      GROUP BY cluster_id)
    SELECT cluster_id, '{rule_id}' AS id,
      CASE WHEN n > 0 THEN 'WARNING' ELSE 'PASS' END AS status,
      CASE WHEN n > 0 THEN n || ' {found}: ' || names || '.' ELSE '{passed}' END AS message,
      CAST(n AS DOUBLE) AS n_findings, CAST(n_seen AS DOUBLE) AS n_seen
    FROM agg LEFT JOIN lead_ USING (cluster_id)"""


_IGNORED = ", ".join(
    f"'{n}'"
    for n in [
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
)

RULE_SQL: dict[str, str] = {
    "1.a": _error_skew(
        "1.a",
        ["service.service_error", "as_stat.statistics.service.service_error"],
        "service",
    ),
    "1.a2": _error_skew(
        "1.a2",
        [
            "service.client_proxy_error",
            "client_proxy_error",
            "as_stat.statistics.service.client_proxy_error",
        ],
        "proxy",
    ),
    "1.b": """
    WITH d AS (
      SELECT cluster_id, count(*) AS n_rows,
             count(*) FILTER (regexp_matches(value, 'ena|vfio-pci')) AS n_fast
      FROM {system_info} WHERE metric = 'network_driver' GROUP BY cluster_id),
    m AS (SELECT cluster_id, value AS platform FROM {cluster_metadata} WHERE key = 'cloud_platform'),
    j AS (
      SELECT cluster_id, coalesce(platform, 'Unknown') AS platform,
             coalesce(n_rows, 0) AS n_rows, coalesce(n_fast, 0) AS n_fast
      FROM m FULL JOIN d USING (cluster_id))
    SELECT cluster_id, '1.b' AS id,
      CASE WHEN upper(platform) LIKE '%AWS%' AND n_fast = 0 THEN 'WARNING' ELSE 'PASS' END AS status,
      CASE WHEN upper(platform) LIKE '%AWS%' AND n_fast = 0
           THEN 'No accelerated network driver was found on an AWS platform.'
           ELSE 'Network acceleration needs no attention on platform ' || platform || '.' END
        AS message,
      CAST(n_rows AS DOUBLE) AS driver_rows, CAST(n_fast AS DOUBLE) AS fast_rows
    FROM j""",
    "1.c": """
    WITH firsts AS (
      SELECT cluster_id, node_id, value, row_number() OVER (
        PARTITION BY cluster_id, node_id ORDER BY metric, value) AS rn
      FROM {node_stats} WHERE metric ILIKE '%version' OR metric ILIKE '%build'),
    versions AS (
      SELECT cluster_id, value, count(*) AS n FROM firsts WHERE rn = 1 GROUP BY cluster_id, value),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, value) AS rn
      FROM versions),
    agg AS (
      SELECT cluster_id, count(*) AS k, sum(n) AS total,
             string_agg(value || ' (' || n || ' nodes)', ', ' ORDER BY rn) AS names
      FROM ranked GROUP BY cluster_id)
    SELECT cluster_id, '1.c' AS id,
      CASE WHEN k > 1 THEN 'WARNING' ELSE 'PASS' END AS status,
      CASE WHEN k > 1 THEN 'Nodes run ' || k || ' different versions: ' || names || '.'
           ELSE 'All nodes run the same version: ' || names || '.' END AS message,
      CAST(k AS DOUBLE) AS n_findings, CAST(total AS DOUBLE) AS total
    FROM agg""",
    "2.a": _settings_rule(
        "2.a",
        "seen_a",
        "flash_a AND has_sindex AND NOT sindex_flash",
        "ns",
        "Secondary indexes are placed like the primary index.",
        "namespaces keep secondary indexes in memory, the primary on flash",
    ),
    "2.b": _settings_rule(
        "2.b",
        "seen_b",
        "flash_b AND CAST(sprigs AS BIGINT) <= 256",
        "ns || ' (' || sprigs || ' sprigs)'",
        "Sprig counts fit the index storage.",
        "namespaces with an index on flash have few sprigs",
    ),
    "2.c": _settings_rule(
        "2.c",
        "seen_c",
        "CAST(defrag AS BIGINT) < 40 OR CAST(defrag AS BIGINT) < CAST(hwm AS BIGINT)",
        "ns || ' (defrag ' || defrag || '%, high water ' || hwm || '%)'",
        "Space is reclaimed before records are evicted.",
        "namespaces may fill up before space is reclaimed",
    ),
    "2.d": _hwm("2.d", "service.data_used_pct", "disk", 60, 75),
    "2.e": _hwm("2.e", "service.memory_used_pct", "memory", 60, 80),
    "3.a": f"""
    WITH varied AS (
      SELECT cluster_id, config_name, count(DISTINCT value) AS v FROM {{node_configs}}
      WHERE config_name NOT IN ({_IGNORED})
        AND NOT regexp_matches(config_name,
          '.objects|.data_used_bytes|.memory_data_bytes|.stop-writes-count|.evict-count')
      GROUP BY cluster_id, config_name HAVING count(DISTINCT value) > 1),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY config_name) AS rn FROM varied),
    agg AS (
      SELECT cluster_id, count(*) AS n, max(v) AS most,
             string_agg(config_name, ', ' ORDER BY rn) AS names
      FROM ranked GROUP BY cluster_id)
    SELECT cluster_id, '3.a' AS id, 'WARNING' AS status,
      n || ' settings differ between nodes: ' || names || '.' AS message,
      CAST(n AS DOUBLE) AS n_findings, CAST(most AS DOUBLE) AS max_score
    FROM agg""",
    "3.b": """
    WITH drift AS (
      SELECT l.cluster_id, l.config_name, count(*) AS n
      FROM {node_configs} l JOIN {static_configs} s
        ON l.cluster_id = s.cluster_id AND l.node_id = s.node_id AND l.config_name = s.config_name
      WHERE l.value <> s.value GROUP BY l.cluster_id, l.config_name),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY config_name) AS rn FROM drift),
    agg AS (
      SELECT cluster_id, sum(n) AS total, count(*) AS k,
             string_agg(config_name, ', ' ORDER BY rn) FILTER (rn <= 3) AS names
      FROM ranked GROUP BY cluster_id)
    SELECT cluster_id, '3.b' AS id, 'WARNING' AS status,
      total || ' running settings differ from the static ones: ' || names || '.' AS message,
      CAST(total AS DOUBLE) AS total, CAST(k AS DOUBLE) AS n_findings
    FROM agg""",
    "4.a": _sum_rule("4.a", "metric ILIKE '%fail_key_busy%'", "key busy", "total > 0"),
    "4.b": _sum_rule(
        "4.b",
        "metric IN ('service.client_read_not_found', 'client_read_not_found')",
        "read not found",
        "false",
    ),
    "4.c": _sum_rule(
        "4.c",
        "metric IN ('service.client_delete_not_found', 'client_delete_not_found')",
        "delete not found",
        "total > 1000000",
    ),
    "4.f": """
    WITH sets AS (
      SELECT cluster_id, ns, set_name, count(*) AS n, avg(CAST(value AS DOUBLE)) AS mean,
             greatest(max(CAST(value AS DOUBLE)) - avg(CAST(value AS DOUBLE)),
                      avg(CAST(value AS DOUBLE)) - min(CAST(value AS DOUBLE))) AS dev
      FROM {set_stats} WHERE key = 'objects' GROUP BY cluster_id, ns, set_name),
    judged AS (
      SELECT *, dev / mean * 100.0 AS pct,
             n >= 2 AND mean >= 1000 AND dev / mean * 100.0 > 10 AS skewed FROM sets),
    agg AS (
      SELECT cluster_id, count(*) FILTER (skewed) AS k, max(CASE WHEN skewed THEN pct END) AS most,
             string_agg(concat(ns, ':', set_name, ' (', format('{:.1f}', pct), '% skew)'), ', '
                        ORDER BY ns || ':' || set_name) FILTER (skewed) AS names
      FROM judged GROUP BY cluster_id)
    SELECT cluster_id, '4.f' AS id, CASE WHEN k > 0 THEN 'WARNING' ELSE 'PASS' END AS status,
      CASE WHEN k > 0 THEN k || ' sets are unevenly spread over the nodes: ' || names || '.'
           ELSE 'Sets are evenly spread over the nodes.' END AS message,
      CAST(k AS DOUBLE) AS n_findings, most AS max_score
    FROM agg""",
    "5.a": f"""
    WITH agg AS (
      SELECT cluster_id, max(value) AS peak FROM {{namespace_stats}}
      WHERE metric ILIKE '%data_used_pct%' OR metric ILIKE '%memory_used_pct%'
      GROUP BY cluster_id)
    SELECT cluster_id, '5.a' AS id,
      CASE WHEN peak > 85 THEN 'CRITICAL' WHEN peak > 70 THEN 'WARNING' ELSE 'PASS' END AS status,
      CASE WHEN peak > 85 THEN 'Resource use is critical: peak ' || {_int('peak')} || '%.'
           WHEN peak > 70 THEN 'Plan an expansion: peak use is ' || {_int('peak')} || '%.'
           ELSE 'Resource use is healthy: peak ' || {_int('peak')} || '%.' END AS message,
      peak
    FROM agg""",
    "6.a": f"""
    WITH users AS (
      SELECT cluster_id, usr, sum(connections) AS c FROM {{security_stats}} GROUP BY cluster_id, usr),
    ranked AS (
      SELECT cluster_id, usr, c, sum(c) OVER (PARTITION BY cluster_id) AS total, row_number() OVER (
        PARTITION BY cluster_id ORDER BY c DESC, usr) AS rn FROM users),
    top AS (
      SELECT *, {_int('CAST(c AS DOUBLE) / CAST(total AS DOUBLE) * 100.0')} AS pct
      FROM ranked WHERE rn = 1)
    SELECT cluster_id, '6.a' AS id,
      CASE WHEN total <> 0 AND pct > 80 AND c > 100 THEN 'WARNING' ELSE 'PASS' END AS status,
      CASE WHEN total = 0 THEN 'No client connections were reported.'
           WHEN pct > 80 AND c > 100
           THEN 'User ' || usr || ' holds ' || pct || '% of all connections (' || c || ').'
           ELSE 'Connections are spread well: user ' || usr || ' leads with ' || pct || '%.' END
        AS message,
      CAST(total AS DOUBLE) AS total, CAST(c AS DOUBLE) AS top_amount, CAST(pct AS DOUBLE) AS top_pct
    FROM top""",
}


def _rule_sql(rule_id: str, **tables: str) -> str:
    sql = RULE_SQL[rule_id]
    for name, source in tables.items():
        sql = sql.replace("{" + name + "}", source)
    return sql


def _with_empty(rule_id: str, table: str, message: str, nulls: list[str], **tables: str) -> str:
    """A rule's verdicts, and the empty verdict for clusters of the table it says nothing about."""
    cols = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in nulls)
    inner = _rule_sql(rule_id, **tables)
    return f"""
    WITH said AS ({inner})
    SELECT * FROM said
    UNION ALL
    SELECT DISTINCT cluster_id, '{rule_id}', 'PASS', '{message}', {cols} FROM {table} t
    WHERE cluster_id NOT IN (SELECT cluster_id FROM said)"""


# The platform and driver rows inside lens_driver, as the two tables that rule 1.b reads.
_META = (
    "(SELECT DISTINCT cluster_id, 'cloud_platform' AS key, cloud_platform AS value FROM lens_driver)"
)

ORACLE.update(
    {
        "r1a_error_skew": _rule_sql("1.a", node_stats="lens_node_stats"),
        "r1a2_proxy_skew": _rule_sql("1.a2", node_stats="lens_node_stats"),
        "r1b_network": _rule_sql("1.b", system_info="lens_driver", cluster_metadata=_META),
        "r1c_version_consistency": _rule_sql("1.c", node_stats="lens_ver"),
        "r2a_sindex_flash": _rule_sql("2.a", node_configs="lens_cfg"),
        "r2b_sprigs": _rule_sql("2.b", node_configs="lens_cfg"),
        "r2c_deadlock": _rule_sql("2.c", node_configs="lens_cfg"),
        "r2d_disk_hwm": _rule_sql("2.d", namespace_stats="lens_ns"),
        "r2e_memory_hwm": _rule_sql("2.e", namespace_stats="lens_ns"),
        "r3a_symmetry": _rule_sql("3.a", node_configs="lens_cfg"),
        "r3b_config_drift": _rule_sql(
            "3.b", node_configs="lens_live", static_configs="lens_static"
        ),
        "r4a_hot_key": _with_empty(
            "4.a",
            "lens_ns_counters",
            "No ''key busy'' events were counted.",
            ["total"],
            namespace_stats="lens_ns_counters",
        ),
        "r4b_read_miss": _rule_sql("4.b", namespace_stats="lens_ns_counters"),
        "r4c_delete_miss": _rule_sql("4.c", namespace_stats="lens_ns_counters"),
        "r4f_set_skew": _rule_sql("4.f", set_stats="lens_sets"),
        "r5a_capacity": _rule_sql("5.a", namespace_stats="lens_ns"),
        "r6a_connections": _rule_sql("6.a", security_stats="lens_sec"),
    }
)


def oracle_sql() -> dict[str, str]:
    return {name: with_lenses(sql) for name, sql in ORACLE.items()}
