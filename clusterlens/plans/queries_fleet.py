"""Queries of the whole ruleset, the catalogue rules and the report datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens import operators as op
from clusterlens import report, rules
from clusterlens.plans.lens import lens
from clusterlens.plans.oracle import _SETTINGS, ORACLE, RULE_SQL
from clusterlens.plans.queries import C, QUERIES, lens_tables, security
from clusterlens.plans.queries_operators import query
from clusterlens.plans.queries_telemetry import (
    _FEATURE_SQL,
    _META_SQL,
    _NS_STATS,
    _TREE,
    DAY_SQL,
    day,
    fleet_tables,
)
from clusterlens.report.datasets import DEFAULT_REMEDIATION, VITALS
from clusterlens.rules.core import ADVICE, RULE_ORDER
from clusterlens.rules.registry import REGISTRY

# --- the whole ruleset -----------------------------------------------------------------------------


def run_all_sql(sources: dict[str, str], ids: list[str] = RULE_ORDER) -> str:
    """Results of the ruleset over SQL sources of the telemetry tables, as a WITH-less SELECT.

    The default texts come from the registry, the decisions from the oracle's own rule texts.
    """

    def q(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def said(rule_id: str) -> str:
        sql = RULE_SQL[rule_id]
        for name, source in sources.items():
            sql = sql.replace("{" + name + "}", source)
        return f"SELECT cluster_id, id, status, message FROM ({sql})"

    grid = ",\n".join(
        "("
        + ", ".join(
            q(x)
            for x in (r.id, r.name, r.table, *r.missing, *r.empty, ADVICE[r.id])
        )
        + ")"
        for r in (REGISTRY[i] for i in ids)
    )
    cov = " UNION ALL ".join(
        f"SELECT DISTINCT cluster_id, '{t}' AS t FROM {src} x" for t, src in sources.items()
    )
    verdicts = " UNION ALL ".join(
        said(i)
        for i in ids
        if all("{" + t + "}" not in RULE_SQL[i] or t in sources for t in S_TABLES)
    )
    return f"""
      SELECT c.cluster_id, r.id, r.name,
        CASE WHEN cov.t IS NULL THEN r.missing_status ELSE coalesce(v.status, r.empty_status) END
          AS status,
        CASE WHEN cov.t IS NULL THEN r.missing_text ELSE coalesce(v.message, r.empty_text) END AS message,
        CASE WHEN cov.t IS NOT NULL AND v.status <> 'PASS' THEN r.advice END AS remediation
      FROM (SELECT DISTINCT cluster_id FROM ({cov})) c
      CROSS JOIN (VALUES {grid}) r(id, name, tab, missing_status, missing_text, empty_status, empty_text, advice)
      LEFT JOIN ({cov}) cov ON cov.cluster_id = c.cluster_id AND cov.t = r.tab
      LEFT JOIN ({verdicts}) v ON v.cluster_id = c.cluster_id AND v.id = r.id"""


S_TABLES = [
    "node_stats",
    "namespace_stats",
    "set_stats",
    "security_stats",
    "node_configs",
    "static_configs",
    "system_info",
    "cluster_metadata",
]

_LENS_SOURCES = {
    "node_stats": "(SELECT * FROM lens_node_stats UNION ALL SELECT * FROM lens_ver)",
    "namespace_stats": "(SELECT * FROM lens_ns UNION ALL SELECT * FROM lens_ns_counters)",
    "set_stats": "lens_sets",
    "security_stats": "lens_sec",
    "node_configs": "lens_cfg",
    "static_configs": "lens_static",
    "system_info": "lens_driver",
    "cluster_metadata": (
        "(SELECT DISTINCT cluster_id, 'cloud_platform' AS key, cloud_platform AS value "
        "FROM lens_driver)"
    ),
}
LENS_RESULTS = run_all_sql(_LENS_SOURCES)


def lens_results(spark: SparkSession, d: str) -> DataFrame:
    return rules.run_all(lens_tables(spark, d), keys=C)


def shown(results: DataFrame, cluster: Column) -> DataFrame:
    """Comparable columns: all but the evidence, which the rules' own queries compare."""
    return results.select(cluster.alias("cluster_id"), "id", "name", "status", "message", "remediation")


@query("run_all", LENS_RESULTS)
def run_all(spark, d):
    return shown(lens_results(spark, d), F.col("cluster_id"))


# The fleet's tables in SQL. A cluster's key there is its name and the day of the snapshot.
_KEYED = "cluster_id || '@' || day AS cluster_id"
_FLEET_TREE = f"""(SELECT cluster_id || '@' || {DAY_SQL} AS cluster_id, node_id, path, type, value
                   FROM ({_TREE.replace('{root}', '')}))"""
_FLEET_SOURCES = {
    "node_stats": f"""(SELECT cluster_id, node_id, path AS metric, value FROM {_FLEET_TREE}
                       WHERE type NOT IN ('OBJECT', 'NULL'))""",
    "namespace_stats": f"(SELECT {_KEYED}, node_id, namespace, metric, value FROM ({_NS_STATS}))",
    "set_stats": f"""(SELECT n.cluster_id || '@' || {DAY_SQL} AS cluster_id, n.node_id, s.key AS ns,
                        t.key AS set_name, m.key AS key, m.value ->> '$' AS value
                      FROM lens_nodes n, json_each(n.payload, '$.as_stat.statistics.set') s,
                           json_each(s.value) t, json_each(t.value) m)""",
    "security_stats": f"""(SELECT n.cluster_id || '@' || {DAY_SQL} AS cluster_id, n.node_id,
                             u.key AS usr,
                             coalesce(CAST(u.value ->> '$.connections' AS BIGINT), 0) AS connections
                           FROM lens_nodes n, json_each(n.payload, '$.as_stat.acl.users') u)""",
    "node_configs": f"""(SELECT cluster_id, node_id, replace(path, 'as_stat.config.', '') AS config_name,
                           coalesce(value, 'None') AS value
                         FROM {_FLEET_TREE} WHERE path LIKE 'as_stat.config.%' AND type <> 'OBJECT')""",
    "system_info": f"""(SELECT n.cluster_id || '@' || {DAY_SQL} AS cluster_id, n.node_id, m.key AS metric,
                          m.value ->> '$' AS value
                        FROM lens_nodes n, json_each(n.payload, '$.sys_stat') m)""",
    "cluster_metadata": f"(SELECT {_KEYED}, key, value FROM ({_META_SQL}))",
}


@query("fleet_run_all", run_all_sql(_FLEET_SOURCES))
def fleet_run_all(spark, d):
    """Documents to tables to verdicts: the whole way."""
    results = rules.run_all(fleet_tables(spark, d))
    return shown(results, F.concat_ws("@", "cluster_id", day()))


@query(
    "rint_validate",
    "SELECT DISTINCT cluster_id, '1.c' AS id, 'error text' AS problem FROM lens_ns",
)
def rint_validate(spark, d):
    """A fleet without node statistics: the version rule cannot run, and the gate says so."""
    tables = {"namespace_stats": lens(spark, d, "lens_ns")}
    return rules.validate_results(rules.run_all(tables, keys=C), C)


@query(
    "findings",
    f"""WITH ver AS (SELECT cluster_id, value, count(*) AS n, count(*) OVER (PARTITION BY cluster_id) AS k
                    FROM lens_ver GROUP BY cluster_id, value),
       {_SETTINGS.replace("{node_configs}", "lens_cfg")},
       sets AS (SELECT cluster_id, ns, set_name, count(*) AS n, avg(CAST(value AS DOUBLE)) AS mean,
                       greatest(max(CAST(value AS DOUBLE)) - avg(CAST(value AS DOUBLE)),
                                avg(CAST(value AS DOUBLE)) - min(CAST(value AS DOUBLE))) AS dev
                FROM lens_sets GROUP BY ALL)
       SELECT cluster_id, '1.c' AS id, value AS entity, value || ' (' || n || ' nodes)' AS detail,
              CAST(n AS DOUBLE) AS score FROM ver WHERE k > 1
       UNION ALL
       SELECT cluster_id, '2.a', ns, ns, NULL FROM ns_
       WHERE seen_a AND flash_a AND has_sindex AND NOT sindex_flash
       UNION ALL
       SELECT cluster_id, '2.b', ns, ns || ' (' || sprigs || ' sprigs)', CAST(sprigs AS DOUBLE) FROM ns_
       WHERE seen_b AND flash_b AND CAST(sprigs AS BIGINT) <= 256
       UNION ALL
       SELECT cluster_id, '2.c', ns, ns || ' (defrag ' || defrag || '%, high water ' || hwm || '%)',
              CAST(defrag AS DOUBLE) FROM ns_
       WHERE seen_c AND (CAST(defrag AS BIGINT) < 40 OR CAST(defrag AS BIGINT) < CAST(hwm AS BIGINT))
       UNION ALL
       SELECT cluster_id, '3.a', config_name, config_name, CAST(count(DISTINCT value) AS DOUBLE) FROM lens_cfg
       GROUP BY cluster_id, config_name HAVING count(DISTINCT value) > 1
       UNION ALL
       SELECT l.cluster_id, '3.b', l.config_name, l.config_name, CAST(count(*) AS DOUBLE)
       FROM lens_cfg l JOIN lens_static s USING (cluster_id, node_id, config_name)
       WHERE l.value <> s.value GROUP BY ALL
       UNION ALL
       SELECT cluster_id, '4.f', ns || ':' || set_name,
              concat(ns, ':', set_name, ' (', format('{{:.1f}}', dev / mean * 100.0), '% skew)'),
              dev / mean * 100.0 FROM sets
       WHERE n >= 2 AND mean >= 1000 AND dev / mean * 100.0 > 10""",
)
def findings(spark, d):
    return rules.findings(lens_tables(spark, d), C)


@query(
    "finding_texts",
    """WITH f AS (SELECT cluster_id, config_name AS entity FROM lens_cfg
                  GROUP BY cluster_id, config_name HAVING count(DISTINCT value) > 1),
       r AS (SELECT *, coalesce(sum(length(entity) + 2) OVER (
               PARTITION BY cluster_id ORDER BY entity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               // 500 AS chunk FROM f)
       SELECT cluster_id, '3.a' AS id, CAST(chunk AS BIGINT) AS chunk, count(*) AS n,
              string_agg(entity, ', ' ORDER BY entity) AS text FROM r GROUP BY ALL""",
)
def finding_texts(spark, d):
    found = rules.findings({"node_configs": lens(spark, d, "lens_cfg")}, C, ["3.a"])
    return rules.finding_texts(found, C, 500)


# --- report datasets ---------------------------------------------------------------------------------


@query(
    "a11_status_counts",
    f"""SELECT cluster_id, count(*) FILTER (status = 'CRITICAL') AS n_critical,
              count(*) FILTER (status = 'WARNING') AS n_warning,
              count(*) FILTER (status = 'DATA MISSING') AS n_missing,
              count(*) FILTER (status = 'PASS') AS n_pass
        FROM ({LENS_RESULTS}) GROUP BY cluster_id""",
)
def a11(spark, d):
    return op.status_counts(lens_results(spark, d), C)


_CONTEXT_SQL = f"""
    WITH m AS ({_META_SQL}),
    w AS (
      SELECT cluster_id, day,
        max(CASE WHEN key = 'cluster_name' THEN value END) AS cluster_name,
        max(CASE WHEN key = 'server_version' THEN value END) AS server_version,
        max(CASE WHEN key = 'cloud_platform' THEN value END) AS cloud_platform,
        max(CASE WHEN key = 'consistency_model' THEN value END) AS consistency,
        max(CASE WHEN key = 'storage_flavor' THEN value END) AS storage,
        max(CASE WHEN key = 'topology' THEN value END) AS topology
      FROM m GROUP BY ALL),
    n AS (SELECT concat('c', c_nationkey) AS cluster_id, count(*) AS node_count FROM customer GROUP BY 1),
    f AS (SELECT cluster_id, day, string_agg(DISTINCT feature, ', ' ORDER BY feature) AS active_features
          FROM ({_FEATURE_SQL}) GROUP BY ALL)
    SELECT w.*, n.node_count, CASE WHEN cluster_id < 'c2' THEN 'Flash (All-Flash)' ELSE 'RAM (shmem)' END
      AS index_location, f.active_features
    FROM w JOIN n USING (cluster_id) JOIN f USING (cluster_id, day)"""

_CONTEXT_TABLES = ("cluster_metadata", "node_stats", "namespace_stats", "active_features")


def fleet_context(spark: SparkSession, d: str) -> DataFrame:
    return report.cluster_context(fleet_tables(spark, d, *_CONTEXT_TABLES))


@query("p1_cluster_context", _CONTEXT_SQL)
def p1(spark, d):
    context = fleet_context(spark, d)
    return context.select("*", day()).drop("run_id", "snapshot_ts")


def _assessment_sql(warnings: str, limit: int) -> str:
    return f"""
    WITH c AS (
      SELECT cluster_id, count(*) FILTER (status = 'CRITICAL') AS crit_count,
             count(*) FILTER ({warnings}) AS warn_count
      FROM ({LENS_RESULTS}) GROUP BY cluster_id)
    SELECT *, CASE WHEN crit_count > 0 THEN 'immediate intervention'
                   WHEN warn_count > {limit} THEN 'resource pressure' ELSE 'healthy' END AS level,
              CASE WHEN crit_count > 0 THEN crit_count || ' critical findings need immediate intervention.'
                   WHEN warn_count > {limit} THEN warn_count || ' findings are signs of resource pressure.'
                   ELSE 'The cluster is healthy.' END AS assessment
    FROM c"""


@query("p2_assessment", _assessment_sql("status IN ('WARNING', 'DATA MISSING')", 0))
def p2(spark, d):
    return report.assessment(lens_results(spark, d), keys=C)


@query("p2_assessment_older", _assessment_sql("status = 'WARNING'", 3))
def p2_older(spark, d):
    return report.assessment(lens_results(spark, d), "older", C)


def _mark_sql(status: str, other: str) -> str:
    return (
        f"CASE {status} WHEN 'PASS' THEN '✅' WHEN 'WARNING' THEN '⚠️' "
        f"WHEN 'CRITICAL' THEN chr(128680) ELSE '{other}' END"
    )


@query(
    "p3_vitals",
    "SELECT cluster_id, "
    + ", ".join(
        f"max(CASE WHEN id = '{i}' THEN status END) AS {n}_status, "
        f"max(CASE WHEN id = '{i}' THEN message END) AS {n}_message, "
        f"max(CASE WHEN id = '{i}' THEN {_mark_sql('status', '❓')} END) AS {n}_mark"
        for n, i in [("integrity", "3.a"), ("capacity", "5.a"), ("security", "6.a")]
    )
    + f" FROM ({LENS_RESULTS}) GROUP BY cluster_id",
)
def p3(spark, d):
    shown_rules = [rule_id for _, rule_id, _ in VITALS]
    return report.vitals(rules.run_all(lens_tables(spark, d), shown_rules, C), C)


@query(
    "p4_narrative",
    f"""SELECT cluster_id, day, 'Cluster ' || cluster_name || ' runs version ' || server_version || ' on '
          || node_count || ' nodes as a ' || CASE WHEN consistency LIKE 'Strong%'
            THEN 'strongly consistent (SC)' ELSE 'highly available (AP)' END
          || ' deployment; the findings put ' || CASE WHEN consistency LIKE 'Strong%'
            THEN 'safe writes while the network is split' ELSE 'throughput and headroom' END
          || ' first.' || CASE WHEN topology = 'XDR Enabled'
            THEN ' Replication between data centers is on, so watch the bandwidth between them.'
            ELSE '' END AS narrative
        FROM ({_CONTEXT_SQL})""",
)
def p4(spark, d):
    return report.narrative(fleet_context(spark, d)).select("cluster_id", day(), "narrative")


@query(
    "p5_issues",
    f"""SELECT cluster_id, id, name, status,
              CASE status WHEN 'CRITICAL' THEN 'important' ELSE 'warning' END AS callout,
              message, coalesce(remediation, '{DEFAULT_REMEDIATION}') AS remediation
        FROM ({LENS_RESULTS}) WHERE status <> 'PASS'""",
)
def p5(spark, d):
    return report.issues(lens_results(spark, d), C)


@query(
    "p6_appendix",
    f"""SELECT cluster_id, id, name, {_mark_sql('status', '⚠️')} || ' ' || status AS status,
               trim(message) AS summary
        FROM ({LENS_RESULTS}) ORDER BY id""",
)
def p6(spark, d):
    return report.appendix(lens_results(spark, d), C)


@query(
    "p7_disk_usage",
    """SELECT cluster_id, node_id, namespace, max(value) AS used_pct FROM lens_ns
       WHERE metric ILIKE '%data_used_pct%' GROUP BY ALL""",
)
def p7(spark, d):
    return report.disk_usage(lens(spark, d, "lens_ns"), C)


@query(
    "p8_connections",
    """SELECT cluster_id, node_id, CAST(value AS BIGINT) AS connections FROM lens_node_stats
       WHERE metric = 'as_stat.statistics.service.client_connections'""",
)
def p8(spark, d):
    return report.client_connections(lens(spark, d, "lens_node_stats"), C)


@query(
    "p9_hot_key_by_node",
    """SELECT cluster_id, node_id, sum(value) AS key_busy FROM lens_ns_counters
       WHERE metric ILIKE '%fail_key_busy%' OR metric ILIKE '%client_key_busy%' GROUP BY ALL""",
)
def p9(spark, d):
    return report.hot_key_by_node(lens(spark, d, "lens_ns_counters"), C)


# --- catalogue rules -----------------------------------------------------------------------------------

_BOTH = "(SELECT *, unnest([0, 1]) AS s FROM customer)"
_NS = "(SELECT *, unnest([0, 1]) AS i FROM (SELECT *, unnest([0, 1]) AS s FROM customer))"


def _judged_sql(source: str, value: str, breach: str, lowest: bool = False) -> str:
    """Verdict numbers of a rule, from the customers the telemetry was made of."""
    extreme = "min" if lowest else "max"
    return f"""
    WITH x AS (SELECT concat('c', c_nationkey) AS cluster_id, 19723 + s AS day,
                      CAST({value} AS DOUBLE) AS value FROM {source} t
               WHERE {value} IS NOT NULL)
    SELECT cluster_id, day, CASE WHEN count(*) FILTER ({breach}) > 0 THEN 'WARNING' ELSE 'PASS' END
             AS status,
           CAST(count(*) AS DOUBLE) AS n_rows, CAST(count(*) FILTER ({breach}) AS DOUBLE) AS n_breach,
           {extreme}(value) AS extreme
    FROM x GROUP BY ALL"""


def _first_day_missing(sql: str) -> str:
    """Rates begin with the second snapshot."""
    return f"""
    {sql} HAVING day = 19724
    UNION ALL
    SELECT DISTINCT concat('c', c_nationkey), 19723, 'DATA MISSING', CAST(NULL AS DOUBLE),
           CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM customer"""


def _catalog_query(rule_id: str, needs: list[str], evidence=("n_rows", "n_breach", "extreme"), **params):
    def run(spark, d):
        results = rules.run_rule(fleet_tables(spark, d, *needs), rule_id, **params)
        return results.select(
            "cluster_id", day(), "status", *[F.col("evidence")[e].alias(e) for e in evidence]
        )

    return run


_K = "c_custkey"
for _name, _id, _needs, _params, _sql in [
    (
        "c1e_huge_pages", "C-1e", ["system_info"], {},
        _judged_sql(_BOTH, "CASE WHEN c_nationkey % 5 = 1 THEN 1 ELSE 0 END", "value = 1"),
    ),
    (
        "c1f_clock_skew", "C-1f", ["node_stats"], {},
        _judged_sql(_BOTH, f"CASE WHEN {_K} % 500 = 0 THEN 3 ELSE 0 END", "value > 0"),
    ),
    (
        "c2b_sprig_ratio", "C-2b", ["namespace_stats", "node_configs"], {"max_ratio": 40.0},
        _judged_sql(
            _NS,
            f"CAST({_K} * (i + 1) + 2000 AS DOUBLE)"
            " / CASE WHEN c_nationkey % 3 = 0 THEN 64.0::DOUBLE ELSE 4096.0::DOUBLE END",
            "value > 40",
        ),
    ),
    (
        "c2c_defrag_margin", "C-2c", ["namespace_stats", "node_configs"], {},
        _judged_sql(
            _NS, f"abs(({_K} + i) % 60 + s * 20 + 0.5::DOUBLE - 50)", "value <= 5", lowest=True
        ),
    ),
    (
        "c2e_free_memory", "C-2e", ["node_stats"], {},
        _judged_sql(_BOTH, f"15 + {_K} % 80", "value < 20", lowest=True),
    ),
    (
        "c2f_heap_efficiency", "C-2f", ["node_stats"], {},
        _judged_sql(_BOTH, f"58 + {_K} % 40", "value < 60", lowest=True),
    ),
    (
        "c2g_nsup_lag", "C-2g", ["namespace_stats", "node_configs"], {},
        _judged_sql(_NS, f"{_K} % 130 - 120", "value > 0"),
    ),
    (
        "c3c_fd_capacity", "C-3c", ["node_stats", "node_configs"], {},
        _judged_sql(_BOTH, f"CAST({_K} % 900 AS DOUBLE) / 1000.0::DOUBLE", "value >= 0.8"),
    ),
    (
        "c3d_min_cluster_size", "C-3d", ["node_configs"], {},
        _judged_sql(_BOTH, "1 + c_nationkey % 2", "value = 1", lowest=True),
    ),
    (
        "c4a_hot_key_rate", "C-4a", ["namespace_stats"], {},
        _first_day_missing(
            _judged_sql(
                _NS,
                f"CASE WHEN c_nationkey % 4 = 1 THEN {_K} * 10000.0::DOUBLE ELSE 0 END / 86400.0::DOUBLE",
                "value > 100",
            )
        ),
    ),
    (
        "c4d_batch_success", "C-4d", ["namespace_stats"], {"min_pct": 90.0},
        _judged_sql(
            _NS,
            f"CAST({_K} % 90 AS DOUBLE) / nullif({_K} % 90 + {_K} % 10, 0) * 100.0::DOUBLE",
            "value < 90",
            lowest=True,
        ),
    ),
    (
        "c4h_cache_reads", "C-4h", ["namespace_stats"], {},
        _judged_sql(_NS, f"85 + {_K} % 16", "value < 90", lowest=True),
    ),
    (
        "c4i_proxy_rate", "C-4i", ["namespace_stats"], {},
        _first_day_missing(
            _judged_sql(_NS, f"{_K} * 100000.0::DOUBLE / 86400.0::DOUBLE", "value > 1000")
        ),
    ),
    (
        "c6a_user_limit_fleet", "C-6a", ["security_stats"], {},
        _judged_sql(
            "(SELECT *, unnest([0, 1, 2]) AS u FROM (SELECT *, unnest([0, 1]) AS s FROM customer))",
            f"CASE u WHEN 0 THEN {_K} % 700 WHEN 1 THEN 0 ELSE {_K} % 3 END",
            "value > 500",
        ),
    ),
]:
    query(_name, _sql)(_catalog_query(_id, _needs, **_params))


def _whole_cluster_sql(value: str, breach: str, source: str) -> str:
    return f"""
    WITH x AS (SELECT concat('c', c_nationkey) AS cluster_id, 19723 + s AS day, {value} AS value
               FROM {source} t GROUP BY ALL)
    SELECT cluster_id, day, CASE WHEN {breach} THEN 'WARNING' ELSE 'PASS' END AS status,
           CAST(1 AS DOUBLE) AS n_rows, CASE WHEN {breach} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS n_breach,
           CAST(value AS DOUBLE) AS extreme
    FROM x"""


_ERRORS = (
    f"CAST(CASE WHEN c_nationkey % 2 = 0 AND {_K} % 60 = 0 THEN 5000 ELSE {_K} % 7 END AS DOUBLE)"
)
query(
    "c1a_error_deviation",
    _whole_cluster_sql(
        f"greatest(max({_ERRORS}) - avg({_ERRORS}), avg({_ERRORS}) - min({_ERRORS})) / avg({_ERRORS}) * 100.0",
        "value > 20",
        _BOTH,
    ),
)(_catalog_query("C-1a", ["node_stats"]))
query(
    "c4e_latency",
    _whole_cluster_sql(f"quantile_disc(85 + {_K} % 16, 0.5)", "value > 92", _NS),
)(_catalog_query("C-4e", ["namespace_stats"], metric="cache_read_pct", max_latency=92.0, quantile=0.5))
query(
    "c5b_license", _whole_cluster_sql(f"sum({_K} * 1000)", "value > 90000000", _NS)
)(_catalog_query("C-5b", ["namespace_stats"], limit=90_000_000.0))
query(
    "c5a_projection_fleet",
    """SELECT DISTINCT concat('c', c_nationkey) AS cluster_id, 19723 + s AS day,
              CASE s WHEN 0 THEN 'PASS' ELSE 'DATA MISSING' END AS status,
              CASE s WHEN 1 THEN 2.0::DOUBLE END AS n_points
       FROM (SELECT *, unnest([0, 1]) AS s FROM customer)""",
)(_catalog_query("C-5a", ["namespace_stats"], evidence=["n_points"]))


def _ratio_sql(hit: str, miss: str, limit: int) -> str:
    return f"""
    WITH a AS (SELECT cluster_id, coalesce(sum(value) FILTER (metric = 'service.{hit}'), 0.0) AS hits,
                      coalesce(sum(value) FILTER (metric = 'service.{miss}'), 0.0) AS misses
               FROM lens_ns_counters GROUP BY cluster_id)
    SELECT cluster_id, CASE WHEN misses / (hits + misses) * 100.0 > {limit} THEN 'WARNING' ELSE 'PASS' END
             AS status, hits, misses, misses / (hits + misses) * 100.0 AS pct
    FROM a"""


def _ratio_query(rule_id: str):
    def run(spark, d):
        tables = {"namespace_stats": lens(spark, d, "lens_ns_counters")}
        return rules.run_rule(tables, rule_id, C).select(
            *C, "status", *[F.col("evidence")[e].alias(e) for e in ("hits", "misses", "pct")]
        )

    return run


query("c4b_read_ratio", _ratio_sql("client_read_success", "client_read_not_found", 5))(
    _ratio_query("C-4b")
)
query("c4c_delete_ratio", _ratio_sql("client_delete_success", "client_delete_not_found", 1))(
    _ratio_query("C-4c")
)


@query(
    "c6a_user_limit",
    """SELECT cluster_id, CASE WHEN max(connections) > 200 THEN 'WARNING' ELSE 'PASS' END AS status,
              CAST(count(*) FILTER (connections > 200) AS DOUBLE) AS n_breach
       FROM lens_sec GROUP BY cluster_id""",
)
def c6a(spark, d):
    results = rules.run_rule({"security_stats": security(spark, d)}, "C-6a", C, max_conns=200)
    return results.select(*C, "status", F.col("evidence")["n_breach"].alias("n_breach"))


@query(
    "c4a_rate",
    """SELECT cluster_id, node_id, d, used_pct, (used_pct - lag(used_pct) OVER w)
                / datediff('day', lag(d) OVER w, d) AS rate
       FROM lens_ts WINDOW w AS (PARTITION BY cluster_id, node_id ORDER BY d)""",
)
def c4a_rate(spark, d):
    """Growth per day; a bucket is ten days of an entity here, since there is one reading a day."""
    bucket = F.floor(F.unix_date("d") / 10)
    return op.counter_rates(
        lens(spark, d, "lens_ts"), ["cluster_id", "node_id"], "d", "used_pct", bucket, 86400.0
    )


@query(
    "c5a_forecast",
    """WITH x AS (SELECT cluster_id, node_id, datediff('day', date '2024-01-01', d) AS day, used_pct
                  FROM lens_ts),
       f AS (SELECT cluster_id, node_id, count(DISTINCT day) AS n_points,
                    regr_slope(used_pct, day) AS slope, regr_intercept(used_pct, day) AS icept,
                    max(day) AS last_day
             FROM x GROUP BY ALL)
       SELECT cluster_id, node_id, n_points,
              round((60.0 - (slope * last_day + icept)) / slope, 4) AS days_left
       FROM f WHERE n_points >= 3 AND slope > 0""",
)
def c5a_forecast(spark, d):
    rows = lens(spark, d, "lens_ts").withColumn("day", F.datediff("d", F.lit("2024-01-01")))
    out = op.days_to_limit(rows, ["cluster_id", "node_id"], "day", "used_pct", 60.0)
    return out.filter(F.col("days_left").isNotNull()).select(
        "cluster_id", "node_id", "n_points", F.round("days_left", 4).alias("days_left")
    )


assert set(ORACLE) <= set(QUERIES), set(ORACLE) - set(QUERIES)
