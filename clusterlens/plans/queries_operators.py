"""Queries of the scalar functions and the generic operators, each with its DuckDB text."""

from __future__ import annotations

from pyspark.sql import functions as F

from clusterlens import functions as fn
from clusterlens import operators as op
from clusterlens import rules
from clusterlens.operators.filters import band
from clusterlens.plans.lens import lens
from clusterlens.plans.oracle import INT, ORACLE, _rule_sql
from clusterlens.plans.queries import C, QUERIES, drivers, node_stats, security

CN = ["cluster_id", "node_id"]


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


# --- scalar functions --------------------------------------------------------------------------


@query(
    "x1_lenient_numbers",
    """SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS real_value,
              CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS int_value, 0.0::DOUBLE AS no_number
       FROM events""",
)
def x1(spark, d):
    tail = F.substr(F.col("props"), F.lit(7))
    return lens(spark, d, "events").select(
        "event_id",
        fn.lenient_double(tail).alias("real_value"),
        fn.lenient_bigint(tail).alias("int_value"),
        fn.lenient_double("props").alias("no_number"),
    )


@query(
    "x2_numeric_guard",
    """SELECT cluster_id, config_name, value, regexp_full_match(value, '[0-9]+') AS plain
       FROM lens_cfg""",
)
def x2(spark, d):
    return lens(spark, d, "lens_cfg").select(
        "cluster_id", "config_name", "value", fn.is_plain_number("value").alias("plain")
    )


@query(
    "x3_dotted_parts",
    """SELECT config_name, string_split(config_name, '.')[2] AS ns,
              string_split(config_name, '.')[-1] AS setting,
              string_split(config_name, '.')[4] AS fourth
       FROM lens_cfg""",
)
def x3(spark, d):
    return lens(spark, d, "lens_cfg").select(
        "config_name",
        fn.dotted_part("config_name", 2).alias("ns"),
        fn.last_part("config_name").alias("setting"),
        fn.dotted_part("config_name", 4).alias("fourth"),
    )


@query(
    "x4_path_get",
    """SELECT cluster_id, node_id,
         coalesce(nullif(payload ->> '$.as_stat.meta_data.asd_build', ''),
                  payload ->> '$.as_stat.statistics.service.asd_build') AS build,
         'none' AS fallback
       FROM lens_nodes""",
)
def x4(spark, d):
    v = F.parse_json("payload")
    paths = ["$.as_stat.meta_data.asd_build", "$.as_stat.statistics.service.asd_build"]
    return lens(spark, d, "lens_nodes").select(
        "cluster_id",
        "node_id",
        fn.path_get(v, paths, falsy_empty=True).alias("build"),
        fn.path_get(v, ["$.no.such", "$.path"], "none").alias("fallback"),
    )


@query(
    "x5_text_functions",
    """SELECT p_partkey, lower(p_brand) AS low, upper(p_type) AS up,
              p_name LIKE '%a%' OR p_name LIKE '%or%' AS has_any,
              starts_with(p_brand, 'Brand#1') AS starts, p_brand || '/' || p_type AS joined
       FROM part""",
)
def x5(spark, d):
    return lens(spark, d, "part").select(
        "p_partkey",
        F.lower("p_brand").alias("low"),
        F.upper("p_type").alias("up"),
        fn.contains_any("p_name", ["a", "or"]).alias("has_any"),
        F.startswith("p_brand", F.lit("Brand#1")).alias("starts"),
        F.concat_ws("/", "p_brand", "p_type").alias("joined"),
    )


@query(
    "x6_messages",
    f"""SELECT o_orderkey,
          {INT.format('o_totalprice')} || ' of ' || format('{{:,}}', {INT.format('o_totalprice')}) AS text
        FROM orders""",
)
def x6(spark, d):
    return lens(spark, d, "orders").select(
        "o_orderkey",
        fn.msg("%s of %s", fn.as_int_text("o_totalprice"), fn.thousands("o_totalprice")).alias("text"),
    )


@query(
    "x7_pct_dev",
    """SELECT l_orderkey, l_linenumber, abs(l_quantity - 25.0) / 25.0 * 100.0 AS dev FROM lineitem""",
)
def x7(spark, d):
    return lens(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", fn.pct_dev("l_quantity", F.lit(25.0)).alias("dev")
    )


@query(
    "x8_status_mark",
    """SELECT s_suppkey,
         CASE WHEN s_acctbal >= 7500 THEN chr(128680) WHEN s_acctbal >= 6000 THEN '⚠️' ELSE '✅' END
           AS mark,
         CASE WHEN s_acctbal >= 7500 THEN chr(128680) WHEN s_acctbal >= 6000 THEN '⚠️' ELSE '✅' END
           AS appendix_mark
       FROM supplier""",
)
def x8(spark, d):
    status = band(F.col("s_acctbal"), 6000, 7500)
    return lens(spark, d, "supplier").select(
        "s_suppkey",
        fn.status_mark(status).alias("mark"),
        fn.status_mark(status, "appendix").alias("appendix_mark"),
    )


# --- filters -----------------------------------------------------------------------------------


@query(
    "f1_metric_in",
    """SELECT cluster_id, node_id, metric, value FROM lens_node_stats
       WHERE metric = 'service.service_error' OR metric = 'service.client_proxy_error'""",
)
def f1(spark, d):
    names = ["service.service_error", "service.client_proxy_error"]
    return op.metric_in(node_stats(spark, d), names)


@query(
    "f2_metric_ilike",
    """SELECT cluster_id, node_id, metric, value FROM lens_node_stats
       WHERE metric ILIKE '%SERVICE_ERROR' OR metric ILIKE '%client_c%'""",
)
def f2(spark, d):
    return op.metric_ilike(node_stats(spark, d), ["%SERVICE_ERROR", "%client_c%"])


@query(
    "f3_keep_found",
    """SELECT cluster_id, node_id, metric, value FROM lens_node_stats
       WHERE metric IN (SELECT metric FROM lens_node_stats WHERE CAST(value AS BIGINT) > 80)""",
)
def f3(spark, d):
    stats = node_stats(spark, d)
    found = stats.filter(fn.lenient_bigint("value") > 80)
    return op.keep_found(stats, found, ["metric"])


@query(
    "f4_drop_names",
    """SELECT cluster_id, node_id, metric, value FROM lens_node_stats
       WHERE metric NOT IN ('service.service_error', 'service.signup')""",
)
def f4(spark, d):
    return op.drop_names(
        node_stats(spark, d), "metric", ["service.service_error", "service.signup"]
    )


@query(
    "f5_drop_patterns",
    """SELECT node_id, config_name, value FROM lens_cfg
       WHERE NOT regexp_matches(config_name, '.sindex|.high-water')""",
)
def f5(spark, d):
    cfg = lens(spark, d, "lens_cfg").select("node_id", "config_name", "value")
    return op.drop_patterns(cfg, "config_name", [".sindex", ".high-water"])


@query(
    "f6_value_matches",
    """SELECT cluster_id, node_id, value FROM lens_driver
       WHERE regexp_matches(value, 'ena|vfio-pci')""",
)
def f6(spark, d):
    rows = lens(spark, d, "lens_driver").select("cluster_id", "node_id", "value")
    return op.value_matches(rows, "ena|vfio-pci")


@query(
    "f7_values_differ",
    """SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_discount <> l_tax""",
)
def f7(spark, d):
    rows = lens(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return op.values_differ(rows, "l_discount", "l_tax")


@query(
    "f8_having",
    """SELECT config_name, count(DISTINCT value) AS variations FROM lens_cfg
       GROUP BY config_name HAVING count(DISTINCT value) > 1""",
)
def f8(spark, d):
    counted = op.count_distinct(lens(spark, d, "lens_cfg"), ["config_name"], "value", "variations")
    return op.having(counted, F.col("variations") > 1)


@query(
    "f9_threshold_band",
    """WITH ranked AS (
         SELECT *, row_number() OVER (
                  PARTITION BY cluster_id, metric ORDER BY value DESC, namespace, node_id) AS rn,
                count(*) OVER (PARTITION BY cluster_id, metric) AS n_rows
         FROM lens_ns)
       SELECT cluster_id, metric, value AS peak, namespace AS worst_namespace,
              node_id AS worst_node_id, n_rows,
              CASE WHEN value > 80 THEN 'CRITICAL' WHEN value > 60 THEN 'WARNING' ELSE 'PASS' END
                AS status
       FROM ranked WHERE rn = 1""",
)
def f9(spark, d):
    return op.threshold_band(
        lens(spark, d, "lens_ns"),
        ["cluster_id", "metric"],
        "value",
        60,
        80,
        strict=True,
        entity=["namespace", "node_id"],
    )


@query(
    "f10_with_missing",
    """SELECT c.cluster_id, coalesce(a.total, 0.0) AS total, coalesce(a.status, 'PASS') AS status
       FROM (SELECT DISTINCT cluster_id FROM lens_ns) c LEFT JOIN (
         SELECT cluster_id, sum(value) AS total,
                CASE WHEN sum(value) > 100000 THEN 'WARNING' ELSE 'PASS' END AS status
         FROM lens_ns_counters WHERE metric = 'service.fail_key_busy' GROUP BY cluster_id) a
         USING (cluster_id)""",
)
def f10(spark, d):
    clusters = lens(spark, d, "lens_ns").select("cluster_id").distinct()
    busy = op.metric_in(lens(spark, d, "lens_ns_counters"), ["service.fail_key_busy"])
    totals = op.sum_limit(busy, C, "value", 100000)
    return op.with_missing(clusters, totals, C, {"total": 0.0, "status": "PASS"})


# --- joins -------------------------------------------------------------------------------------


@query(
    "j1_value_drift",
    """SELECT l.cluster_id, l.node_id, l.config_name, l.value AS live_value, s.value AS static_value
       FROM lens_live l JOIN lens_static s
         ON l.cluster_id = s.cluster_id AND l.node_id = s.node_id AND l.config_name = s.config_name
       WHERE l.value <> s.value""",
)
def j1(spark, d):
    return op.value_drift(
        lens(spark, d, "lens_live"),
        lens(spark, d, "lens_static"),
        ["cluster_id", "node_id", "config_name"],
    )


@query(
    "j2_paired_settings",
    """WITH k AS (
         SELECT split_part(config_name, '.', 2) AS ns, split_part(config_name, '.', -1) AS setting,
                value, row_number() OVER (
                  PARTITION BY split_part(config_name, '.', 2), split_part(config_name, '.', -1)
                  ORDER BY node_id, value) AS rn
         FROM lens_cfg)
       SELECT ns, coalesce(max(CASE WHEN setting = 'defrag-lwm-free-pct' THEN value END), '50')
                AS defrag,
              coalesce(max(CASE WHEN setting = 'high-water-disk-pct' THEN value END), '50')
                AS hwm
       FROM k WHERE rn = 1 AND setting IN ('defrag-lwm-free-pct', 'high-water-disk-pct')
       GROUP BY ns""",
)
def j2(spark, d):
    cfg = lens(spark, d, "lens_cfg").select(
        "node_id",
        "value",
        fn.dotted_part("config_name", 2).alias("ns"),
        fn.last_part("config_name").alias("setting"),
    )
    return op.paired_settings(
        cfg,
        ["ns"],
        "setting",
        "value",
        ["node_id"],
        {"defrag-lwm-free-pct": "50", "high-water-disk-pct": "50"},
    ).toDF("ns", "defrag", "hwm")


@query(
    "j3_with_metadata",
    """SELECT n.cluster_id, n.node_id, n.metric, n.value,
              coalesce(m.cloud_platform, 'Unknown') AS platform
       FROM lens_ns n LEFT JOIN (
         SELECT DISTINCT cluster_id, cloud_platform FROM lens_driver) m USING (cluster_id)""",
)
def j3(spark, d):
    _, meta = drivers(spark, d)
    rows = lens(spark, d, "lens_ns").select("cluster_id", "node_id", "metric", "value")
    return op.with_metadata(rows, meta, "cloud_platform", keys=C, alias="platform")


@query(
    "j4_pick_rule",
    f"""SELECT c.cluster_id, coalesce(r.status, 'PASS') AS status,
              coalesce(r.message, 'nothing said') AS message
        FROM (SELECT DISTINCT cluster_id FROM lens_ns) c
        LEFT JOIN ({_rule_sql("6.a", security_stats="lens_sec")}) r USING (cluster_id)""",
)
def j4(spark, d):
    clusters = lens(spark, d, "lens_ns").select("cluster_id").distinct()
    results = rules.run_rule({"security_stats": security(spark, d)}, "6.a", C)
    return op.pick_rule(clusters, results, "6.a", C, "PASS", "nothing said")


@query(
    "j5_semi_anti",
    """SELECT c_custkey, c_name, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders
       FROM customer""",
)
def j5(spark, d):
    customers = lens(spark, d, "customer").select("c_custkey", "c_name")
    orders = lens(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    having = op.keep_in(customers, orders, ["c_custkey"]).withColumn("has_orders", F.lit(True))
    lacking = op.keep_not_in(customers, orders, ["c_custkey"]).withColumn(
        "has_orders", F.lit(False)
    )
    return having.unionByName(lacking)


# --- aggregates ----------------------------------------------------------------------------------


@query(
    "a1_sum_by",
    """SELECT cluster_id, usr AS "user", CAST(sum(connections) AS BIGINT) AS total
       FROM lens_sec GROUP BY cluster_id, usr""",
)
def a1(spark, d):
    return op.sum_by(security(spark, d), ["cluster_id", "user"], "connections")


@query(
    "a2_share_of_total",
    """WITH u AS (SELECT cluster_id, usr AS "user", CAST(sum(connections) AS BIGINT) AS amount
                  FROM lens_sec GROUP BY cluster_id, usr)
       SELECT cluster_id, "user", amount,
              CAST(sum(amount) OVER (PARTITION BY cluster_id) AS BIGINT) AS total,
              CAST(amount AS DOUBLE) / CAST(sum(amount) OVER (PARTITION BY cluster_id) AS DOUBLE)
                * 100.0 AS pct
       FROM u""",
)
def a2(spark, d):
    return op.share_of_total(security(spark, d), C, ["user"], "connections")


@query(
    "a3_distinct_drift",
    """SELECT cluster_id, config_name, count(DISTINCT value) AS variations FROM lens_cfg
       GROUP BY cluster_id, config_name HAVING count(DISTINCT value) > 1""",
)
def a3(spark, d):
    return op.distinct_drift(lens(spark, d, "lens_cfg"), ["cluster_id", "config_name"], "value")


@query(
    "a4_count_distinct",
    "SELECT cluster_id, count(DISTINCT node_id) AS node_count FROM lens_node_stats GROUP BY cluster_id",
)
def a4(spark, d):
    return op.count_distinct(node_stats(spark, d), C, "node_id", "node_count")


@query(
    "a5_max_of",
    """SELECT cluster_id, node_id, namespace, max(value) AS peak FROM lens_ns
       WHERE metric ILIKE '%data_used_pct%' GROUP BY cluster_id, node_id, namespace""",
)
def a5(spark, d):
    rows = op.metric_ilike(lens(spark, d, "lens_ns"), ["%data_used_pct%"])
    return op.max_of(rows, ["cluster_id", "node_id", "namespace"], "value")


@query(
    "a6_lenient_sum",
    """SELECT cluster_id, node_id, sum(CAST(value AS DOUBLE)) AS total FROM lens_node_stats
       GROUP BY cluster_id, node_id""",
)
def a6(spark, d):
    return op.sum_by(node_stats(spark, d), CN, "value", lenient=True)


@query(
    "a7_mean_skew",
    """WITH r AS (
         SELECT cluster_id, metric, node_id, CAST(value AS DOUBLE) AS x, row_number() OVER (
           PARTITION BY cluster_id, metric ORDER BY CAST(value AS DOUBLE) DESC, node_id) AS rn
         FROM lens_node_stats)
       SELECT cluster_id, metric, sum(x) AS total, avg(x) AS mean, max(x) AS peak,
              count(*) AS n_rows, max(CASE WHEN rn = 1 THEN node_id END) AS worst,
              CASE WHEN max(x) > avg(x) * 2 AND max(x) > 100 THEN 'WARNING' ELSE 'PASS' END AS status
       FROM r GROUP BY cluster_id, metric""",
)
def a7(spark, d):
    rows = node_stats(spark, d).withColumn("x", fn.lenient_double("value"))
    return op.mean_skew(rows, ["cluster_id", "metric"], "node_id", "x")


@query(
    "a8_deviation_skew",
    """WITH m AS (
         SELECT l_returnflag, l_linestatus, l_suppkey, count(*) AS c FROM lineitem GROUP BY ALL),
       a AS (SELECT l_returnflag, l_linestatus, count(*) AS n_rows, avg(c) AS mean,
                    greatest(max(c) - avg(c), avg(c) - min(c)) AS dev
             FROM m GROUP BY ALL)
       SELECT l_returnflag, l_linestatus, n_rows, mean, dev / mean * 100.0 AS dev_pct,
              n_rows >= 2 AND mean >= 100 AND dev / mean * 100.0 > 10 AS skewed
       FROM a""",
)
def a8(spark, d):
    flags = ["l_returnflag", "l_linestatus"]
    per = lens(spark, d, "lineitem").groupBy(*flags, "l_suppkey").agg(
        F.count(F.lit(1)).cast("double").alias("c")
    )
    return op.deviation_skew(per, flags, "c", min_avg=100)


@query(
    "a9_value_counts",
    """SELECT cluster_id, value, count(*) AS n FROM lens_ver GROUP BY cluster_id, value""",
)
def a9(spark, d):
    return op.value_counts(lens(spark, d, "lens_ver"), C, "value")


@query(
    "a10_distinct_values",
    "SELECT DISTINCT cluster_id, config_name FROM lens_cfg",
)
def a10(spark, d):
    return op.distinct_values(lens(spark, d, "lens_cfg"), C, "config_name")


@query(
    "a12_join_text",
    """WITH n AS (SELECT DISTINCT cluster_id, config_name FROM lens_cfg),
       r AS (SELECT *, coalesce(sum(length(config_name) + 2) OVER (
               PARTITION BY cluster_id ORDER BY config_name
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1000 AS chunk FROM n)
       SELECT cluster_id, CAST(chunk AS BIGINT) AS chunk, count(*) AS n,
              string_agg(config_name, '; ' ORDER BY config_name) AS text
       FROM r GROUP BY ALL""",
)
def a12(spark, d):
    return op.join_text(lens(spark, d, "lens_cfg"), C, "config_name", "; ", chunk_chars=1000)


# --- picks -----------------------------------------------------------------------------------------


@query(
    "d1_last_wins",
    """SELECT cluster_id, node_id, config_name, ord, value FROM (
         SELECT *, row_number() OVER (
           PARTITION BY cluster_id, node_id, config_name ORDER BY ord DESC) AS rn FROM lens_cfg)
       WHERE rn = 1""",
)
def d1(spark, d):
    return op.last_wins(
        lens(spark, d, "lens_cfg"), ["cluster_id", "node_id", "config_name"], ["ord"]
    )


@query(
    "d2_first_per",
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
       WHERE rn = 1""",
)
def d2(spark, d):
    orders = lens(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return op.first_per(orders, ["o_custkey"], ["o_orderkey"])


@query(
    "d3_top1",
    """SELECT l_returnflag, l_suppkey, l_quantity, l_extendedprice, l_orderkey, l_linenumber FROM (
         SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_suppkey
           ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_quantity) AS rn FROM lineitem)
       WHERE rn = 1""",
)
def d3(spark, d):
    cols = ["l_returnflag", "l_suppkey", "l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber"]
    return op.top1(
        lens(spark, d, "lineitem").select(*cols),
        ["l_returnflag", "l_suppkey"],
        "l_extendedprice",
        ["l_orderkey", "l_linenumber"],
    )


@query(
    "d4_first_names",
    """SELECT cluster_id, node_id, string_agg(config_name, ', ' ORDER BY config_name) AS names FROM (
         SELECT cluster_id, node_id, config_name, row_number() OVER (
           PARTITION BY cluster_id, node_id ORDER BY config_name) AS rn
         FROM (SELECT DISTINCT cluster_id, node_id, config_name FROM lens_cfg) t) u
       WHERE rn <= 3 GROUP BY cluster_id, node_id""",
)
def d4(spark, d):
    out = op.first_n_names(lens(spark, d, "lens_cfg"), CN, "config_name", 3)
    return out.select(*CN, F.array_join("names", ", ").alias("names"))


@query(
    "d5_sort_findings",
    f"SELECT cluster_id, id, status, total FROM ({_rule_sql('4.b', namespace_stats='lens_ns_counters')}) "
    f"UNION ALL SELECT cluster_id, id, status, total FROM "
    f"({_rule_sql('4.c', namespace_stats='lens_ns_counters')}) ORDER BY id",
)
def d5(spark, d):
    tables = {"namespace_stats": lens(spark, d, "lens_ns_counters")}
    return op.sort_findings(rules.run_all(tables, ["4.c", "4.b"], C), C).select(
        *C, "id", "status", F.col("evidence")["total"].alias("total")
    )


@query(
    "d6_union_results",
    f"SELECT cluster_id, id, status FROM ({_rule_sql('2.d', namespace_stats='lens_ns')}) "
    f"UNION ALL SELECT cluster_id, id, status FROM ({_rule_sql('6.a', security_stats='lens_sec')})",
)
def d6(spark, d):
    disk = rules.run_rule({"namespace_stats": lens(spark, d, "lens_ns")}, "2.d", C)
    users = rules.run_rule({"security_stats": security(spark, d)}, "6.a", C)
    return op.union_results(disk, users).select(*C, "id", "status")
