"""Both sides of every threshold, missing and empty tables, plug-ins and invariants."""

import datetime as dt

import pytest

from clusterlens import schema as S
from clusterlens.rules import REGISTRY, findings, rule, run_all, run_catalog, run_rule, validate_results
from clusterlens.rules.core import RULE_ORDER
from clusterlens.rules.runner import coverage, metric_names

T0 = dt.datetime(2024, 1, 1)
COLS = {
    "node_stats": lambda x: (*x, "STRING"),
    "namespace_stats": lambda x: (*x, "statistics"),
    "node_configs": lambda x: (*x, "config"),
    "cluster_metadata": lambda x: (*x, 1),
}


def table(spark, name, data):
    """Rows as (cluster, *values); the cluster becomes the key."""
    schema = S.STATIC_CONFIGS if name == "static_configs" else S.TABLES[name]
    more = COLS.get(name, lambda x: x)
    return spark.createDataFrame([("r", T0, r[0], *more(r[1:])) for r in data], schema)


def judge(spark, rule_id, strict=False, params=None, **data):
    tables = {n: table(spark, n, rows) for n, rows in data.items()}
    out = run_rule(tables, rule_id, strict_names=strict, **(params or {}))
    return {r.cluster_id: r for r in out.collect()}


def statuses(spark, rule_id, **data):
    return {c: r.status for c, r in judge(spark, rule_id, **data).items()}


ERR = "as_stat.statistics.service.service_error"


def test_error_skew(spark):
    rows = []
    for c, values in {
        "equal2": [100, 100, 400],  # mean 200, peak 400: not above twice the mean
        "above2": [100, 100, 401],
        "floor": [0, 0, 0, 100],
        "over": [0, 0, 0, 101],
        "zero": [0, 0],
        "tie": [0, 0, 0, 0, 0, 300, 300],
    }.items():
        rows += [(c, f"n{i}", ERR, str(v)) for i, v in enumerate(values)]
    rows.append(("other", "n0", "x", "1"))
    got = judge(spark, "1.a", node_stats=rows)
    assert {c: r.status for c, r in got.items()} == {
        "equal2": "PASS",
        "above2": "WARNING",
        "floor": "PASS",
        "over": "WARNING",
        "zero": "PASS",
        "tie": "WARNING",
        "other": "PASS",
    }
    assert "Node n5 " in got["tie"].message
    assert got["over"].remediation and got["zero"].remediation is None


def test_error_skew_counts_one_alias_per_node(spark):
    both = [("c", n, m, "10") for n in ("a", "b") for m in ("service.service_error", ERR)]
    r = judge(spark, "1.a", node_stats=both)["c"]
    assert (r.evidence["total"], r.evidence["n_rows"]) == (20.0, 2.0)
    only = judge(spark, "1.a", strict=True, node_stats=[("c", "a", ERR, "10")])["c"]
    assert only.evidence == {}


def test_proxy_skew_strict_counts_rows(spark):
    rows = [("c", "a", "service.client_proxy_error", "10"), ("c", "a", "client_proxy_error", "30")]
    assert judge(spark, "1.a2", node_stats=rows)["c"].evidence["total"] == 10.0
    strict = judge(spark, "1.a2", strict=True, node_stats=rows)["c"]
    assert (strict.evidence["total"], strict.evidence["n_rows"]) == (40.0, 2.0)


def test_network(spark):
    meta = [(c, "cloud_platform", p) for c, p in {"a": "AWS", "b": "Azure", "c": "aws-x", "d": "AWS"}.items()]
    info = [
        ("a", "n", "network_driver", "virtio"),
        ("b", "n", "network_driver", "virtio"),
        ("c", "n", "network_driver", "enabled"),
        ("d", "n", "host", "x"),
        ("e", "n", "network_driver", "virtio"),
    ]
    got = statuses(spark, "1.b", cluster_metadata=[*meta, ("f", "cloud_platform", "Azure")], system_info=info)
    assert got == {"a": "WARNING", "b": "PASS", "c": "PASS", "d": "WARNING", "e": "PASS", "f": "WARNING"}


def test_versions(spark):
    rows = [
        ("same", "n1", "a.build", "7"),
        ("same", "n1", "b.VERSION", "9"),
        ("same", "n2", "a.build", "7"),
        ("mixed", "n1", "build", "7"),
        ("mixed", "n2", "build", "8"),
        ("mixed", "n3", "build", "8"),
        ("none", "n1", "buildx", "8"),
    ]
    got = judge(spark, "1.c", node_stats=rows)
    assert {c: r.status for c, r in got.items()} == {
        "same": "PASS",
        "mixed": "WARNING",
        "none": "DATA MISSING",
    }
    assert "8 (2 nodes), 7 (1 nodes)" in got["mixed"].message


def cfg(c, ns, depth=".service", node="n", **settings):
    return [(c, node, f"namespace.{ns}{depth}.{k.replace('_', '-')}", v) for k, v in settings.items()]


@pytest.mark.parametrize("depth", ["", ".service"])
def test_sindex(spark, depth):
    rows = [
        *cfg("bad", "x", depth, index_type="flash", sindex_type="shmem"),
        *cfg("good", "x", depth, index_type="flash", sindex_type="flash"),
        *cfg("no_sindex", "x", depth, index_type="flash"),
        *cfg("ram", "x", depth, index_type="shmem", sindex_type="shmem"),
        *cfg("one_node", "x", depth, "n1", index_type="flash", sindex_type="shmem"),
        *cfg("one_node", "x", depth, "n2", sindex_type="flash"),
        ("other", "n", "service.x", "1"),
    ]
    assert statuses(spark, "2.a", node_configs=rows) == {
        "bad": "WARNING",
        "good": "PASS",
        "no_sindex": "PASS",
        "ram": "PASS",
        "one_node": "PASS",
        "other": "PASS",
    }


def test_strict_names_read_the_short_spelling_only(spark):
    rows = cfg("c", "x", ".service", index_type="flash", sindex_type="shmem")
    assert judge(spark, "2.a", node_configs=rows)["c"].status == "WARNING"
    assert judge(spark, "2.a", strict=True, node_configs=rows)["c"].status == "PASS"
    rows = cfg("c", "x", ".service", index_type="flash", partition_tree_sprigs="4096")
    assert judge(spark, "2.b", node_configs=rows)["c"].status == "PASS"
    assert judge(spark, "2.b", strict=True, node_configs=rows)["c"].status == "WARNING"


def test_sprigs(spark):
    rows = [
        *cfg("at", "x", index_type="flash", partition_tree_sprigs="256"),
        *cfg("above", "x", index_type="flash", partition_tree_sprigs="257"),
        *cfg("default", "x", index_type="flash"),
        *cfg("ram", "x", index_type="shmem", partition_tree_sprigs="1"),
        *cfg("text", "x", index_type="flash", partition_tree_sprigs="50.5"),
        *cfg("first", "x", node="n1", index_type="flash", partition_tree_sprigs="4096"),
        *cfg("first", "x", node="n2", partition_tree_sprigs="64"),
    ]
    got = judge(spark, "2.b", node_configs=rows)
    assert {c: r.status for c, r in got.items()} == {
        "at": "WARNING",
        "above": "PASS",
        "default": "WARNING",
        "ram": "PASS",
        "text": "CRITICAL",
        "first": "PASS",
    }
    assert got["text"].message.startswith("Error") and got["text"].evidence["n_broken"] == 1
    assert "x (64 sprigs)" in got["default"].message


def test_deadlock(spark):
    def pair(c, **kw):
        return cfg(c, "x", **kw)

    rows = [
        *pair("floor39", defrag_lwm_free_pct="39", high_water_disk_pct="10"),
        *pair("floor40", defrag_lwm_free_pct="40", high_water_disk_pct="40"),
        *pair("below", defrag_lwm_free_pct="59", high_water_disk_pct="60"),
        *pair("default_hwm", defrag_lwm_free_pct="49"),
        *pair("default_both", high_water_disk_pct="50"),
        *pair("bad_hwm", defrag_lwm_free_pct="50", high_water_disk_pct="x"),
        *pair("bad_unread", defrag_lwm_free_pct="39", high_water_disk_pct="x"),
        *pair("bad_defrag", defrag_lwm_free_pct="x"),
    ]
    assert statuses(spark, "2.c", node_configs=rows) == {
        "floor39": "WARNING",
        "floor40": "PASS",
        "below": "WARNING",
        "default_hwm": "WARNING",
        "default_both": "PASS",
        "bad_hwm": "CRITICAL",
        "bad_unread": "WARNING",
        "bad_defrag": "CRITICAL",
    }


def bands(spark, rule_id, metric, values):
    rows = [(f"v{v}", "n", "ns", metric, float(v)) for v in values]
    return statuses(spark, rule_id, namespace_stats=rows)


def test_high_water_bands(spark):
    assert bands(spark, "2.d", "service.data_used_pct", [59.9, 60, 74.9, 75]) == {
        "v59.9": "PASS",
        "v60": "WARNING",
        "v74.9": "WARNING",
        "v75": "CRITICAL",
    }
    assert bands(spark, "2.e", "service.memory_used_pct", [59.9, 60, 79.9, 80]) == {
        "v59.9": "PASS",
        "v60": "WARNING",
        "v79.9": "WARNING",
        "v80": "CRITICAL",
    }


def test_capacity_is_strict_and_matches_patterns(spark):
    assert bands(spark, "5.a", "x.DATA-used-pct.y", [70, 70.1, 85, 85.1]) == {
        "v70": "PASS",
        "v70.1": "WARNING",
        "v85": "WARNING",
        "v85.1": "CRITICAL",
    }


def test_worst_place_is_named(spark):
    rows = [
        ("c", "n2", "a", "service.data_used_pct", 77.9),
        ("c", "n1", "b", "service.data_used_pct", 77.9),
        ("c", "n0", "a", "service.data_used_pct", 70.0),
    ]
    assert judge(spark, "2.d", namespace_stats=rows)["c"].message == (
        "Namespace b uses 77% of its disk on node n1."
    )


def test_volumes(spark):
    def vol(metric, v):
        return [(f"v{v}", "n", "ns", metric, float(v))]

    busy = [*vol("service.fail_key_busy", 0), *vol("x.fail-KEY-busy", 1)]
    assert statuses(spark, "4.a", namespace_stats=busy) == {"v0": "PASS", "v1": "WARNING"}
    deletes = [*vol("client_delete_not_found", 1_000_000), *vol("service.client_delete_not_found", 1_000_001)]
    got = judge(spark, "4.c", namespace_stats=deletes)
    assert (got["v1000000"].status, got["v1000001"].status) == ("PASS", "WARNING")
    assert got["v1000001"].message.startswith("1,000,001 ")
    reads = judge(spark, "4.b", namespace_stats=vol("service.client_read_not_found", 10**9))
    assert reads["v1000000000"].status == "PASS"
    golden = judge(spark, "4.c", namespace_stats=[("c", "n", "ns", "client_delete_not_found", 734214682.0)])
    assert golden["c"].message.startswith("734,214,682") and golden["c"].status == "WARNING"


def test_symmetry(spark):
    def two(c, name, a="1", b="2"):
        return [(c, "n1", name, a), (c, "n2", name, b)]

    rows = [
        *two("ignored", "service.node-id"),
        *two("pattern", "ns.x.objects"),
        *two("pattern", "ns-data_used_bytes"),
        *two("same", "service.x", "1", "1"),
        *two("varied", "service.x"),
        *two("varied", "objects"),  # nothing before it, so the pattern does not match
    ]
    got = judge(spark, "3.a", node_configs=rows)
    assert {c: r.status for c, r in got.items()} == {
        "ignored": "PASS",
        "pattern": "PASS",
        "same": "PASS",
        "varied": "WARNING",
    }
    assert got["varied"].evidence["n_findings"] == 2


def test_thirty_one_drifts(spark):
    rows = [("c", n, f"s{i:02}", n) for i in range(31) for n in ("a", "b")]
    r = judge(spark, "3.a", node_configs=rows)["c"]
    assert r.evidence["n_findings"] == 31 and r.message.startswith("31 settings")
    tables = {"node_configs": table(spark, "node_configs", rows)}
    assert findings(tables, ids=["3.a"]).count() == 31


def test_config_drift(spark):
    live = [("c", "n", f"k{i}", "1") for i in range(5)] + [("quiet", "n", "k", "1")]
    static = [("c", "n", f"k{i}", "2") for i in range(4)] + [("c", "n", "k4", None), ("quiet", "n", "k", "1")]
    got = judge(spark, "3.b", node_configs=[*live, ("none", "n", "k", "1")], static_configs=static)
    assert {c: r.status for c, r in got.items()} == {"c": "WARNING", "quiet": "PASS", "none": "DATA MISSING"}
    assert got["c"].message.startswith("4 ") and got["c"].message.endswith(": k0, k1, k2.")


def test_set_skew(spark):
    rows = []
    for c, values in {
        "mean999": ["899", "1099"],
        "exact10": ["900", "1100"],
        "above10": ["899", "1101"],
        "single": ["5000"],
        "lenient": ["1000x", "2000"],
    }.items():
        rows += [(c, f"n{i}", "ns", "s", "objects", v) for i, v in enumerate(values)]
    got = judge(spark, "4.f", set_stats=[*rows, ("other", "n", "ns", "s", "size", "1")])
    assert {c: r.status for c, r in got.items()} == {
        "mean999": "PASS",
        "exact10": "PASS",
        "above10": "WARNING",
        "single": "PASS",
        "lenient": "WARNING",
        "other": "PASS",
    }
    assert "ns:s (10.1% skew)" in got["above10"].message


def test_connections(spark):
    rows = []
    for c, (top, rest) in {
        "pct80": (809, 191),  # 80.9 % truncates to 80
        "pct81": (810, 190),
        "count100": (100, 0),
        "count101": (101, 0),
        "zero": (0, 0),
    }.items():
        rows += [(c, "n1", "app", top // 2), (c, "n2", "app", top - top // 2), (c, "n1", "b", rest)]
    assert statuses(spark, "6.a", security_stats=rows) == {
        "pct80": "PASS",
        "pct81": "WARNING",
        "count100": "PASS",
        "count101": "WARNING",
        "zero": "PASS",
    }


def full(spark):
    return {
        "node_stats": table(spark, "node_stats", [("a", "n", ERR, "5"), ("b", "n", "x.build", "7")]),
        "namespace_stats": table(
            spark, "namespace_stats", [("a", "n", "ns", "service.data_used_pct", 80.0)]
        ),
        "node_configs": table(
            spark, "node_configs", [(c, n, "service.x", n) for c in "ab" for n in ("n", "m")]
        ),
        "security_stats": table(spark, "security_stats", [("c", "n", "u", 500)]),
        "cluster_metadata": table(spark, "cluster_metadata", [("d", "cluster_name", "d")]),
    }


def test_missing_tables_and_clusters(spark):
    got = {(r.cluster_id, r.id): r.status for r in run_all(full(spark)).collect()}
    assert len(got) == 4 * 16
    expected = {
        "1.a": "DATA MISSING",
        "1.b": "WARNING",
        "1.c": "CRITICAL",
        "2.a": "DATA MISSING",
        "2.d": "DATA MISSING",
        "3.a": "DATA MISSING",
        "3.b": "DATA MISSING",
        "4.a": "CRITICAL",
        "4.b": "DATA MISSING",
        "4.f": "SCHEMA MISMATCH",
        "5.a": "CRITICAL",
        "6.a": "DATA MISSING",
    }
    assert {i: got[("d", i)] for i in expected} == expected
    assert got[("c", "6.a")] == "WARNING" and got[("a", "2.d")] == "CRITICAL"


def as_rows(df):
    return sorted(map(repr, df.drop("evidence").collect()))


def test_stored_names_and_coverage_change_nothing(spark):
    tables = full(spark)
    more = {**tables, "coverage": coverage(tables), "metric_names": metric_names(tables)}
    assert as_rows(run_all(more)) == as_rows(run_all(tables))


def test_row_order_and_partitions_change_nothing(spark):
    tables = full(spark)
    shuffled = {n: df.repartition(7).orderBy(*reversed(df.columns)) for n, df in tables.items()}
    assert as_rows(run_all(shuffled)) == as_rows(run_all(tables))


def test_two_runs_together_are_the_two_runs_apart(spark):
    first = full(spark)
    second = {n: df.replace({"r": "q"}, subset=["run_id"]) for n, df in first.items()}
    second["namespace_stats"] = second["namespace_stats"].filter("false")
    both = {n: first[n].unionByName(second[n]) for n in first}
    apart = run_all(first).unionByName(run_all(second))
    assert as_rows(run_all(both)) == as_rows(apart)


def test_schema_order_and_gate(spark):
    results = run_all(full(spark))
    assert [f.dataType for f in results.schema] == [f.dataType for f in S.RESULT_SCHEMA]
    assert results.columns == S.RESULT_SCHEMA.names
    assert {r.id for r in results.select("id").distinct().collect()} == set(RULE_ORDER)
    problems = {(r.id, r.problem) for r in validate_results(results).collect()}
    assert {i for i, _ in problems} == {"1.c", "4.a", "5.a"}
    doubled = results.filter("id = '2.a'").unionByName(results.filter("id = '2.a'"))
    assert {r.problem for r in validate_results(doubled).collect()} == {"several rows"}
    with pytest.raises(ValueError):
        validate_results(results.drop("message"))


def test_plug_in_rules_and_isolation(spark):
    before = dict(REGISTRY)
    try:

        @rule("9.z", "Any Rows", "node_stats")
        def any_rows(tables, keys=S.KEYS, status="WARNING"):
            rows = tables["node_stats"].groupBy(*keys).count()
            return rows.selectExpr(*keys, f"'{status}' AS status", "cast(count AS string) AS message")

        @rule("9.bad", "Broken", "node_stats")
        def broken(tables, keys=S.KEYS):
            return tables["node_stats"].select("no_such_column")

        got = {(r.cluster_id, r.id): r for r in run_all(full(spark)).collect()}
        assert got[("a", "9.z")].status == "WARNING"
        assert got[("c", "9.z")].status == "DATA MISSING"
        assert got[("a", "9.bad")].status == "CRITICAL"
        assert got[("a", "9.bad")].message.startswith("Error")
        assert got[("a", "2.d")].status == "CRITICAL"
        one = run_rule(full(spark), "9.z", status="PASS").filter("cluster_id = 'a'").first()
        assert one.status == "PASS"
    finally:
        REGISTRY.clear()
        REGISTRY.update(before)


def test_catalogue_runs_whole(spark):
    out = run_catalog(full(spark))
    listed = {r.id for r in REGISTRY.values() if r.tier == "catalog" and r.listed}
    rows = out.collect()
    assert {r.id for r in rows} == listed and len(rows) == 4 * len(listed)
    more = run_catalog(full(spark), params={"C-5b": {"limit": 1.0}})
    assert "C-5b" in {r.id for r in more.select("id").distinct().collect()}


def series(spark, values, metric="service.data_used_pct", step=dt.timedelta(days=1)):
    rows = [("r", T0 + i * step, "c", "n", "ns", metric, float(v), "s") for i, v in enumerate(values)]
    return {"namespace_stats": spark.createDataFrame(rows, S.TABLES["namespace_stats"])}


@pytest.mark.parametrize(
    "values, status",
    [
        ([10, 11, 12], "PASS"),  # 48 days to go
        ([29, 30, 31], "WARNING"),  # 29 days
        ([28, 29, 30], "PASS"),  # exactly 30
        ([61, 62, 63], "WARNING"),  # already there
        ([50, 40, 30], "PASS"),  # falling
        ([10, 59], "DATA MISSING"),  # too few
    ],
)
def test_projection(spark, values, status):
    out = run_rule(series(spark, values), "C-5a").orderBy("snapshot_ts").collect()
    assert out[-1].status == status
    assert {r.status for r in out[:-1]} <= {"PASS"}


def test_rates_follow_the_counter_across_days(spark):
    step = dt.timedelta(hours=10)
    per = 36000 * 100
    tables = series(spark, [0, per, 2 * per + 1, 5, 5 + per], "service.fail_key_busy", step)
    out = run_rule(tables, "C-4a").orderBy("snapshot_ts").collect()
    # Nothing before the first, exactly 100/s is fine, one more is not, a reset gives no rate.
    assert [r.status for r in out] == ["DATA MISSING", "PASS", "WARNING", "DATA MISSING", "PASS"]


def test_hot_key_counts_sum_over_all_nodes(spark):
    rows = [("c", f"n{i}", "ns", "service.fail_key_busy", 1.0) for i in range(500)]
    assert judge(spark, "4.a", namespace_stats=rows)["c"].evidence["total"] == 500.0


