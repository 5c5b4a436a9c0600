import datetime as dt

import pytest

from clusterlens import report
from clusterlens import schema as S
from clusterlens.rules import coverage
from clusterlens.streaming import judge_arrivals
from helpers import document, rows, tar_bytes

T0 = dt.datetime(2024, 1, 1)


def results(spark, *items):
    data = [("r", T0, c, i, f"Rule {i}", s, f" m {i} ", None, {}) for c, i, s in items]
    return spark.createDataFrame(data, S.RESULT_SCHEMA)


@pytest.mark.parametrize(
    "statuses, current, older",
    [
        (["PASS"], "healthy", "healthy"),
        (["DATA MISSING"], "resource pressure", "healthy"),
        (["WARNING"] * 3, "resource pressure", "healthy"),
        (["WARNING"] * 4, "resource pressure", "resource pressure"),
        (["WARNING", "CRITICAL"], "immediate intervention", "immediate intervention"),
        (["SCHEMA MISMATCH"], "healthy", "healthy"),
    ],
)
def test_assessment(spark, statuses, current, older):
    df = results(spark, *[("c", str(i), s) for i, s in enumerate(statuses)])
    assert report.assessment(df).first()["level"] == current
    assert report.assessment(df, "older").first()["level"] == older


def test_vitals_have_defaults(spark):
    df = results(spark, ("c", "5.a", "CRITICAL"), ("c", "3.a", "DATA MISSING"))
    v = report.vitals(df).first()
    assert (v.capacity_status, v.capacity_mark) == ("CRITICAL", "\U0001f6a8")
    assert (v.integrity_status, v.integrity_mark) == ("DATA MISSING", "❓")
    assert (v.security_status, v.security_mark) == ("PASS", "✅")
    assert v.security_message


def test_issues_and_appendix(spark):
    df = results(spark, ("c", "5.a", "CRITICAL"), ("c", "1.a", "DATA MISSING"), ("c", "2.a", "PASS"))
    assert rows(report.issues(df), "id", "callout") == [("1.a", "warning"), ("5.a", "important")]
    assert all(r.remediation for r in report.issues(df).collect())
    out = report.appendix(df).collect()
    assert [r.id for r in out] == ["1.a", "2.a", "5.a"]
    assert out[0].status == "⚠️ DATA MISSING"
    assert out[0].summary == "m 1.a"


def test_context_and_narrative(spark):
    key = ("r", T0, "c")

    def table(name, *data):
        return spark.createDataFrame([(*key, *d) for d in data], S.TABLES[name])

    tables = {
        "cluster_metadata": table(
            "cluster_metadata",
            ("cluster_name", "prod", 1),
            ("consistency_model", "Strong Consistency (SC)", 1),
            ("topology", "XDR Enabled", 1),
        ),
        "node_stats": table("node_stats", ("n1", "a", "1", "x"), ("n1", "b", "1", "x"), ("n2", "a", "1", "x")),
        "namespace_stats": table("namespace_stats", ("n1", "ns", "service.index-type.mount[0].age", 1.0, "s")),
        "active_features": table("active_features", ("n1", "XDR"), ("n2", "KVS"), ("n2", "XDR")),
    }
    c = report.cluster_context(tables).first()
    assert c.cluster_name == "prod" and c.server_version == "Unknown" and c.node_count == 2
    assert c.active_features == "KVS, XDR" and c.index_location == "Flash (All-Flash)"
    n = report.narrative(report.cluster_context(tables)).first()["narrative"]
    assert "prod" in n and "2 nodes" in n and "(SC)" in n and "Replication" in n
    assert report.cluster_context({**tables, "coverage": coverage(tables)}).first() == c
    tables["active_features"] = table("active_features")
    assert report.cluster_context(tables).first().active_features == "None detected"


def test_charts(spark):
    stats = spark.createDataFrame(
        [
            ("r", T0, "c", "n", "as_stat.statistics.service.client_connections", "12x", ""),
            ("r", T0, "c", "n", "a.fail_key_busy", "3", ""),
            ("r", T0, "c", "n", "a.CLIENT_KEY_BUSY.b", "4.5", ""),
        ],
        S.TABLES["node_stats"],
    )
    assert report.client_connections(stats).first()["connections"] == 12
    assert report.hot_key_by_node(stats).first()["key_busy"] == 7.5


def test_arriving_bundles_are_judged(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    payload = {"as_stat": {"statistics": {"namespace": {"a": {"data_used_pct": 99}}}}}
    data = tar_bytes([("x.json", document(payload).encode())])
    (src / "a.tgz").write_bytes(data)

    def run():
        q = judge_arrivals(spark, str(src), out, "live", checkpoint=str(tmp_path / "cp"))
        q.awaitTermination(300)

    run()
    (src / "b.tgz").write_bytes(data)
    run()
    found = spark.read.parquet(f"{out}/results").filter("id = '2.d'")
    assert rows(found, "run_id", "status") == [("live-0", "CRITICAL"), ("live-1", "CRITICAL")]
