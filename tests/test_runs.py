"""Stored runs: commits, plug-ins that fail at run time, series over runs, and the stored report."""

import datetime as dt
import json

import pytest
from helpers import document, rows
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from clusterlens import schema as S
from clusterlens import sources
from clusterlens.extract import EXTRACTORS
from clusterlens.extract.registry import extractor
from clusterlens.operators import (
    join_text,
    merged_sketches,
    quantile_sketch,
    running_total,
    sketched_quantile,
    text_chunks,
    with_metadata,
)
from clusterlens.plans import pipeline, queries_runs
from clusterlens.rules import REGISTRY, finding_texts, findings, rule, run_all, run_rule
from clusterlens.rules import series as series_rules
from clusterlens.sources import read_parquet_tables, read_results, telemetry, write_tables
from clusterlens.sources.store import attempt_path, committed, new_attempt

T0 = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)


def documents(spark, days, value=10.0, busy=0, nodes=("n1", "n2")):
    """One document of one cluster with a snapshot for each day."""
    doc = {}
    for day in days:
        stats = {"data_used_pct": value + day, "fail_key_busy": busy * day}
        payload = {
            "as_stat": {
                "meta_data": {"asd_build": "E-7.2.0.6"},
                "statistics": {"service": {"client_connections": 5}, "namespace": {"ns": {"service": stats}}},
                "config": {"service": {"x": day}},
            },
            "sys_stat": {"host": "h"},
        }
        doc[str(T0 + day * DAY)] = {"c": dict.fromkeys(nodes, payload)}
    return spark.createDataFrame(
        [("b", "m", 1, json.dumps(doc), None)],
        "bundle string, member string, size bigint, json string, error string",
    )


@pytest.fixture
def plug_ins():
    rules_before, extractors_before = dict(REGISTRY), dict(EXTRACTORS)
    yield
    for registry, before in ((REGISTRY, rules_before), (EXTRACTORS, extractors_before)):
        registry.clear()
        registry.update(before)


def test_a_failed_ingest_leaves_the_old_run(spark, tmp_path, plug_ins):
    out = str(tmp_path)
    pipeline.ingest_documents(documents(spark, [0]), out, "r")
    before = {t: sorted(map(str, df.collect())) for t, df in read_parquet_tables(spark, out).items()}
    assert len(before) > 8 and before["namespace_stats"]
    good = EXTRACTORS["set_stats"]

    def failing(nodes):  # one of the listed tables: the whole run must fail
        return good(nodes).withColumn("key", F.raise_error(F.lit("disk full")).cast("string"))

    def failing_on_rows(nodes):
        broken = F.when(F.col("node_id") == "n2", F.raise_error(F.lit("disk full"))).otherwise(F.lit("x"))
        return nodes.select(*S.KEYS, "node_id", F.lit("m").alias("metric"), broken.cast("string").alias("value"))

    EXTRACTORS["system_info"] = failing_on_rows
    with pytest.raises(Exception, match="disk full"):
        pipeline.ingest_documents(documents(spark, [5, 6], value=70.0), out, "r")
    after = {t: sorted(map(str, df.collect())) for t, df in read_parquet_tables(spark, out).items()}
    assert after == before
    # tables of the failed attempt lie there, and nobody reads them
    assert spark.read.parquet(f"{out}/nodes").count() > len(before["system_info"])


def test_commits_name_what_a_run_consists_of(spark, tmp_path):
    out = str(tmp_path)
    table = spark.createDataFrame([("a", None, "c", "n", "f")], S.TABLES["active_features"])
    assert committed(spark, out) == {} and read_parquet_tables(spark, out) == {}
    assert read_results(spark, out).count() == 0
    lost = new_attempt()
    table.write.parquet(attempt_path(out, "active_features", lost))  # written, never committed
    assert read_parquet_tables(spark, out) == {}
    write_tables({"active_features": table}, out, "a")
    write_tables({"active_features": table.withColumn("run_id", F.lit("b"))}, out, "b")
    assert list(committed(spark, out)) == ["a", "b"]
    write_tables({"rejects": table.select("run_id")}, out, "a")  # beside what the run has
    assert set(committed(spark, out)["a"]) == {"active_features", "rejects"}
    assert list(committed(spark, out)) == ["a", "b"]
    assert rows(read_parquet_tables(spark, out, ["a"])["active_features"], "run_id") == [("a",)]
    none = read_parquet_tables(spark, out, ["b"], ["rejects"])["rejects"]
    assert none.columns == ["run_id"] and none.count() == 0


def test_a_rule_that_fails_on_one_row_is_critical_alone(spark, plug_ins):
    ns = [("r", T0, "c", "n", "ns", "service.data_used_pct", v, "s") for v in (10.0, 20.0)]
    tables = {"namespace_stats": spark.createDataFrame(ns, S.TABLES["namespace_stats"])}
    alone = {r.id: tuple(r) for r in run_all(tables).collect()}

    @rule("z.1", "Fails on a row", "namespace_stats")
    def broken(tables, keys):
        odd = tables["namespace_stats"].withColumn("y", F.lit(1) / (F.col("value") - 20))
        return odd.groupBy(*keys).agg(F.lit(S.PASS).alias("status"), F.max("y").cast("string").alias("message"))

    @rule("z.2", "Works", "namespace_stats")
    def works(tables, keys):
        return tables["namespace_stats"].groupBy(*keys).agg(F.lit("WARNING").alias("status"), F.lit("m").alias("message"))

    got = {r.id: tuple(r) for r in run_all(tables).collect()}
    assert got["z.1"][5:7] == ("CRITICAL", "Error: DIVIDE_BY_ZERO")
    assert got["z.2"][5:7] == ("WARNING", "m")
    assert {i: r for i, r in got.items() if not i.startswith("z")} == alone


def test_an_extractor_that_fails_on_one_row_leaves_an_empty_table(spark, tmp_path, plug_ins):
    @extractor("own")
    def own(nodes):
        bad = F.when(F.col("node_id") == "n2", F.raise_error(F.lit("odd node"))).otherwise(F.lit(1))
        return nodes.select(*S.KEYS, "node_id", bad.cast("int").alias("n"))

    out = str(tmp_path)
    pipeline.ingest_documents(documents(spark, [0]), out, "r")
    stored = read_parquet_tables(spark, out, names=["own", "system_info", "namespace_stats"])
    assert stored["own"].count() == 0
    assert stored["system_info"].count() == 2 and stored["namespace_stats"].count() == 4


# --- series ----------------------------------------------------------------------------------------


def stats(spark, run, readings, metric="service.data_used_pct", node="n"):
    made = [(run, T0 + day * DAY, "c", node, "ns", metric, float(v), "s") for day, v in readings]
    return spark.createDataFrame(made, S.TABLES["namespace_stats"])


def judged_in_runs(spark, runs, rule_id, metric):
    """Results of a rule over runs that follow each other, by day and run."""
    before, out = None, []
    for run, readings in runs:
        tables = {"namespace_stats": stats(spark, run, readings, metric)}
        if before is not None:
            tables["series"] = before
        for r in run_rule(tables, rule_id).collect():
            out.append((run, (r.snapshot_ts - T0).days, r.status, r.evidence))
        before = spark.createDataFrame(series_rules.advance(tables, run).collect(), S.SERIES)
    return out, before


BUSY = 86400 * 100
READINGS = [(0, 0), (1, BUSY), (2, 2 * BUSY + 86400), (3, 5.0), (4, 5.0 + BUSY)]


def test_three_runs_have_the_rates_of_one(spark):
    metric = "service.fail_key_busy"
    whole, _ = judged_in_runs(spark, [("r", READINGS)], "C-4a", metric)
    parts, state = judged_in_runs(spark, [("1", READINGS[:1]), ("2", READINGS[1:3]), ("3", READINGS[3:])], "C-4a", metric)
    assert [x[1:] for x in sorted(parts)] == [x[1:] for x in sorted(whole)]
    assert [x[2] for x in sorted(whole)] == ["DATA MISSING", "PASS", "WARNING", "DATA MISSING", "PASS"]
    (row,) = state.filter("metric = 'fail_key_busy'").collect()
    assert (row["last_value"], row["last_rate"], row["n"]) == (5.0 + BUSY, 100.0, 5)


def test_a_repeated_snapshot_counts_once(spark):
    metric = "service.fail_key_busy"
    runs = [("1", READINGS[:3]), ("2", READINGS[2:3]), ("3", READINGS[1:4])]
    got, state = judged_in_runs(spark, runs, "C-4a", metric)
    by_run = {(run, day): status for run, day, status, _ in got}
    assert by_run[("2", 2)] == "WARNING"  # the rate that the run before has found
    assert by_run[("3", 1)] == "DATA MISSING"  # the series has moved on
    assert by_run[("3", 2)] == "WARNING" and by_run[("3", 3)] == "DATA MISSING"
    assert state.filter("metric = 'fail_key_busy'").first()["n"] == 4


@pytest.mark.parametrize("values", [[10, 11, 12, 13], [29, 30, 31, 30], [61, 62, 63, 64], [50, 40, 30, 20], [7, 7, 7, 7]])
def test_three_runs_have_the_projection_of_one(spark, values):
    metric = "service.data_used_pct"
    readings = list(enumerate(values))
    whole, _ = judged_in_runs(spark, [("r", readings)], "C-5a", metric)
    parts, state = judged_in_runs(
        spark, [("1", readings[:1]), ("2", readings[:2]), ("3", readings[2:3]), ("4", readings[3:])], "C-5a", metric
    )
    last, one = max(parts), max(whole)
    assert last[2] == one[2]
    assert last[3]["n_points"] == one[3]["n_points"] == 4
    assert last[3].get("days_left") == pytest.approx(one[3].get("days_left"))
    first = [x for x in parts if x[0] in "12" and x[3]]
    assert first and {x[2] for x in first} == {"DATA MISSING"}
    assert state.filter("metric = 'data_used_pct'").first()["mean_y"] == pytest.approx(sum(values) / 4)


def test_series_without_new_readings_stay(spark):
    one = {"namespace_stats": stats(spark, "1", [(0, 1), (1, 2)], node="a")}
    state = spark.createDataFrame(series_rules.advance(one, "1").collect(), S.SERIES)
    two = {"namespace_stats": stats(spark, "2", [(2, 5)], node="b"), "series": state}
    after = series_rules.advance(two, "2")
    assert rows(after, "run_id", "node_id", "last_value", "n") == [("2", "a", 2.0, 2), ("2", "b", 5.0, 1)]


def test_stored_runs_hand_their_series_on(spark, tmp_path):
    out = str(tmp_path)
    for i, days in enumerate(([0], [1], [2, 3])):
        pipeline.ingest_documents(documents(spark, days, value=50.0, busy=86400 * 200), out, f"r{i}")
        pipeline.analyze(spark, out, f"r{i}")
    stored = read_parquet_tables(spark, out, names=["catalog_results", "series"])
    got = {(r.run_id, (r.snapshot_ts - T0).days, r.id): r.status for r in stored["catalog_results"].collect()}
    rates = [got[k] for k in (("r0", 0, "C-4a"), ("r1", 1, "C-4a"), ("r2", 2, "C-4a"), ("r2", 3, "C-4a"))]
    assert rates == ["DATA MISSING", "WARNING", "WARNING", "WARNING"]
    assert [got[(r, d, "C-5a")] for r, d in (("r0", 0), ("r1", 1), ("r2", 3))] == ["DATA MISSING", "DATA MISSING", "WARNING"]
    assert rows(stored["series"].filter("metric = 'data_used_pct'"), "run_id", "node_id", "n") == [
        ("r0", "n1", 1), ("r0", "n2", 1), ("r1", "n1", 2), ("r1", "n2", 2), ("r2", "n1", 4), ("r2", "n2", 4),
    ]
    # a run that is stored and judged again is taken out of those after it
    pipeline.ingest_documents(documents(spark, [1], value=50.0, nodes=["n1"]), out, "r1")
    pipeline.replay(spark, out, "r1")
    series = read_parquet_tables(spark, out, ["r2"], ["series"])["series"]
    assert rows(series.filter("metric = 'data_used_pct'"), "node_id", "n") == [("n1", 4), ("n2", 3)]


def test_report_of_a_stored_run(spark, tmp_path):
    out = str(tmp_path)
    pipeline.ingest_documents(documents(spark, [0, 1], value=80.0), out, "r")
    results = pipeline.analyze(spark, out, "r")
    made = pipeline.report_run(spark, out, "r")
    assert made["report_appendix"].count() == results.count() == 2 * 16
    assert made["report_issues"].count() == results.filter("status <> 'PASS'").count() > 0
    assert rows(made["report_disk_usage"], "node_id", "used_pct") == [
        ("n1", 80.0), ("n1", 81.0), ("n2", 80.0), ("n2", 81.0)
    ]
    assert made["report_assessment"].count() == 2
    found = read_parquet_tables(spark, out, ["r"], ["findings", "finding_texts"])
    assert found["finding_texts"].agg(F.sum("n")).first()[0] == (found["findings"].count() or None)


# --- whole texts -----------------------------------------------------------------------------------


def test_running_total_over_a_hot_key(spark):
    made = [("hot", i) for i in range(3000)] + [("a", 1), ("a", 7), (None, 5), (None, 6)]
    df = spark.createDataFrame(made, "k string, i int").repartition(7)
    got = {(r.k, r.i): r.before for r in running_total(df, ["k"], ["i"], F.col("i"), "before").collect()}
    assert len(got) == len(made)
    assert all(got[("hot", i)] == i * (i - 1) // 2 for i in range(3000))
    assert (got[("a", 1)], got[("a", 7)], got[(None, 5)], got[(None, 6)]) == (0, 1, 0, 5)


def test_joined_text_leaves_nothing_out(spark):
    names = [f"name{i:04d}" for i in range(500)]
    df = spark.createDataFrame([("k", n) for n in names] * 2 + [("k", None), ("l", "one")], "k string, n string")
    parts = sorted(join_text(df, ["k"], "n", ";", chunk_chars=100).collect())
    assert ";".join(r["text"] for r in parts if r["k"] == "k") == ";".join(names)
    assert max(len(r["text"]) for r in parts) <= 108 and [r["chunk"] for r in parts][:3] == [0, 1, 2]
    assert sum(r["n"] for r in parts) == 501
    assert text_chunks(df.limit(0), ["k"], "n", ["n"]).count() == 0


def test_findings_as_text_and_names_in_messages(spark):
    made = [("r", T0, "c", f"n{j}", f"service.setting{i:04d}", str(j), "s") for i in range(3000) for j in range(2)]
    tables = {"node_configs": spark.createDataFrame(made, S.TABLES["node_configs"])}
    found = findings(tables, ids=["3.a"])
    texts = finding_texts(found, chunk_chars=1000).collect()
    assert sum(r["n"] for r in texts) == 3000 and max(len(r["text"]) for r in texts) < 1100
    (verdict,) = run_rule(tables, "3.a").collect()
    assert verdict.message.startswith("3000 settings differ between nodes: service.setting0000, ")
    named = verdict.message.count("service.setting")
    assert 1000 < named < 3000 and len(verdict.message) < 2**15 + 200  # the first chunk of the text
    whole = finding_texts(found).filter("chunk = 0").first()
    assert whole["n"] == named and whole["text"] in verdict.message


def test_clusters_without_metadata_take_the_default(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "cluster_id string, x int")
    meta = spark.createDataFrame([("a", "cloud_platform", "AWS"), ("b", "other", "z")], "cluster_id string, key string, value string")
    out = with_metadata(df, meta, "cloud_platform", keys=["cluster_id"], alias="platform")
    assert rows(out, "cluster_id", "platform") == [("a", "AWS"), ("b", "Unknown")]


# --- sketches --------------------------------------------------------------------------------------


def test_sketches_stay_within_their_bound(spark):
    rows_ = [("c", float((i * 7919) % 100_003)) for i in range(100_003)]
    df = spark.createDataFrame(rows_, "cluster_id string, x double").repartition(9)
    parts = [df.filter(F.pmod(F.hash("x"), F.lit(3)) == i) for i in range(3)]  # three runs
    made = [quantile_sketch(p, ["cluster_id"], "x", 256).collect() for p in parts]
    stored = spark.createDataFrame([r for m in made for r in m], "cluster_id string, sketch binary")
    assert max(len(r["sketch"]) for m in made for r in m) < 20_000  # 800 kB of values
    whole = merged_sketches(stored, ["cluster_id"])
    for q in (0.01, 0.5, 0.95, 0.99):
        got = sketched_quantile(whole, ["cluster_id"], q).first()["q"]
        assert abs(got / 100_003 - q) <= 2.3 / 256**0.9


def test_latency_from_stored_sketches(spark, tmp_path):
    out = str(tmp_path)
    pipeline.ingest_documents(documents(spark, [0, 1], value=50.0), out, "r")
    limits = {"C-4e": {"metric": "data_used_pct", "max_latency": 50.5, "quantile": 0.5}}
    pipeline.analyze(spark, out, "r", catalog_params=limits, sketch_metrics=["data_used_pct"])
    stored = read_parquet_tables(spark, out, names=["sketches", "catalog_results"])
    assert stored["sketches"].count() == 2
    got = stored["catalog_results"].filter("id = 'C-4e'").orderBy("snapshot_ts").collect()
    assert [r.status for r in got] == ["PASS", "WARNING"] and got[1].evidence["extreme"] == 51.0


def test_staged_results_can_be_dropped(spark):
    import os

    from clusterlens.sources import drop_staged, staged
    from clusterlens.sources.store import staging_folder

    assert staged(spark.range(5), "five").count() == 5 and os.path.isdir(staging_folder(spark))
    drop_staged(spark)
    assert not os.path.exists(staging_folder(spark))
    assert staged(spark.range(5), "five").count() == 5


# --- the dictionary of metric names -------------------------------------------------------------------


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_patterns_become_pushed_names(spark, tmp_path):
    from clusterlens.rules.core import entities, matching, namespace_facts

    out = str(tmp_path)
    pipeline.ingest_documents(documents(spark, [0, 1]), out, "r")
    tables = read_parquet_tables(spark, out, ["r"])
    versions = physical(entities(tables, S.KEYS, ["1.c"]))
    pushed = versions.split("PushedFilters: [")[1].split("]")[0]
    assert "metric" in pushed and "as_stat.meta_data.asd_build" in pushed and "LIKE" not in versions.upper()
    facts = physical(namespace_facts(tables, S.KEYS, ["4.a", "5.a"], None, False))
    pushed = facts.split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert "LIKE" not in facts.upper()
    assert "service.fail_key_busy" in pushed and "service.data_used_pct" in pushed
    bare = {t: df for t, df in tables.items() if t != "metric_names"}
    for rule_id in ("1.c", "4.a", "5.a"):
        assert sorted(map(str, run_rule(tables, rule_id).collect())) == sorted(map(str, run_rule(bare, rule_id).collect()))
    # names that nothing matches ask for no row; a table without a dictionary is judged row by row
    assert tables["node_stats"].filter(matching(tables, "node_stats", ["%no such thing%"])).isEmpty()
    assert "LIKE" in str(matching(tables, "other_table", ["%x%"])).upper()


def test_a_stale_dictionary_is_not_used(spark, tmp_path):
    out = str(tmp_path)
    pipeline.ingest_documents(documents(spark, [0]), out, "r")
    old = read_parquet_tables(spark, out, ["r"])
    names = {r.table_name for r in old["metric_names"].select("table_name").distinct().collect()}
    assert names == {"node_stats", "namespace_stats"}
    more = [("r", T0, "c", "n9", "other.build", "E-1.0", "STRING")]
    again = old["node_stats"].unionByName(spark.createDataFrame(more, S.TABLES["node_stats"]))
    write_tables({"node_stats": spark.createDataFrame(again.collect(), S.TABLES["node_stats"])}, out, "r")
    now = read_parquet_tables(spark, out, ["r"])
    assert {r.table_name for r in now["metric_names"].select("table_name").distinct().collect()} == {"namespace_stats"}
    (verdict,) = run_rule(now, "1.c").collect()
    assert verdict.status == "WARNING" and "E-1.0 (1 nodes)" in verdict.message


# --- documents as files ------------------------------------------------------------------------------


@pytest.mark.parametrize("local", [True, False])
def test_documents_are_dealt_to_few_folders(spark, tmp_path, monkeypatch, local):
    """Every document is a file of its own, but the driver has no folder to list for each of them."""
    monkeypatch.setattr(queries_runs, "FOLDERS", 8)
    if not local:
        monkeypatch.setattr(queries_runs, "_local_path", lambda spark, folder: None)
    rows = [(i, document({"a": i}, node=f"n{i}")) for i in range(60)]
    rows += [(7, rows[7][1]), (60, document({}, node="n60")), (60, None), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, json string").repartition(2, "doc_id")
    queries_runs.write_documents(docs, str(tmp_path / "docs"))
    files = [f for f in (tmp_path / "docs").rglob("*.txt") if not f.name.startswith(".")]
    assert len(files) == 62 and len({f.parent for f in files}) <= 16
    read = sources.read_telemetry_json(spark, str(tmp_path / "docs"))
    assert read.count() == 62
    nodes = sources.explode_snapshots(read, "r1")
    # two rows of one id are one file; one text and an empty line are still that text
    assert nodes.filter("error is not null").count() == 2
    named = {r["node_id"] for r in nodes.filter("error is null").collect()}
    assert named == {f"n{i}" for i in range(61) if i != 7}


def test_the_driver_lists_some_folders_at_a_time(spark, tmp_path, monkeypatch):
    """Many files in many folders are read whole, and no listing holds them all."""
    rows = [(i, document({"a": i}, node=f"n{i}")) for i in range(300)]
    monkeypatch.setattr(queries_runs, "FOLDERS", 60)
    queries_runs.write_documents(spark.createDataFrame(rows, "doc_id long, json string"), str(tmp_path / "docs"))
    files = spark.read.text(str(tmp_path / "docs"), wholetext=True)
    names = [f"_metadata.file_{x}" for x in ("path", "name", "size")]
    whole = {tuple(r) for r in files.select(*names, "value").collect()}
    listed, text = [], DataFrameReader.text

    def counted(self, paths, **options):
        df = text(self, paths, **options)
        listed.append(len(df.inputFiles()))
        return df

    monkeypatch.setattr(DataFrameReader, "text", counted)
    monkeypatch.setattr(telemetry, "LISTED_FILES", 40, raising=False)
    monkeypatch.setattr(telemetry, "FIRST_FOLDERS", 2, raising=False)
    read = sources.read_telemetry_json(spark, str(tmp_path / "docs"))
    assert {tuple(r) for r in read.select("bundle", "member", "size", "json").collect()} == whole
    assert max(listed) <= 80 and sum(listed) == read.count() == 300


def test_no_documents_are_an_empty_folder(spark, tmp_path):
    queries_runs.write_documents(spark.createDataFrame([], "doc_id long, json string"), str(tmp_path / "none"))
    assert sources.read_telemetry_json(spark, str(tmp_path / "none")).count() == 0
