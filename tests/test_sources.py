import contextlib
import io
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clusterlens import schema as S
from clusterlens import sources
from clusterlens.extract import metadata
from clusterlens.plans import pipeline, queries_telemetry
from clusterlens.plans.queries import QUERIES
from clusterlens.sources import bundles, telemetry
from clusterlens.sources import (
    bundle_inventory,
    decode_member,
    explode_snapshots,
    latest_nodes,
    list_members,
    pick_telemetry,
    read_bundles,
    read_parquet_tables,
    read_telemetry_json,
    reject_documents,
    shared_folder,
    staged,
    telemetry_documents,
    write_tables,
)
from helpers import TS, document, gzipped, rows, tar_bytes, zipped

DOC = document({"as_stat": {"meta_data": {"asd_build": "7"}}}).encode()


@pytest.fixture()
def corpus(tmp_path):
    pad = b" " * 4000
    files = {
        "plain.tgz": [("a/x_ascinfo.json", DOC), ("m/MANIFEST.json", pad), ("h.conf", b""), ("s.log", b"")],
        "gz.tgz": [("x.json.gz", gzipped(DOC))],
        "zip.tar": [("X.JSON.zip", zipped(DOC)), ("y.json", b"{}")],
        "both.tgz": [("x.json.zip", zipped(gzipped(DOC)))],
        "tie.tgz": [("first.json", b'{"t":{"first":{"n":{}}}}'), ("other.json", b'{"t":{"other":{"n":{}}}}')],
        "none.tgz": [("manifest.json", b"{}"), ("server.log.1", b"")],
        "text.tgz": [("x.json", b"not json")],
        "dup.tgz": [("x.json", b'{"a":{"b":{"n":{"k":1,"k":2}}}}')],
        "list.tgz": [("x.json", b"[1]")],
    }
    for name, members in files.items():
        mode = "w:gz" if name.endswith("tgz") else "w"
        (tmp_path / name).write_bytes(tar_bytes(members, mode))
    (tmp_path / "broken.tgz").write_bytes(b"no archive")
    return str(tmp_path)


def base(df):
    return df.withColumn("bundle", F.element_at(F.split("bundle", "/"), -1))


def test_decode_member():
    assert decode_member("a.json", DOC) == DOC.decode()
    assert decode_member("a.json", gzipped(DOC)) == DOC.decode()
    assert decode_member("a.json.zip", zipped(gzipped(DOC))) == DOC.decode()


def test_documents_pick_decode_and_reject(spark, corpus):
    docs = base(telemetry_documents(read_bundles(spark, corpus)))
    got = {r.bundle: r for r in docs.collect()}
    for name in ("plain.tgz", "gz.tgz", "zip.tar", "both.tgz"):
        assert json.loads(got[name].json) == json.loads(DOC), name
        assert got[name].error is None
    assert got["zip.tar"].member == "X.JSON.zip"
    assert got["none.tgz"].error == "no telemetry member"
    assert "ReadError" in got["broken.tgz"].error
    assert "first" in got["tie.tgz"].json


def test_pick_over_listed_members_agrees_with_documents(spark, corpus):
    bundles = read_bundles(spark, corpus)
    listed = rows(base(pick_telemetry(list_members(bundles))), "bundle", "member", "size")
    docs = telemetry_documents(bundles).filter("member is not null")
    assert listed == rows(base(docs), "bundle", "member", "size")


def test_inventory(spark, corpus):
    members = list_members(read_bundles(spark, corpus))
    out = {r.bundle: r for r in base(bundle_inventory(members)).collect()}
    assert tuple(out["plain.tgz"])[1:] == (1, 1, 1, 1)
    assert tuple(out["none.tgz"])[1:] == (0, 0, 0, 2)
    assert "broken.tgz" not in out
    named = {r.bundle: r for r in base(bundle_inventory(members, ["server.log"])).collect()}
    assert tuple(named["none.tgz"])[1:] == (0, 0, 1, 1)


def test_explode_keeps_rejects_apart(spark, corpus):
    out = explode_snapshots(base(telemetry_documents(read_bundles(spark, corpus))), "r1")
    assert [b for b, _ in rows(reject_documents(out), "bundle", "error")] == [
        "broken.tgz",
        "list.tgz",
        "none.tgz",
        "text.tgz",
    ]
    good = out.filter("error is null")
    assert {r.bundle for r in good.collect()} == {
        "plain.tgz",
        "gz.tgz",
        "zip.tar",
        "both.tgz",
        "tie.tgz",
        "dup.tgz",
    }


def test_an_archive_too_long_for_a_value_is_a_reject(spark, corpus):
    """It stops neither the others nor the listing."""
    key = "spark.sql.sources.binaryFile.maxLength"
    before = spark.conf.get(key)
    spark.conf.set(key, "10")  # only the broken archive, 10 bytes, is short enough
    try:
        docs = base(telemetry_documents(read_bundles(spark, corpus)))
        got = {r.bundle: r.error for r in docs.collect()}
    finally:
        spark.conf.set(key, before)
    assert len(got) == 10
    assert "too long" in got["plain.tgz"]
    assert "ReadError" in got["broken.tgz"]


def test_levels_that_are_no_objects_and_repeated_names(spark):
    docs = [
        '{"t":5,"u":{"c":{"n":{"v":1}}}}',
        '{"t":{"b":7,"c":{"n":{"v":0.00050,"w":12345678.50}},"d":[1]},"e":null}',
        '{"t":{"c":{"n":{"v":1}}},"t":{"c":{"n":{"v":1},"n":{"v":2,"v":3}}}}',
        '{"t":{"c":{"n":{"v":NaN,"w":0.5},"m":"text","k":null}}}',
        '{"t":{"c":{"n":{"v":tru}}}}',
        '{"t":{}} x',
        "",
        None,
        " {} ",
    ]
    df = spark.createDataFrame(
        [(f"b{i}", "m", 1, d, None) for i, d in enumerate(docs)],
        "bundle string, member string, size bigint, json string, error string",
    )
    out = explode_snapshots(df, "r").withColumn("p", F.col("payload").cast("string"))
    got = rows(out.filter("error is null"), "bundle", "snapshot", "cluster_id", "node_id", "p")
    assert sorted(got, key=str) == sorted(
        [
            ("b0", "u", "c", "n", '{"v":1}'),
            ("b1", "t", "b", None, None),
            ("b1", "t", "c", "n", '{"v":0.0005,"w":12345678.5}'),
            ("b1", "t", "d", None, None),
            ("b2", "t", "c", "n", '{"v":3}'),
            ("b3", "t", "c", "n", '{"v":"NaN","w":0.5}'),
            ("b3", "t", "c", "m", "text"),
            ("b3", "t", "c", "k", None),
        ],
        key=str,
    )
    bad = {r.bundle: r.error for r in reject_documents(out).collect()}
    assert set(bad) == {"b4", "b5", "b6", "b7"}
    assert "not JSON" in bad["b4"]


def test_one_bad_node_leaves_its_neighbours_and_documents_may_be_large(spark):
    """A document above 128 MiB with a text that no VARIANT holds."""
    body = '"%s"' % ("y" * 1_000_000)
    nodes = [f'"n{i}":{{"v":{body}}}' for i in range(136)]
    nodes.append('"bad":{"v":"%s"}' % ("y" * 21_000_000))
    doc = '{"t":{"c":{%s}}}' % ",".join(nodes)
    n = (
        spark.range(1)
        .mapInArrow(_one_document(doc), "bundle string, member string, json string, error string")
    )
    out = explode_snapshots(n, "r").select("node_id", "bundle", "member", "run_id", "error")
    got = out.collect()
    assert len(got) == 137
    assert [r.node_id for r in got if r.error] == ["bad"]


def _one_document(doc):
    def make(batches):
        import pyarrow as pa

        for batch in batches:
            for _ in range(batch.num_rows):
                cols = [pa.array([v], pa.string()) for v in ("b", "m", doc, None)]
                yield pa.RecordBatch.from_arrays(cols, names=["bundle", "member", "json", "error"])

    return make


@pytest.mark.parametrize("run", ["a/b", "50%41", "x=1:2", "7"])
def test_any_text_is_a_run_id(spark, tmp_path, run):
    table = spark.createDataFrame([(run, None, "c", "n", "f")], S.TABLES["active_features"])
    write_tables({"active_features": table}, str(tmp_path), run)
    out = read_parquet_tables(spark, str(tmp_path), [run])["active_features"]
    assert rows(out, "run_id", "feature") == [(run, "f")]


def docs_frame(spark, docs):
    return spark.createDataFrame(
        [(f"b{i}", "m", len(d), d, None) for i, d in enumerate(docs)],
        "bundle string, member string, size bigint, json string, error string",
    )


def test_three_levels_and_times(spark):
    doc = json.dumps(
        {
            "2024-01-01 00:00:00": {"c1": {"n1": {"x": 1}, "n2": {}}, "c2": {}},
            "20240102_030405": {"c1": {"n1": {"x": 2}}},
            "some day": {"c1": {"n1": {"x": 3}}},
            "other day": {"c1": {"n1": {"x": 3}}},
        }
    )
    out = explode_snapshots(docs_frame(spark, [doc]), "r1").withColumn(
        "t", F.date_format("snapshot_ts", "yyyy-MM-dd HH:mm:ss")
    )
    got = rows(out.filter("snapshot_ts > '2000-01-01'"), "t", "cluster_id", "node_id")
    assert got == [
        ("2024-01-01 00:00:00", "c1", "n1"),
        ("2024-01-01 00:00:00", "c1", "n2"),
        ("2024-01-01 00:00:00", "c2", None),
        ("2024-01-02 03:04:05", "c1", "n1"),
    ]
    odd = out.filter("snapshot_ts < '0002-01-01'")
    assert odd.count() == 2
    assert odd.select("snapshot_ts").distinct().count() == 2


def test_latest_copy_of_a_node_wins(spark):
    docs = [
        document({"v": 1}),
        document({"v": 2}),
        document({"v": 3}, node="n2"),
    ]
    nodes = latest_nodes(explode_snapshots(docs_frame(spark, docs), "r1"))
    out = nodes.select("node_id", F.to_json("payload").alias("p"))
    assert rows(out, "node_id", "p") == [("n1", '{"v":2}'), ("n2", '{"v":3}')]


def test_two_names_of_one_time_are_one_snapshot(spark):
    doc = json.dumps(
        {
            "2024-01-01 00:00:00": {"c": {"n": {"v": 1}}},
            "2024-01-01T00:00:00Z": {"c": {"n": {"v": 2}}},
        }
    )
    nodes = latest_nodes(explode_snapshots(docs_frame(spark, [doc]), "r1"))
    assert rows(nodes.select(F.to_json("payload").alias("p")), "p") == [('{"v":2}',)]


def test_extracted_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(DOC)
    docs = read_telemetry_json(spark, str(tmp_path))
    assert rows(explode_snapshots(docs, "r"), "member", "cluster_id", "node_id") == [
        ("a.json", "c", "n1")
    ]


def test_rerun_replaces_its_run_only(spark, tmp_path):
    path = str(tmp_path)
    schema = S.TABLES["active_features"]

    def table(run, *names):
        return spark.createDataFrame(
            [(run, None, "c", "n", f) for f in names], schema
        )

    write_tables({"active_features": table("1", "a", "b")}, path, "1")
    write_tables({"active_features": table("2", "c")}, path, "2")
    write_tables({"active_features": table("1", "d")}, path, "1")
    out = read_parquet_tables(spark, path)["active_features"]
    assert rows(out, "run_id", "feature") == [("1", "d"), ("2", "c")]
    write_tables({"active_features": table("1")}, path, "1")
    out = read_parquet_tables(spark, path)["active_features"]
    assert rows(out, "run_id", "feature") == [("2", "c")]
    only = read_parquet_tables(spark, path, run_ids=["1"])["active_features"]
    assert only.count() == 0
    assert set(read_parquet_tables(spark, path)) == {"active_features"}


def test_staging_uses_the_session_setting(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    out = staged(spark.range(5), "five")
    assert out.count() == 5
    assert folder in out.inputFiles()[0]


def test_bundles_to_findings(spark, tmp_path):
    """The whole way: archives, stored tables, stored results."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()

    def payload(disk, build):
        return {
            "as_stat": {
                "meta_data": {"asd_build": build},
                "statistics": {"namespace": {"ns": {"service": {"data_used_pct": disk}}}},
                "config": {"service": {"x": build}},
            },
            "sys_stat": {"network_driver": "ena"},
        }

    doc = {
        TS: {
            "hot": {"n1": payload("80.5", "7.0"), "n2": payload("10", "7.1")},
            "cold": {"n1": payload("10", "7.0")},
        },
        "2024-01-02 00:00:00": {"hot": {"n1": payload("61", "7.0")}},
    }
    (src / "a.tgz").write_bytes(tar_bytes([("x_ascinfo.json", json.dumps(doc).encode())]))
    (src / "bad.tgz").write_bytes(b"broken")
    pipeline.ingest(spark, str(src), out, "r1")
    results = pipeline.analyze(spark, out, "r1")
    assert results.count() == 3 * 16
    assert results.schema == S.RESULT_SCHEMA
    status = {
        (r.cluster_id, r.snapshot_ts.day, r.id): r.status for r in results.collect()
    }
    assert status[("hot", 1, "2.d")] == "CRITICAL"
    assert status[("hot", 2, "2.d")] == "WARNING"
    assert status[("cold", 1, "2.d")] == "PASS"
    assert status[("hot", 1, "1.c")] == "WARNING"
    assert status[("hot", 2, "1.c")] == "PASS"
    assert status[("hot", 1, "3.a")] == "WARNING"
    assert status[("cold", 1, "3.b")] == "DATA MISSING"
    assert status[("cold", 1, "4.f")] == "SCHEMA MISMATCH"
    assert status[("cold", 1, "6.a")] == "DATA MISSING"
    rejects = spark.read.parquet(f"{out}/rejects")
    assert rejects.count() == 1
    # A second run stays beside the first and gives the same verdicts.
    pipeline.ingest(spark, str(src), out, "r2")
    again = pipeline.analyze(spark, out, "r2").drop("run_id", "evidence")
    first = pipeline.analyze(spark, out, "r1").drop("run_id", "evidence")
    assert again.exceptAll(first).count() == 0
    assert first.exceptAll(again).count() == 0


def test_plug_ins_and_meant_settings_beside_a_stored_coverage(spark, tmp_path):
    """An own extractor's table is stored, read again and judged; 3.b speaks; a failing extractor
    leaves no rows of an earlier run behind."""
    from clusterlens.extract import EXTRACTORS
    from clusterlens.extract.registry import extractor
    from clusterlens.rules.registry import REGISTRY, evidence, rule

    docs = docs_frame(spark, [document({"as_stat": {"config": {"service": {"x": "1"}}}, "mine": 7})])
    static = spark.createDataFrame(
        [(TS, "c", "n1", "service.x", "2")], "t string, cluster_id string, node_id string, "
        "config_name string, value string"
    ).select(
        F.lit("r").alias("run_id"), F.col("t").cast("timestamp").alias("snapshot_ts"),
        "cluster_id", "node_id", "config_name", "value",
    )
    try:

        @extractor("my_table")
        def my_table(nodes):
            n = F.try_variant_get("payload", "$.mine", "bigint")
            return nodes.select(*S.KEYS, "node_id", n.alias("n"))

        @rule("9.t", "Mine", "my_table")
        def my_rule(tables, keys):
            worst = tables["my_table"].groupBy(*keys).agg(F.max("n").alias("n"))
            return worst.select(
                *keys,
                F.when(F.col("n") > 5, F.lit(S.WARNING)).otherwise(F.lit(S.PASS)).alias("status"),
                F.lit("m").alias("message"),
                evidence(n="n").alias("evidence"),
            )

        out = str(tmp_path)
        pipeline.ingest_documents(docs, out, "r", static_configs=static)
        status = {r.id: r.status for r in pipeline.analyze(spark, out, "r").collect()}
        assert status["9.t"] == S.WARNING
        assert status["3.b"] == S.WARNING

        # Settings that are stored after the coverage are counted all the same.
        pipeline.ingest_documents(docs, out, "r2")
        late = static.withColumn("run_id", F.lit("r2"))
        write_tables({"static_configs": late}, out, "r2")
        status = {r.id: r.status for r in pipeline.analyze(spark, out, "r2").collect()}
        assert status["3.b"] == S.WARNING

        @extractor("my_table")
        def broken(nodes):
            raise ValueError("no such thing")

        pipeline.ingest_documents(docs, out, "r")
        status = {r.id: r.status for r in pipeline.analyze(spark, out, "r").collect()}
        assert status["9.t"] == S.DATA_MISSING
    finally:
        EXTRACTORS.pop("my_table", None)
        REGISTRY.pop("9.t", None)


LARGE = """
import json, resource, sys
sys.path.insert(0, {root!r})
from clusterlens.sources.telemetry import split_document

node = '{{"as_stat": {{"x": [' + ", ".join(['"' + "v" * 1000 + '"'] * 400) + ']}}}}'
nodes = ", ".join(f'"n{{i}}": {{node}}' for i in range(800))
text = '{{"2024-01-01 00:00:00": {{"c": {{' + nodes + '}}}}}}'
del nodes
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = size = 0
for row in split_document(text):
    n += 1
    size += len(row[-1])
after = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
print(json.dumps([len(text), n, size, 1024 * (after - before)]))
"""


def test_nodes_of_a_large_document_are_never_held_together():
    """320 MB: beside the text, the worker's memory grows by the size of some nodes."""
    import subprocess
    import sys

    from conftest import ROOT

    done = subprocess.run([sys.executable, "-c", LARGE.format(root=ROOT)], capture_output=True, text=True, check=True)
    length, n, size, grown = json.loads(done.stdout)
    assert length > 300e6 and n == 800 and size > 0.99 * length
    assert grown < 40e6


def test_last_of_equal_names_and_odd_numbers(spark):
    doc = (
        '{"2024-01-01 00:00:00": {"c": {"old": {"v": 1}}}, "2024-01-02 00:00:00": {"c": {"n": {"v": 2}}, '
        '"c": {"n": {"v": 3}, "m": {"v": NaN}, "n": {"v": 4}}}, "2024-01-01 00:00:00": {"c": {"new": {"v": 5}}, "d": {}}}'
    )
    out = explode_snapshots(docs_frame(spark, [doc]), "r").select("cluster_id", "node_id", F.to_json("payload").alias("p"))
    assert rows(out, "cluster_id", "node_id", "p") == [
        ("c", "m", '{"v":"NaN"}'), ("c", "n", '{"v":4}'), ("c", "new", '{"v":5}'), ("d", None, None)
    ]


# --- one pass, one parse, few batches ------------------------------------------------------------------


class _Caught:
    """Stands for a DataFrame and gives back the function that its tasks would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, f, schema):
        return f


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def _json_rows(spark, n):
    rows = [(f"b{i}", "m", document({"sys_stat": {"host": f"h{i}"}}, node=f"n{i}"), None) for i in range(n)]
    return spark.createDataFrame(rows, "bundle string, member string, json string, error string")


def test_nodes_of_many_documents_leave_in_one_batch():
    texts = [document({"a": i}, node=f"n{i}") for i in range(50)]
    columns = [[f"b{i}" for i in range(50)], ["m"] * 50, texts, [None] * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=telemetry.DOCUMENT_COLUMNS)
    made = list(telemetry._split_documents(_Caught())(iter([batch])))
    assert [b.num_rows for b in made] == [50]
    assert made[0].column("node_id").to_pylist() == [f"n{i}" for i in range(50)]


def test_members_of_many_archives_leave_in_one_batch():
    contents = [tar_bytes([("a.json", b"{}"), ("b", b"x")]) for _ in range(20)] + [b"broken", None]
    columns = [pa.array([f"b{i}" for i in range(22)]), pa.array(contents, pa.binary())]
    batch = pa.RecordBatch.from_arrays(columns, names=["bundle", "content"])
    made = list(bundles.list_members(_Caught())(iter([batch])))
    assert [b.num_rows for b in made] == [42]
    assert [r["ord"] for r in made[0].to_pylist()] == [0, 1] * 20 + [None, None]


def test_nodes_are_parsed_once(spark):
    good = explode_snapshots(_json_rows(spark, 3), "r1").filter(F.col("error").isNull())
    assert _plan(good.select("node_id", "payload")).count("parseJson") == 1


def test_metadata_read_the_nodes_once(spark):
    nodes = explode_snapshots(_json_rows(spark, 3), "r1").filter(F.col("error").isNull())
    assert _plan(metadata.extract_metadata(nodes)).count("MapInArrow") == 1


@pytest.mark.parametrize("name", ["n14_index_location", "s6_store_runs"])
def test_documents_are_opened_once(spark, sf_dir, monkeypatch, name):
    """Queries that use their nodes several times read them from files after the first time."""
    opened = []
    nodes = queries_telemetry.nodes
    monkeypatch.setattr(queries_telemetry, "nodes", lambda *a: opened.append(1) or nodes(*a))
    kept = []
    staged = sources.staged
    monkeypatch.setattr(sources, "staged", lambda df, n: kept.append(n) or staged(df, n))
    df = QUERIES[name](spark, sf_dir)
    assert len(opened) == 1 and len(kept) == 1 and "MapInArrow" not in _plan(df)
