import contextlib
import io
import json

import pyarrow.parquet as pq

from pyspark.sql import functions as F

from clusterlens.extract import EXTRACTORS, extractor, run_extractors
from clusterlens.extract import features, metadata, tables
from clusterlens.functions.variants import flatten
from clusterlens.sources import explode_snapshots, profile_structure, staged
from helpers import TS, nodes_of, rows

PAYLOAD = {
    "as_stat": {
        "meta_data": {"asd_build": "E-7.2.0.6"},
        "statistics": {
            "service": {"client_connections": 812, "note": None, "tags": [1, "x"], "empty": {}},
            "namespace": {
                "a": {
                    "service": {
                        "data_used_pct": "61.5",
                        "fail_key_busy": 0,
                        "service.x": 1,
                        "neg": -1,
                        "exp": "1e3",
                        "flag": True,
                        "list": [1],
                        "half": ".5",
                        "dot": ".",
                        "word": "12abc",
                    }
                },
                "b": {"objects": 5},
                "c": 7,
            },
            "set": {"a": {"s": {"objects": 1200, "gone": None}}},
            "xdr": {},
        },
        "config": {
            "service": {"proto-fd-max": 15000, "cluster-name": None},
            "statistics": {"skipped": 1},
            "deep": {"statistics": {"kept": 1}},
            "namespace": {"a": {"service": {"storage-engine": "device"}}},
        },
        "acl": {"users": {"app": {"connections": 40}, "none": {}, "text": {"connections": "7"}}},
    },
    "sys_stat": {"network_driver": "ena", "nested": {"a": 1}, "nothing": None},
    "text": '{"q":1}',
}


def test_node_stats_are_leaves_of_the_whole_payload(spark):
    out = dict(rows(tables.extract_node_stats(nodes_of(spark, {"n": PAYLOAD})), "metric", "value"))
    assert out["as_stat.statistics.service.client_connections"] == "812"
    assert out["as_stat.statistics.service.tags"] == '[1,"x"]'
    assert out["text"] == '{"q":1}'
    assert out["sys_stat.nested.a"] == "1"
    assert not [m for m in out if "note" in m or "empty" in m or m.endswith("xdr")]


def test_node_stats_keep_keys_with_dots_and_types(spark):
    df = tables.extract_node_stats(nodes_of(spark, {"n": {"a.b": {"c": 1.5}, "d": "x"}}))
    assert rows(df, "metric", "value", "value_type") == [
        ("a.b.c", "1.5", "DECIMAL(2,1)"),
        ("d", "x", "STRING"),
    ]


def test_flatten_stops_at_max_depth_with_json_text(spark):
    df = tables.flatten_payload(nodes_of(spark, {"n": {"a": {"b": {"c": {"d": 1}}}}}), max_depth=2)
    assert rows(df, "metric", "value") == [("a.b", '{"c":{"d":1}}')]


def test_flatten_opens_twelve_levels(spark):
    doc: object = 1
    for i in range(12, 0, -1):
        doc = {f"k{i}": doc}
    df = tables.flatten_payload(nodes_of(spark, {"n": doc}))
    assert rows(df, "metric", "value") == [(".".join(f"k{i}" for i in range(1, 13)), "1")]


def test_configs_skip_statistics_only_at_the_top(spark):
    out = dict(rows(tables.extract_configs(nodes_of(spark, {"n": PAYLOAD})), "config_name", "value"))
    assert out == {
        "service.proto-fd-max": "15000",
        "service.cluster-name": "None",
        "deep.statistics.kept": "1",
        "namespace.a.service.storage-engine": "device",
    }


def test_configs_fall_back_to_the_node_block(spark):
    payload = {"as_stat": {"statistics": {"x": 1}, "meta_data": {"y": 1}, "service": {"z": 2}}}
    df = tables.extract_configs(nodes_of(spark, {"n": payload}))
    assert rows(df, "config_name", "value", "source") == [("service.z", "2", "config")]


def test_namespace_stats_keep_plain_numbers(spark):
    df = tables.extract_namespace_stats(nodes_of(spark, {"n": PAYLOAD}))
    assert rows(df, "namespace", "metric", "value") == [
        ("a", "service.data_used_pct", 61.5),
        ("a", "service.fail_key_busy", 0.0),
        ("a", "service.half", 0.5),
        ("a", "service.x", 1.0),
        ("b", "service.objects", 5.0),
    ]


def test_namespace_stats_read_the_older_container(spark):
    payload = {"as_stat": {"namespaces": {"old": {"objects": 3}}}}
    df = tables.extract_namespace_stats(nodes_of(spark, {"n": payload}))
    assert rows(df, "namespace", "metric", "value", "source") == [
        ("old", "service.objects", 3.0, "statistics")
    ]


def test_sets_security_and_system_info(spark):
    nodes = nodes_of(spark, {"n": PAYLOAD, "bare": {}})
    assert rows(tables.extract_set_stats(nodes), "ns", "set_name", "key", "value") == [
        ("a", "s", "gone", "None"),
        ("a", "s", "objects", "1200"),
    ]
    assert rows(tables.extract_security(nodes), "node_id", "user", "connections") == [
        ("n", "app", 40),
        ("n", "none", 0),
        ("n", "text", 7),
    ]
    assert rows(tables.extract_system_info(nodes), "node_id", "metric", "value") == [
        ("n", "nested", '{"a":1}'),
        ("n", "network_driver", "ena"),
        ("n", "nothing", "None"),
    ]


def meta(spark, payload, **kw):
    df = metadata.node_metadata(nodes_of(spark, {"n": payload}), **kw)
    return df.first().asDict()


def test_version_falls_back_and_ignores_empty_text(spark):
    m = meta(spark, PAYLOAD)
    assert (m["server_version"], m["major_version"]) == ("E-7.2.0.6", "E-7")
    stats = {"as_stat": {"meta_data": {"asd_build": ""}, "statistics": {"service": {"asd_build": "6.4"}}}}
    assert meta(spark, stats)["server_version"] == "6.4"
    assert meta(spark, {})["major_version"] == "Unknown"


def test_consistency_storage_and_topology(spark):
    def ns(**engines):
        return {
            "as_stat": {
                "config": {
                    "namespace": {n: {"service": s} for n, s in engines.items()},
                },
                "statistics": {"xdr": {"dc": 1}},
            }
        }

    m = meta(
        spark,
        ns(
            a={"storage-engine": {"file": 1}},
            b={"storage-engine": "My-Device", "strong-consistency": "TRUE"},
            c={},
        ),
    )
    assert m["storage_flavor"] == "DEVICE/FILE/MEMORY"
    assert m["consistency_model"].startswith("Strong")
    assert m["topology"] == "XDR Enabled"
    m = meta(spark, ns(a={"storage-engine": 7, "strong-consistency": True}))
    assert (m["storage_flavor"], m["consistency_model"][:6]) == ("MEMORY", "Strong")
    m = meta(spark, PAYLOAD)
    assert (m["storage_flavor"], m["topology"]) == ("DEVICE", "Standalone")
    assert m["consistency_model"].startswith("Available")


def test_platform(spark):
    assert meta(spark, {"x": {"host": "a.EC2.Internal"}})["cloud_platform"] == "AWS"
    assert meta(spark, {"cloudapp": 1})["cloud_platform"] == "Azure"
    assert meta(spark, {"ip": "10.94.0.1", "z": "azure"})["cloud_platform"] == "AWS"
    assert meta(spark, {})["cloud_platform"] == "Bare Metal / On-Prem"


def test_platform_tiers(spark):
    def tier(config, **extra):
        payload = {"as_stat": {"config": config}, **extra}
        return meta(spark, payload, platform_mode="tiered")["cloud_platform"]

    assert tier({"a": "x.gce.internal", "b": "10.94.1.1"}) == "GCP"
    assert tier({"b": "10.94.1.1"}) == "AWS"
    assert tier({"b": "us-east-1", "c": "db_va7x"}) == "Azure"
    assert tier({}, outside="amazonaws.com") == "Bare Metal / On-Prem"


def test_metadata_takes_the_last_node(spark):
    nodes = nodes_of(
        spark,
        {
            "n1": {"as_stat": {"meta_data": {"asd_build": "9"}}},
            "n2": {"as_stat": {"meta_data": {"asd_build": "8"}}},
        },
    )
    out = {r.key: (r.value, r.n_values) for r in metadata.extract_metadata(nodes).collect()}
    assert out["server_version"] == ("8", 2)
    assert out["cluster_name"] == ("c", 1)
    assert set(out) == {*metadata.METADATA_KEYS, "cluster_name"}


def test_features(spark):
    def feats(payload):
        return {r.feature for r in features.detect_features(nodes_of(spark, {"n": payload})).collect()}

    def service(**kw):
        return {"as_stat": {"statistics": {"service": kw}}}

    assert feats(service(stat_read_reqs="3", batch_initiate=0, query_success="x")) == {"KVS"}
    assert feats(service(**{"sindex-used-bytes-memory": 1.5, "self-group-id": "2"})) == {
        "SIndex",
        "Rack-aware",
    }
    assert feats({"as_stat": {"config": {"xdr": {}}}}) == {"XDR"}
    assert feats({"as_stat": {"config": {"security": {"enable-security": "True"}}}}) == {"Security"}
    tls = {"as_stat": {"config": {"xdr": 1, "network": {"fabric": {"tls-port": "4333"}}}}}
    assert feats(tls) == {"XDR", "TLS"}
    tls["as_stat"]["config"]["network"]["service"] = {"tls-port": "none"}
    assert feats(tls) == set()
    ns = {
        "as_stat": {
            "statistics": {
                "namespace": {
                    "a": {"service": {"pi_query_long": 2, "si_query_x": 0, "client_udf_error": 1}}
                }
            },
            "config": {
                "namespace": {
                    "a": {"service": {"rack-id": "1", "strong-consistency": "true"}},
                    "unseen": {"service": {"index-type": "flash"}},
                }
            },
        }
    }
    assert feats(ns) == {"UDF", "PIndex Query", "Rack-aware", "SC"}
    ns["as_stat"]["config"]["namespace"]["a"]["service"]["index-type"] = "flash"
    assert "Index-on-flash" in feats(ns)


def test_index_location(spark):
    nodes = nodes_of(
        spark,
        {"n": {"as_stat": {"statistics": {"namespace": {"a": {"service": {"index-type.mount[0].age": 1}}}}}}},
    )
    stats = tables.extract_namespace_stats(nodes)
    meta_df = metadata.extract_metadata(nodes)
    clusters = nodes.select("run_id", "snapshot_ts", "cluster_id").distinct()
    assert metadata.index_location(clusters, meta_df, stats).first()["index_location"].startswith("Flash")
    assert metadata.index_location(clusters, meta_df, stats.filter("false")).first()[
        "index_location"
    ].startswith("RAM")


def test_extractor_plug_in_and_isolation(spark):
    nodes = nodes_of(spark, {"n": PAYLOAD})
    registry = dict(EXTRACTORS)

    def bad(nodes):
        return nodes.select("no_such_column")

    registry["bad"] = bad
    out = run_extractors(nodes, registry)
    assert set(out) == set(EXTRACTORS)

    before = dict(EXTRACTORS)
    try:

        @extractor("own")
        def own(nodes):
            return nodes.select("node_id")

        assert run_extractors(nodes)["own"].count() == 1
    finally:
        EXTRACTORS.clear()
        EXTRACTORS.update(before)


def test_profile_structure(spark):
    nodes = nodes_of(spark, {"n1": {"a": {"b": 1, "c": [1]}}, "n2": {"a": {"b": 2}, "e": {}}})
    assert rows(profile_structure(nodes), "path", "type", "n_children", "n_nodes") == [
        ("a", "OBJECT", 2, 2),
        ("a.b", "BIGINT", 0, 2),
        ("a.c", "ARRAY<BIGINT>", 0, 1),
        ("e", "OBJECT", 0, 1),
    ]


def nested(depth):
    """An object with a leaf, an empty object and two branches on every level."""
    doc = {"end": 1}
    for i in range(depth):
        doc = {"d": doc, f"leaf{i}": i, "void": {}, "list": [{"x": i}], "null": None, "o": {"t": "{}"}}
    return doc


def recursion(doc, prefix=""):
    out = {}
    for key, value in doc.items():
        name = f"{prefix}.{key}" if prefix else key
        out.update(recursion(value, name) if isinstance(value, dict) else {name: value})
    return out


def test_any_depth_equals_recursion(spark):
    for depth in (11, 12, 13, 16, 40, 150):
        doc = nested(depth)
        nodes = nodes_of(spark, {"n": {"as_stat": {"config": doc}}, "flat": {"as_stat": {"config": {"a": 1}}}})
        want = recursion(doc)
        stats = tables.flatten_payload(nodes).filter("node_id = 'n'")
        got = {r.metric.removeprefix("as_stat.config."): r.value for r in stats.collect()}
        assert got == {k: json.dumps(v, separators=(",", ":")) if isinstance(v, list) else str(v)
                       for k, v in want.items() if v is not None}
        configs = tables.extract_configs(nodes).filter("node_id = 'n'")
        assert {r.config_name for r in configs.collect()} == set(want)
        shape = {r.path: (r.type, r.n_children) for r in profile_structure(nodes).collect()}
        top = "as_stat.config" + ".d" * (depth - 1)
        assert shape[top][0] == "OBJECT" and shape[top][1] == 6
        assert shape[f"{top}.d.end"] == ("BIGINT", 0) and shape[f"{top}.void"][0] == "OBJECT"


def test_flatten_opens_each_object_once(spark):
    """Opening an object writes all below it anew, so a level opens it once and uses it several times."""
    one = spark.sql("SELECT parse_json('{\"a\":{\"b\":{\"c\":1}}}') AS v FROM range(1)")
    for inner in (False, True):
        df = one.select(F.explode(flatten(F.col("v"), 3, inner=inner)))
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain("extended")
        analyzed = out.getvalue().split("== Analyzed Logical Plan ==")[1].split("== Optimized")[0]
        assert analyzed.count("as map<string,variant>") == 3  # the value, and members of two levels


def analyzed_plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue().split("== Analyzed Logical Plan ==")[1].split("== Optimized")[0]


def test_features_read_a_payload_once(spark):
    nodes = spark.createDataFrame([("r", "c", "n")], "run_id string, cluster_id string, node_id string")
    nodes = nodes.select("*", F.lit(TS).cast("timestamp").alias("snapshot_ts"), F.parse_json(F.lit("{}")).alias("payload"))
    plan = analyzed_plan(features.detect_features(nodes))
    assert plan.count("cast(payload") == 1 and "variant_get" not in plan


def test_features_of_odd_values(spark):
    def feats(statistics, config):
        payload = {"as_stat": {"statistics": statistics, "config": config}}
        return {r.feature for r in features.detect_features(nodes_of(spark, {"n": payload})).collect()}

    on = {"stat_read_reqs": True, "batch_initiate": [1], "query_reqs": "NaN", "tscan_initiate": {"x": 1}}
    assert feats({"service": on, "namespace": [1]}, {"xdr": None}) == {"KVS", "XDR"}
    counters = {"pi_query_a": "x", "pi_query_b": True, "si_query_a": None}
    assert feats({"namespace": {"a": {"service": counters}, "b": 1}}, {"namespace": {"a": 1}}) == {"PIndex Query"}
    assert feats({"service": {"stat_read_reqs": 1}}, {"network": {"fabric": {"tls-port": None}}}) == set()


def test_namespace_numbers_are_read_without_their_objects(spark):
    nodes = nodes_of(spark, {
        "n": {"as_stat": {"statistics": {"namespace": None}, "namespaces": {"old": {"x": 1}}}},
        "m": {"as_stat": {"statistics": {"namespace": {"a": {"service": None, "x": 1}, "b": {"y": "2"}, "c": 3}}}},
    })
    df = tables.extract_namespace_stats(nodes)
    assert rows(df, "node_id", "namespace", "metric", "value") == [("m", "b", "service.y", 2.0)]
    assert "map<string,string>" in analyzed_plan(df)


def test_levels_opened_as_rows_give_the_same_leaves(spark):
    doc = {"a": {"b": {"c": {"d": [1, {"x": 2}], "e": {}, "": {"f": None}}}, "": 1}, "l": [], "o": {}, "t": "{}"}
    nodes = nodes_of(spark, {"n": doc, "list": "[1]", "text": '"x"', "none": "null"})
    want = rows(tables.flatten_payload(nodes, upper_levels=1), "node_id", "metric", "value", "value_type")
    assert [r[1] for r in want] == ["a.", "a.b.c.d", "l", "t"]
    for levels in (2, 3, 4, 5, 9):
        got = tables.flatten_payload(nodes, upper_levels=levels)
        assert rows(got, "node_id", "metric", "value", "value_type") == want


def test_leaves_are_done_before_the_uncompiled_step(spark):
    """Only what is an object below the upper levels goes on as a VARIANT."""
    nodes = nodes_of(spark, {"n": PAYLOAD})
    for df in (tables.extract_node_stats(nodes), tables.extract_configs(nodes)):
        assert "inline(coalesce(deeper" in analyzed_plan(df)


def test_stored_payloads_stay_whole(spark):
    docs = spark.createDataFrame(
        [("b", "m", json.dumps({TS: {"c": {f"n{i}": {"as_stat": {"x": i}} for i in range(9)}}}), None)],
        "bundle string, member string, json string, error string",
    )
    stored = staged(explode_snapshots(docs, "r"), "whole")
    for file in stored.inputFiles():
        fields = pq.read_schema(file.removeprefix("file:")).field("payload").type
        assert {f.name for f in fields} == {"value", "metadata"}
    assert stored.filter("payload IS NOT NULL").count() == 9
