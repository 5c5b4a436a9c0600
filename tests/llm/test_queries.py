"""Driver queries against DuckDB, and those without SQL against brute force."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from clusterlens.llm import packing, registry
from tools.compare import TABLES, canon


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    got = [list(r.asDict(recursive=True).values()) for r in df.collect()]
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert canon(df.columns, got) == canon(cols, cur.fetchall())


@pytest.fixture(scope="module")
def encoded(duck):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    ids = whole.encode_batch([t for _, t in rows], add_special_tokens=False)
    return {i: e.ids for (i, _), e in zip(rows, ids, strict=True)}


def test_packing_round_trip(spark, sf_dir, encoded):
    out = entry.queries()["op10_packing"](spark, sf_dir).collect()
    seen = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        ids = [*encoded[r["doc_id"]], 0][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"] and len(ids) == r["length"]
        assert r["offset"] == seen.get(r["sequence_id"], 0)
        seen[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(seen.values()) <= 2048
    total = sum(len(i) + 1 for i in encoded.values())
    assert sum(seen.values()) == total and len(seen) <= -(-total // 2048) + 2


def test_local_search_empties_a_bin():
    start = {((1000, 1), (900, 1)): 1, ((1100, 1),): 1, ((148, 1), (900, 1)): 1}
    assert sum(packing.improve(start, 2048).values()) == 2


def test_token_counts_are_whole(spark, sf_dir, encoded):
    for r in entry.queries()["op4_token_counts"](spark, sf_dir).collect():
        assert r["n_tokens"] == len(encoded[r["doc_id"]])


def test_learned_queries_on_held_out_rows(spark, duck, sf_dir):
    lang = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = entry.queries()["op8_language_id"](spark, sf_dir).collect()
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in out]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)
    toxic = entry.queries()["op6_toxicity"](spark, sf_dir).collect()
    assert len(toxic) == len(lang) and all(r["predicted"] == (r["score"] >= 0.7) for r in toxic)


def test_pipeline(spark, sf_dir):
    rows = entry.queries()["pipeline"](spark, sf_dir)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.count() > 0
