"""Token counts over stored trees: the query, further rounds of edits, and added tokens in texts."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clusterlens.llm import token_counts, tokens
from clusterlens.llm.common import read, staged


def edited(text, edits):
    """The text after edits in places of the old text; a later edit keeps what an earlier one left."""
    out, at = [], 0
    for start, length, new in sorted(edits):
        a = max(at, min(max(start, 0), len(text)))
        out += [text[at:a], new]
        at = max(a, min(max(start, 0) + length, len(text)))
    return "".join([*out, text[at:]])


def whole():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_query_reads_stored_trees_and_edits(spark, sf_dir, monkeypatch):
    stored = {}

    def keep(df, name):
        stored[name] = staged(df, name)
        return stored[name]

    monkeypatch.setattr(token_counts, "staged", keep, raising=False)
    got = {r["doc_id"]: r for r in token_counts.op4_token_counts(spark, sf_dir).collect()}
    docs = {r["doc_id"]: r["text"] or "" for r in read(spark, sf_dir, "documents").collect()}
    assert set(stored) == {"trees", "edits"} and len(got) == len(docs)
    assert stored["trees"].count() == len(docs) and stored["edits"].count() == 3 * len(docs)
    edits = {}
    for r in stored["edits"].collect():
        edits.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["replacement"]))
    names = list(docs)
    after = [edited(docs[i], edits[i]) for i in names]
    encoder = whole()
    before = encoder.encode_batch([docs[i] for i in names], add_special_tokens=False)
    now = encoder.encode_batch(after, add_special_tokens=False)
    for i, text, x, y in zip(names, after, before, now, strict=True):
        r = got[i]
        assert (r["n_chars"], r["n_tokens"], r["n_edits"]) == (len(docs[i]), len(x.ids), 3)
        assert (r["n_chars_after"], r["n_tokens_after"]) == (len(text), len(y.ids))


def test_new_trees_take_further_edits(spark):
    text = " ".join(f"word{i}" for i in range(2000)) + " <|endoftext|> end"
    docs = [(1, text), (2, "short"), (3, None), (None, "nobody's")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    trees = token_counts.build_trees(table)
    encoder = whole()
    rounds = [
        [(1, 0, 5, "x"), (1, 3000, 2500, ""), (1, 9000, 0, "<|endoftext|>"), (2, 5, 0, " tail")],
        [(1, 3000, 1, " "), (1, 2999, 0, "é"), (1, 8990, 40, "\n\n"), (2, 0, 99, "")],
        [(1, 0, 10**6, ""), (2, 0, 0, " a b c"), (3, 4, 4, "new")],
    ]
    now = dict(docs)
    for n, changes in enumerate(rounds):
        edits = spark.createDataFrame(changes, "doc_id long, start int, length int, replacement string")
        got = token_counts.count_edited(table, trees, edits)
        got = staged(got, "edited")
        now = {i: edited(t or "", [c[1:] for c in changes if c[0] == i]) for i, t in now.items()}
        for r in got.collect():
            ids = encoder.encode(now[r["doc_id"]], add_special_tokens=False).ids
            assert (r["n_chars_after"], r["n_tokens_after"]) == (len(now[r["doc_id"]]), len(ids)), n
            assert sum(r["node_tokens"][: r["leaves"]]) == len(ids) == r["node_tokens"][-1]
            assert r["doc_id"] != 1 or n == 2 or r["n_encoded"] < 8000  # the rest was not encoded again
        table = spark.createDataFrame(list(now.items()), "doc_id long, text string")
        trees = got.select(
            "doc_id", "version", F.col("n_chars_after").alias("chars"), F.col("n_tokens_after").alias("tokens"),
            "leaves", "node_chars", "node_tokens",
        )


def test_ids_of_added_tokens():
    ids, encoder = tokens.token_ids("byte_bpe_50k.json"), whole()
    for text in ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext|", "x<|endoftext|><|endoftext|>\n  y", "", " "):
        assert np.frombuffer(ids(text), "<u4").tolist() == encoder.encode(text, add_special_tokens=False).ids
