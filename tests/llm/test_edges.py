"""Every operator on nulls, empty and long texts, ties, repeated rows, no rows, and clashing columns."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from clusterlens.llm import (
    decontamination,
    embedding_dedup,
    language_id,
    line_dedup,
    ngram_join,
    packing,
    secret_scan,
    token_counts,
    toxicity,
    url_filter,
)

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()
LONG = " ".join(WORDS[i * 7 % 16] + str(i % 97) for i in range(30_000))
SCHEMA = """doc_id long, text string, lang string, source string, n_chars long, version string,
    row string, n int, keep string, found string"""


@pytest.fixture(scope="module")
def docs(spark):
    near = " ".join(f"w{i}" for i in range(60))
    texts = [
        (1, near),
        (2, near),
        (2, near),
        (3, near.replace("w59", "other")),
        (4, None),
        (5, ""),
        (6, " \n\t"),
        (7, LONG),
        (8, "A repeated line here\nown line eight"),
        (9, "a REPEATED line here  \nshort\nshort"),
        (None, "a repeated line here\nsecond"),
        (None, None),
        (10, "password = hunter2000 é AKIA" + "A" * 16),
    ]
    rows = [(i, t, "en", "s", None, "v", "r", 1, "k", "f") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(docs, none):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got[8] == ["A repeated line here\nown line eight"]
    assert got[9] == ["short\nshort"]
    assert sorted(got[None], key=str) == [None, "second"]
    assert got[1][0] and got[2] == ["", ""] and got[7] == [LONG]
    assert line_dedup.dedup_lines(none).count() == 0


def test_ngram_join(docs, none):
    found = ngram_join.jaccard_components(docs)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()}
    assert found.count() == docs.count()
    assert {(1, 56, 1), (2, 56, 1), (3, 56, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6)} <= got
    assert (None, 0, None) in got
    one = ngram_join.representatives(docs)
    assert one.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in one.collect()) == [0, 0, 1, 4, 5, 6, 7, 8, 9, 10]
    assert ngram_join.jaccard_components(none).count() == 0


def test_decontamination(spark, docs, none):
    items = [(1, " ".join(f"w{i}" for i in range(20, 40))), (1, "hunter2000"), (2, None), (None, "short"), (3, "..")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (10_000, 1):  # the second way takes one pass per item
        rows = decontamination.contamination(docs, bench, block_words=block)
        got = {r["row"]["doc_id"]: r["found"] for r in rows.collect()}
        assert [(m["item_id"], m["at"], m["n"]) for m in got[1]["matches"]] == [(1, 20, 20)]
        assert [m["item_id"] for m in got[10]["matches"]] == [1]
        assert got[4]["n_words"] == 0 and not got[9]["matches"]
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 5
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(docs, empty).count() == docs.count()
    assert decontamination.decontaminate(none, bench).count() == 0


def test_longest_match_and_overlap(spark):
    items = spark.createDataFrame([(7, " ".join(f"t{i}" for i in range(30)))], "item_id long, text string")
    text = "x " + " ".join(f"T{i}" for i in range(5, 25)) + " y " + " ".join(f"t{i}" for i in range(12))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = decontamination.contamination(docs, items).first()["found"]
    assert [(m["item_at"], m["at"], m["n"]) for m in found["matches"]] == [(5, 1, 20), (0, 22, 12)]


def test_packing(docs, none):
    out = packing.pack_documents(docs).collect()
    fill = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 2048
    empty = [r for r in out if r["doc_id"] == 4]
    assert [(r["length"], r["ids_crc32"]) for r in empty] == [(1, zlib.crc32(bytes(4)))]
    pieces = sorted((r["piece"], r["start"], r["length"]) for r in out if r["doc_id"] == 7)
    assert all(n == 2048 for _, _, n in pieces[1:]) and pieces[0][1] == 0
    assert [s for _, s, _ in pieces[1:]] == [p[1] + p[2] for p in pieces[:-1]]
    assert packing.pack_documents(none).count() == 0


def test_language_id(spark, docs, none):
    lines = [("en", f"the house and the tree number {WORDS[i % 16]}") for i in range(30)]
    lines += [("de", f"das Haus und der Baum über {WORDS[i % 16]}ß") for i in range(30)]
    lines += [(None, "x"), ("en", None), ("de", "")]
    model = language_id.train(spark.createDataFrame(lines, "lang string, text string"))
    texts = ["the tree", "über das Haus", "", None, "123 !!", "zxqj жшчц ыъэю " * 9, "the " * 50_000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = [r["r"] for r in rows.select(language_id.identify(model, rows["text"], spark).alias("r")).collect()]
    assert [g["lang"] for g in got[:5]] == ["en", "de", "und", "und", "und"]
    assert [g["rejected"] for g in got] == [False, False, True, True, True, True, False]
    assert all(0 <= g["score"] <= 1 for g in got)
    untaught = language_id.train(none)
    assert {r["r"]["lang"] for r in docs.select(language_id.identify(untaught, docs["text"], spark).alias("r")).collect()} == {"und"}
    assert none.select(language_id.identify(model, none["text"], spark).alias("r")).count() == 0


def test_kneser_ney_sums_to_one():
    text = np.frombuffer(b"abracadabra alakazam abba", np.uint8)
    key = language_id.stream(text, np.array([0, len(text)]))[0]
    gram, n = np.unique(key, return_counts=True)
    model = language_id.build_model({"x": (gram, n)})
    letters = np.unique(gram & np.uint64(0xFFFF))
    for context in np.unique(gram >> np.uint64(16)):
        asked = (context << np.uint64(16)) | letters
        assert np.exp(model.log_probs(asked)).sum() <= 1 + 1e-4
        assert np.exp(model.log_probs(asked)).sum() > 0.9


def test_url_filter(spark):
    urls = ["HTTP://Www.Example.ORG/es/1?x", "http://a.org", "http://a.org/", "ftp://x.com/de/#", None, "no host",
            "http://example.org/en/12", "http://notexample.org/es/1", "http://org/", "://", "http://x.com/" + "d" * 50_000]
    rows = [(i if i != 5 else None, u, "h", "v") for i, u in enumerate(urls)] + [(0, urls[0], "h", "v")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string").repartition(2)
    want = {0: "example.org/es/", 1: None, 2: "org/", 3: "com/de/", 4: None, 6: "example.org/en/1", 7: "org/", 8: "org/"}
    for limit in (url_filter.BROADCAST_RULES, 0):  # 0: the way of many rules
        kept, url_filter.BROADCAST_RULES = url_filter.BROADCAST_RULES, limit
        out = url_filter.judge(pages, url_filter.rules_table(spark)).collect()
        url_filter.BROADCAST_RULES = kept
        assert len(out) == len(rows) and sum(r["page_id"] == 0 for r in out) == 3
        got = {r["page_id"]: r for r in out}
        assert {k: got[k]["rule"] for k in want} == want
        assert got[0]["verdict"] == "block" and got[None]["host"] == "" and got[4]["verdict"] == "allow"
    assert url_filter.judge(pages, url_filter.rules_table(spark).limit(0)).count() == len(rows)
    assert url_filter.judge(pages.limit(0), url_filter.rules_table(spark)).count() == 0


def test_embedding_dedup(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((6, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(10, base[0].tolist()), (10, base[0].tolist()), (11, (base[1] * 3 + 0.01).tolist())]
    rows += [(20, None), (21, []), (22, [0.0] * 16), (23, [float("nan")] * 16), (24, [None] * 16), (None, base[2].tolist()), (30, [1.0, 2.0]), (31, [2.0, 4.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = embedding_dedup.near_vectors(table).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}
    assert len(out) == len(rows)
    assert got[0] == (2, 0, True) and got[10] == (2, 0, False) and got[11] == (1, 1, False)
    assert got[2] == (0, 2, True) and got[None] == (0, None, False)
    assert all(got[i] == (0, i, True) for i in (20, 21, 22, 23, 24)) and got[31] == (1, 30, False)
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0


def test_embedding_blocks_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    seeds = rng.standard_normal((12, 8))
    x = (seeds[rng.integers(0, 12, 600)] + 0.1 * rng.standard_normal((600, 8))).astype(float)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(table, threshold=0.95).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert [got[i] for i in range(600)] == ((u @ u.T >= 0.95).sum(1) - 1).tolist()


def test_secret_scan(spark, docs, none):
    new, found = secret_scan.scan(docs, path="doc_id")
    got = {r["path"]: sorted((f["kind"], f["start"], f["end"]) for f in r["findings"]) for r in found.collect()}
    assert found.count() == docs.count()
    assert got[10] == [("access", 24, 44), ("assign", 0, 21)] and got[4] == []
    n_blobs = docs.select("text").fillna("").distinct().count()
    assert new.count() == 3 * n_blobs
    # a second run over known blobs scans nothing, a new rule version scans all blobs once more
    more = docs.union(spark.createDataFrame([(99, "token: abcdefgh", *[None] * 8)], SCHEMA))
    again, found = secret_scan.scan(more, ledger=new, path="doc_id")
    assert again.count() == 3 and {r["path"] for r in found.filter("size(findings) > 0").collect()} == {10, 99}
    rules = [secret_scan.Rule("hex", 2, "[0-9a-f]{4,}", 0, 4)]
    assert secret_scan.scan(docs, ledger=new, rules=rules, path="doc_id")[0].count() == n_blobs
    assert secret_scan.scan(none, path="doc_id")[1].count() == 0


def test_dropped_match_is_consumed(spark):
    docs = spark.createDataFrame([("a", "secret: token: abcdefgh")], "path string, text string")
    assert secret_scan.scan(docs)[1].first()["findings"] == []


def test_toxicity(spark, docs, none):
    rows = [(f"{WORDS[i % 16]} {WORDS[i * 5 % 16]} you idiot {WORDS[i * 3 % 16]}", 1) for i in range(40)]
    rows += [(f"{WORDS[i % 16]} {WORDS[i * 5 % 16]} dear you {WORDS[i * 3 % 16]}", 0) for i in range(120)]
    model = toxicity.train(spark.createDataFrame([*rows, (None, 1), ("x", None), ("y", 7)], "text string, toxic int"))
    asked = spark.createDataFrame([("alpha idiot beta",), ("alpha dear beta",), (None,), ("",), (LONG,)], "text string").coalesce(1)
    got = [r["r"] for r in asked.select(toxicity.passages(model, asked["text"], spark).alias("r")).collect()]
    assert got[0]["score"] >= 0.7 and [(p["first"], p["end"]) for p in got[0]["passages"]] == [(1, 2)]
    assert all(g["score"] < 0.5 for g in got[1:])
    untaught = toxicity.train(spark.createDataFrame([], "text string, toxic int"))
    assert {r["r"]["score"] for r in docs.select(toxicity.passages(untaught, docs["text"], spark).alias("r")).collect()} == {0.0}


def test_maximal_segments_against_brute_force():
    def brute(x):
        def best(a, b):
            found = [(sum(x[i:j]), i - j, i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
            top = max(found, default=(0,))
            if top[0] <= 0:
                return []
            return [*best(a, top[2]), (top[2], top[3]), *best(top[3], b)]

        return best(0, len(x))

    rng = np.random.default_rng(1)
    for _ in range(200):
        x = (rng.standard_normal(rng.integers(0, 12)) * 3).tolist()
        assert [(a, b) for a, b, _ in toxicity.segments(x)] == brute(x)


def test_token_counts(spark, docs, none):
    trees = token_counts.build_trees(docs)
    edits = spark.createDataFrame(
        [(7, 100, 5, "new words"), (7, 10**6, 3, None), (1, -5, 2, "x"), (1, 4, 0, " y"), (77, 1, 1, "z"), (None, 0, 0, "q")],
        "doc_id long, start int, length int, replacement string",
    )
    out = token_counts.count_edited(docs, trees, edits).collect()
    assert len(out) == docs.count()
    count = token_counts.Counter()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect() if r["doc_id"]}
    after = {7: LONG[:100] + "new words" + LONG[105:], 1: "x" + texts[1][2:4] + " y" + texts[1][4:]}
    for r in out:
        if r["doc_id"]:
            assert r["n_tokens"] == count(texts[r["doc_id"]])
            assert r["n_tokens_after"] == count(after.get(r["doc_id"], texts[r["doc_id"]]))
    assert next(r for r in out if r["doc_id"] == 7)["n_encoded"] < len(LONG) / 20
    assert token_counts.count_edited(none, token_counts.build_trees(none), edits).count() == 0


def test_edits_against_whole_texts():
    rng = np.random.default_rng(2)
    letters = list("ab cd  \n\t'st're ÉÉ 12 ..--  x")
    count = token_counts.Counter()
    word = lambda n: "".join(rng.choice(letters, n))
    for _ in range(300):
        text = word(rng.integers(0, 1500))
        tree = token_counts.build(text, count)
        edits = [(int(rng.integers(-2, len(text) + 3)), int(rng.integers(0, 30)), word(rng.integers(0, 9))) for _ in range(rng.integers(0, 5))]
        new = token_counts.apply_edits(text, tree, edits, count)
        assert tree.root == (len(new), len(count.ids(new)) // 4)


def test_pipeline_on_odd_rows(spark, docs, none):
    bench = "/root/testdata/sf0.001"
    for rows in (docs.select("doc_id", "text", "lang", "source", "n_chars"), none.select("doc_id", "text", "lang", "source", "n_chars")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, bench)
            if name != "packing":
                assert out.columns == rows.columns
            rows = out
        rows.collect()
