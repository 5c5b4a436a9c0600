"""Token alignment against the two libraries and plain dicts; the minimal perfect hash by itself."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from clusterlens.llm import token_alignment as ta
from clusterlens.llm.common import read


def byte_letters():
    """Bytes by the letters that stand for them in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute_force(docs):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_letters()

    def in_b(i):
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    def ends(ids, spelled):
        return np.cumsum([len(spelled(i)) for i in ids]).tolist()

    def in_a(i):
        return bytes(letters[c] for c in whole.id_to_token(i))

    rows = []
    for doc_id, text in docs:
        a = whole.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        want = (" " + text).encode() if text else b""
        if b"".join(map(in_a, a)) != want or b"".join(map(in_b, b)) != want:
            a, b = [], []
        end_a, end_b = ends(a, in_a), ends(b, in_b)
        both = sorted(set(end_a) & set(end_b))
        groups, links, i, j = [], [], 0, 0
        for end in both:
            x, y = end_a.index(end, i) + 1, end_b.index(end, j) + 1
            groups.append(f"{','.join(map(str, a[i:x]))}|{','.join(map(str, b[j:y]))}")
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        rows.append((doc_id, a, b, groups, links))
    count = Counter(link for r in rows for link in r[4])
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for doc_id, a, b, groups, links in rows:
        best = sum(count[x] == top[x[1]] for x in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), best, sum(count[x] for x in links), digest))
    return sorted(out, key=str)


def digests(found):
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return sorted((tuple(r) for r in found.withColumn("groups", digest).collect()), key=str)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    got = entry.queries()["op12_token_alignment"](spark, sf_dir)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_force(docs)


ODD = ["", None, " ", "\n", "a  b", "  a", "a\nb\n\n c", "x▁y", "▁", "<s> </s> <unk> <0x41>", "<|endoftext|> a", "\x00a"]
ODD += ["ﬁ Å ½ ａ 中文 字", "\x1c \x1c a", "\x85 b   c \xa0 d", "👩‍👩‍👧 ok", "a" * 3000, "don't  we'll I'm", "é ​ x"]
ODD += ["word " * 30, "word ▁" * 30, "ab cd\n" * 50]


def test_odd_texts(spark, monkeypatch):
    random.seed(3)
    letters = [*" \n\tab'éß中\xa0\x1c0<|endoftext|>19.,😀", "▁"]
    made = ["".join(random.choices(letters, k=random.randint(1, 60))) for _ in range(400)]
    rows = [*enumerate(ODD + made), (None, "the house"), (5, "the house"), (5, "the house")]
    odd = spark.createDataFrame([(i, t, "x", 1, b"k") for i, t in rows], "doc_id long, text string, a string, n_best int, keys binary")
    want = brute_force(rows)
    for portion, share in ((ta.PORTION, ta.SHARE), (40, 16)):  # the second cuts every longer text
        monkeypatch.setattr(ta, "PORTION", portion)
        monkeypatch.setattr(ta, "SHARE", share)
        tokens = ta.encode_documents(odd.repartition(3))
        counts = ta.pair_counts(tokens)
        for limit in (ta.TABLE_BYTES, 2000):  # the second takes several passes
            assert digests(ta.align_documents(tokens, counts, table_bytes=limit)) == want
        assert len(ta.passes(counts, 2000)) > 1


def test_no_rows(spark):
    tokens = ta.encode_documents(spark.createDataFrame([], "doc_id long, text string"))
    assert ta.align_documents(tokens, ta.pair_counts(tokens)).count() == 0
    empty = ta.encode_documents(spark.createDataFrame([(1, None)], "doc_id long, text string"))
    assert digests(ta.align_documents(empty, ta.pair_counts(empty))) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_hash_is_minimal_and_verified():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 2**63, 30_000, dtype=np.uint64))
    rows = []
    for s in range(ta.SLICES):
        mine = keys[ta.slice_of(keys) == s]
        sizes, words = ta.minimal_hash(mine)
        row = {"slice": s, "sizes": sizes, "words": words.tobytes()}
        place = ta.PairTable([row], {}).place(mine)
        assert sorted(place.tolist()) == list(range(len(mine)))  # every number once
        by_number = np.empty_like(mine)
        by_number[place] = mine
        rows.append(row | {"keys": by_number.tobytes()})
    table = ta.PairTable(rows, {"keys": "<u8"})
    assert (table.of["keys"][table.find(keys)] == keys).all()
    strange = np.setdiff1d(rng.integers(0, 2**63, 10_000, dtype=np.uint64), keys)
    assert (table.find(strange) == -1).all()


def test_counts_of_many_tasks_are_summed_in_a_tree(spark):
    rows = [(i, f"the house number {i % 7}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(60)  # several levels
    tokens = ta.encode_documents(docs)
    assert digests(ta.align_documents(tokens, ta.pair_counts(tokens))) == brute_force(rows)
