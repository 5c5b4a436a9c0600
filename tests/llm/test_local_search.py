"""The local search of packing saves sequences where best-fit decreasing leaves bins underfull."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
from clusterlens.llm import packing


def bins(patterns):
    return sum(patterns.values())


def test_search_finds_what_best_fit_misses():
    counts = {820: 2, 614: 4}  # 820 + 614 + 614 fill a sequence
    assert bins(packing.best_fit(counts, 2048)) == 3
    assert bins(packing.pack(counts, 2048)) == 2
    many = {k: 50 * n for k, n in counts.items()}
    assert bins(packing.best_fit(many, 2048)) == 117 and bins(packing.pack(many, 2048)) == 100


def test_search_only_helps():
    random.seed(8)
    saved = 0
    for _ in range(60):
        sizes = [random.randint(300, 1100) for _ in range(random.randint(3, 8))]
        counts = {k: random.randint(1, 6) for k in sizes}
        start, end = packing.best_fit(counts, 2048), packing.pack(counts, 2048)
        total = sum(k * n for k, n in counts.items())
        assert -(-total // 2048) <= bins(end) <= bins(start)
        used = {}
        for pattern, n in end.items():
            assert sum(k * c for k, c in pattern) <= 2048
            for k, c in pattern:
                used[k] = used.get(k, 0) + c * n
        assert used == counts  # nothing is lost
        saved += bins(start) - bins(end)
    assert saved > 0


def test_query_packs_better_than_best_fit(spark, tmp_path):
    word = " the"
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(encoder.encode(word * 819, add_special_tokens=False).ids) == 819
    rows = [(i, word * n) for i, n in enumerate([819, 613, 613] * 6)]  # and an end token each
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = entry.queries()["op10_packing"](spark, str(tmp_path)).collect()
    assert len(out) == 18 and len({r["sequence_id"] for r in out}) == 6
    assert bins(packing.best_fit({820: 6, 614: 12}, 2048)) == 7
