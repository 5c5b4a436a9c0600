"""Suffix arrays of shards against comparing every window with every window."""

import random
import re

import numpy as np
import pyarrow as pa

from clusterlens.llm import decontamination as dc
from clusterlens.llm.common import Words, text_slices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_every_window_is_found_in_its_document():
    random.seed(1)
    letters = "a b C d e é".split()
    for _ in range(150):
        lengths = random.choices([0, 1, 2, 3, 5, 7, 9, 10, 11, 14], k=random.randint(0, 6))
        items = [(i, " ".join(random.choices(letters, k=n))) for i, n in enumerate(lengths)]
        docs = [" ".join(random.choices(letters[: random.randint(1, 6)], k=random.randint(0, 60))) for _ in range(5)]
        window = random.choice([10, 4, 3, 8])
        probe, done = dc.Probe(items, window), 0
        for raw, offs in text_slices(pa.array(docs), 200):
            count, found = probe.search(raw, offs)
            got, want = set(), set()
            for doc, item, item_at, at, n in zip(*found, strict=True):
                size = min(len(words(items[item][1])), window)
                got |= {(doc, item, item_at + k, at + k) for k in range(n - size + 1)}
            for doc in range(len(offs) - 1):
                w = words(docs[done + doc])
                assert count[doc] == len(w)
                for item, (_, text) in enumerate(items):
                    x = words(text)
                    size = min(len(x), window)
                    spots = [(i, j) for i in range(len(x) - size + 1) for j in range(len(w) - size + 1)]
                    want |= {(doc, item, i, j) for i, j in spots if size and x[i : i + size] == w[j : j + size]}
            assert got == want
            done += len(offs) - 1


def test_array_holds_every_suffix_in_order():
    text = "b a b a n a n a b a".encode()
    shard = Words(np.frombuffer(text, np.uint8), np.array([0, 7, len(text)]), dc.IS_WORD)
    probe = dc.Probe([(1, "a n a n"), (2, "z z z z")], 4)
    array = dc.SuffixArray(shard, probe)
    hit, test = array.places(4, probe.sizes[4])
    assert hit.tolist() == [] and test.tolist() == []  # the first document ends inside
    whole = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), dc.IS_WORD)
    array = dc.SuffixArray(whole, probe)
    assert array.places(4, probe.sizes[4])[0].tolist() == [3]
    rank, _ = array.levels[4]
    order = np.argsort(rank[:7])
    names = {"a": whole.hash[1], "b": whole.hash[0], "n": whole.hash[4]}
    suffixes = [tuple(names[w] for w in "b a b a n a n a b a".split()[i : i + 4]) for i in order]
    assert suffixes == sorted(suffixes) and (rank[7:] == -1).all()  # every suffix of four words, sorted
    assert 16 not in array.levels


def test_blocks_hold_no_more_bytes_than_they_say(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(50))) for i in range(40)], "item_id long, text string")
    for probe in dc.probes(items, 10, 400):
        arrays = [probe.hash, probe.second, probe.item, probe.at, probe.left, *probe.sizes.values()]
        held = sum(a.nbytes for a in arrays)
        assert held <= dc.WORD_BYTES * max(1, len(probe.hash)) and len(probe.hash) <= 400 + 50
