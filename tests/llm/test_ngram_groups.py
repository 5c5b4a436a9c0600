"""Loosely linked groups of near copies against brute force."""

import numpy as np

from clusterlens.llm import ngram_join


def _least(sets):
    """The least id that links reach, for every document."""
    least = {i: i for i in sets}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least, links


def test_loose_groups(spark):
    rng = np.random.default_rng(7)
    docs = {}
    for group, size in enumerate((90, 40, 3)):
        base = [f"g{group}w{i}" for i in range(120)]
        for k in range(size):
            words = list(base)
            for at in rng.choice(120, rng.integers(1, 4), replace=False):
                words[at] = f"x{rng.integers(4)}"
            docs[100 * group + k] = words
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in docs.items()}
    least, links = _least(sets)
    assert len(set(least.values())) > 3 and len(links) > 200
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    found = ngram_join.jaccard_components(rows).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == least
    assert {r["doc_id"]: r["n_shingles"] for r in found} == {i: len(s) for i, s in sets.items()}
