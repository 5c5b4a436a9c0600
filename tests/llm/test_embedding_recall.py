"""Pairs of embeddings near the threshold are found with long codes too, as large tables have them."""

import numpy as np
import pytest

from clusterlens.llm import embedding_dedup


def test_long_codes_miss_no_more(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n, d, cosine = 1000, 64, 0.9501
    a = rng.standard_normal((n, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.standard_normal((n, d))
    side -= (side * a).sum(axis=1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    b = cosine * a + np.sqrt(1 - cosine**2) * side
    rows = [(2 * i + k, v.tolist()) for i in range(n) for k, v in enumerate((a[i], b[i]))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(embedding_dedup, "MORE_BITS", 18)  # 29 bits, as 30 million vectors have
    linked = embedding_dedup.near_vectors(table).filter("n_links = 1").count()
    assert linked >= 2 * n * 0.996


@pytest.mark.parametrize("threshold", [0.95, 0.99, 0.8, 0.3, -1.0])
def test_miss_is_bounded_at_every_size(threshold):
    agree = 1 - np.arccos(threshold) / np.pi
    for n in (1, 100, 65_000, 10**6, 5 * 10**6, 10**8, 10**10):
        bits, bands = embedding_dedup.banding(n, threshold)
        assert (1 - agree**bits) ** bands <= embedding_dedup.MISS
