"""Binary codes of embeddings: estimates, bounds, and how few pairs are computed exactly."""

import numpy as np
import pyarrow as pa

from clusterlens.llm import embedding_dedup as ed


def pairs_at(cosine, n, d, seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((n, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.standard_normal((n, d))
    side -= (side * a).sum(axis=1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    return a, cosine * a + np.sqrt(1 - cosine**2) * side


def coded(x):
    rows = pa.array(x.tolist(), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(x)), pa.int64()), pa.array([1] * len(x), pa.int64()), rows], names=["id", "copies", "vector"]
    )
    out = pa.Table.from_batches(ed._encode(x.shape[1])([batch]))
    part = out.to_pydict()
    bits = np.frombuffer(b"".join(part["bits"]), np.uint8).reshape(len(x), -1)
    q = np.frombuffer(b"".join(part["rounded"]), np.int8).reshape(len(x), -1)
    return bits, np.array(part["factor"]), q, np.array(part["step"])


def test_a_vector_is_kept_in_few_bytes():
    bits, factor, q, step = coded(np.random.default_rng(0).standard_normal((5, 64)))
    assert bits.shape == (5, 8) and q.shape == (5, 64)
    assert ((q >= 0) == np.unpackbits(bits, axis=1).astype(bool)).all()


def test_no_link_is_ruled_out():
    for cosine in (0.95, 0.96, 0.999, 1.0):
        for d in (2, 5, 16, 64, 200):
            a, b = pairs_at(cosine, 300, d, 7)
            bits, factor, _, _ = coded(a)
            _, _, q, step = coded(b)
            maybe = ed.undecided(bits, factor, q, step, 0.95, 3.0)
            assert maybe.diagonal().all()


def test_estimates_are_unbiased():
    a, b = pairs_at(0.6, 4000, 64, 3)
    bits, factor, _, _ = coded(a)
    _, _, q, step = coded(b)
    sign = np.unpackbits(bits, axis=1).astype(float) * 2 - 1
    estimate = (sign * q * step[:, None]).sum(axis=1) / 8 / factor
    assert abs(estimate.mean() - 0.6) < 0.01
    spread = np.sqrt((1 - factor**2) / factor**2 / 63)
    assert (np.abs(estimate - 0.6) <= 3 * spread).mean() > 0.99


def test_few_vectors_are_fetched(spark, monkeypatch):
    """Of random vectors that meet by chance nearly all pairs are decided by their codes."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 64))
    a, b = pairs_at(0.97, 20, 64, 4)
    x = np.concatenate([x, a, b])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    stored = {}
    staged = ed.staged

    def keep(df, name):
        stored[name] = staged(df, name)
        return stored[name]

    monkeypatch.setattr(ed, "staged", keep)
    got = ed.near_vectors(table)
    assert sorted(r["vec_id"] for r in got.filter("n_links > 0").collect()) == list(range(3000, 3040))
    met = stored["band-codes"].groupBy("band", "code").count().filter("count > 1").agg({"count": "sum"}).first()[0]
    open_ = stored["undecided"].count()
    assert 40 <= open_ < met / 20
    assert "vector" not in stored["undecided"].columns and "vector" not in stored["codes"].columns


def test_codes_are_alike_in_every_task():
    x = np.random.default_rng(2).integers(-127, 128, (700, 64)).astype(np.int8)
    tool = ed.Bands(64, 20, 60)
    whole = tool.codes(x)
    assert (np.concatenate([ed.Bands(64, 20, 60).codes(x[i : i + 1]) for i in range(0, 700, 50)]) == whole[::50]).all()
    assert (whole[:333] == tool.codes(x[:333])).all()
