"""Top-k search and centroid clustering against brute force over plain integers."""

import hashlib
import math

import numpy as np
import pytest

from clusterlens.llm import centroid_clusters, topk_search

SCHEMA = "vec_id long, embedding array<double>, label int, tile long, d int, cluster string, place binary"


def whole(v):
    return [math.floor(256 * x) for x in v]


def valid(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and sum(x * x for x in whole(v)) < 2**60


def brute_search(rows, k, every):
    rows = [(i, whole(v)) for i, v in rows if i is not None and valid(v)]
    out = []
    for q, x in rows:
        if q % every == 0:
            met = [(-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in rows if i != q and len(y) == len(x)]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(met)[:k], 1)]
    return sorted(out)


def brute_clusters(rows, k, rounds, d):
    rows = [(i, whole(v)) for i, v in rows if valid(v) and len(v) == d]
    start = sorted((hashlib.sha256(b"2:%d" % i).hexdigest(), v) for i, v in rows if i is not None)
    centroids = [list(v) for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in rows]
        for j in range(len(centroids)):
            mine = [v for (_, v), a in zip(rows, at, strict=True) if a == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *nearest(v)) for i, v in rows] if centroids else []
    inertia = {j: sum(far for _, far, c in found if c == j) for _, _, j in found}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    out = [(i, j, far, inertia[j], sum(inertia.values()), names[j]) for i, far, j in found]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def odd():
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(64) / 8).tolist()) for i in range(130)]
    same = rows[3][1]
    rows += [(i, same) for i in range(200, 260)]  # copies: ties everywhere
    rows += [(200, same), (200, [0.0] * 64), (7, rows[7][1])]  # repeated ids
    rows += [(None, same), (300, None), (301, []), (350, []), (302, [math.nan] * 64), (303, [math.inf] + [0.0] * 63)]
    rows += [(304, [None] + [0.5] * 63), (305, [-0.0] * 64), (306, [0.001] * 63), (350, [1.0, -1.0]), (307, [2.5, 1.0])]
    rows += [(400 + i, (x * np.array([1.0, 1e5])[i % 2]).tolist()) for i, x in enumerate(rng.standard_normal((20, 64)))]
    rows += [(500, [1e300] * 64), (501, [1e8] * 64)]
    return rows


def table(spark, rows):
    more = (None, 1, 2, "c", b"p")
    return spark.createDataFrame([(i, v, *more) for i, v in rows], SCHEMA).repartition(3)


def test_search_equals_brute_force(spark, odd, monkeypatch):
    want = brute_search(odd, 5, 50)
    assert len({r[0] for r in want}) > 5
    for tile, size in ((4096, 1 << 27), (16, 4096)):  # one group, and many tiles, groups and levels
        monkeypatch.setattr(topk_search, "TILE", tile)
        tiles = topk_search.pack_tiles(table(spark, odd))
        got = topk_search.search(tiles, group_bytes=size)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(tuple(r) for r in got.collect()) == want


def test_search_without_candidates(spark):
    def found(rows):
        return topk_search.search(topk_search.pack_tiles(table(spark, rows))).collect()

    assert found([]) == [] and found([(50, [1.0])]) == [] and found([(1, [1.0]), (2, [1.0])]) == []
    assert [tuple(r) for r in found([(0, [1.0]), (1, [-1.0])])] == [(0, 1, 1, -65536)]


def test_scores_are_exact_in_every_width():
    rng = np.random.default_rng(1)
    for top in (100, 2**20, 2**29):
        q, c = (rng.integers(-top, top, (9, 3)) for _ in range(2))
        ids = np.arange(9)
        bound = 3.0 * top * top
        scores, found = topk_search.tile_lists(q, ids + 100, c, ids, bound, 9)
        for row in range(9):
            want = sorted((-int(sum(int(a) * int(b) for a, b in zip(q[row], c[j], strict=True))), j) for j in range(9))
            assert [(-int(s), int(j)) for s, j in zip(scores[row], found[row], strict=True)] == want


def test_clusters_equal_brute_force(spark, odd):
    for k, size in ((40, 256), (7, 8)):
        got = centroid_clusters.cluster_vectors(table(spark, odd), k=k)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_clusters(odd, k, 5, 64)


def test_few_vectors(spark):
    assert centroid_clusters.cluster_vectors(table(spark, [])).count() == 0
    assert centroid_clusters.cluster_vectors(table(spark, [(None, [1.0] * 64)])).count() == 0
    one = centroid_clusters.cluster_vectors(table(spark, [(9, [1.0] * 64), (None, [1.5] * 64)])).collect()
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in one) == [("9", 0, 64 * 64**2), ("None", 0, 64 * 64**2)]


def test_hilbert_curve_visits_neighbours():
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), axis=-1).reshape(-1, d)
        places = centroid_clusters.hilbert_places(cells, bits)
        order = np.lexsort(places.T[::-1])
        assert len({p.tobytes() for p in places}) == len(cells)
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_boxes_leave_out_only_centroids_that_cannot_win():
    rng = np.random.default_rng(2)
    left = 0
    for _ in range(300):
        d = int(rng.integers(1, 6))
        c = rng.integers(-50, 50, (12, d))
        v = rng.integers(-50, 50, (1, d)) + rng.integers(-6, 7, (30, d))
        some = centroid_clusters.candidates(v.min(axis=0), v.max(axis=0), c)
        far = ((v[:, None, :] - c) ** 2).sum(axis=2)
        at, distance = centroid_clusters.nearest(v, float((v * v).sum(axis=1).max()), c[some])
        assert (some[at] == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
        left += len(some)
    assert left < 300 * 6  # most of the 12 are ruled out by their boxes


def test_clustered_vectors_need_few_comparisons(spark):
    """On vectors that lie in clusters, neighbours along the curve share a small box."""
    rng = np.random.default_rng(3)
    middle = rng.integers(-1000, 1000, (8, 4)) / 256
    rows = [(i, (middle[i % 8] + rng.standard_normal(4) / 64).tolist()) for i in range(2000)]
    vectors = table(spark, rows).selectExpr("vec_id AS id", "embedding AS vector")
    blocks = centroid_clusters.zone_map(vectors, d=4, size=50).collect()
    c = np.floor(256 * middle).astype(np.int64)
    some = [len(centroid_clusters.candidates(np.array(b["low"]), np.array(b["high"]), c)) for b in blocks]
    assert sum(b["n"] for b in blocks) == 2000 and np.median(some) == 1
