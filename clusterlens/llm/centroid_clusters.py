"""Exact centroid clustering over zone maps along a Hilbert curve.

Components x become the integers floor(256 * x). Each vector gets its place on a Hilbert curve through
a grid of ``2 ** BITS`` cells per dimension between the least and greatest components. Vectors are
range-partitioned and sorted by that place and packed into blocks of at most ``BLOCK`` vectors, each with the
least and greatest component of every dimension: its box. The blocks are a stored table.

A round reads the blocks once. For each block, distances between box and centroids say which centroids can be
nearest to any vector in it: a centroid farther from the whole box than another is at most, or farther
than the one nearest to the box's middle at every point of the box, is none. Only the others, the block's
candidates, are compared with its vectors, all at once and exactly: in 32-bit floats where all sums stay below 2^24,
in doubles below 2^53, else in 64-bit integers. A task passes on one sum per centroid, so no cluster is
gathered anywhere; the driver holds the centroids alone.

Defined results: vectors that are null, of another length, or hold null or non-finite components are no rows
of the result, nor are those whose integers have a squared length of 2^60 or more, as distances are longs. A
vector without an id is clustered, but no starting centroid. Repeated rows are vectors of their own; equal
hashes start in the order of their components. With fewer vectors than centroids, all that have an id start. Of equal
distances the smaller number wins. An empty cluster keeps its centroid. Sums of distances beyond a long become
the greatest long. Without a starting centroid there are no rows. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm.common import read, staged
from clusterlens.llm.topk_search import SCALE, TOO_LONG, narrow, usable, whole_numbers, wide

D, K, ROUNDS = 64, 40, 5
#: Starting centroids follow from the hash of this and the id.
SEED = "2:"
#: Bits of the grid per dimension, and vectors of a block.
BITS, BLOCK = 4, 256
LONGEST = 2**63 - 1


def hilbert_places(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (n, d), as rows of bytes that compare like the places.

    The usual two steps in every dimension at once: reflect and exchange what the greater halves
    turned, from the coarsest bit to the finest, then read the Gray code of the dimensions.
    """
    axes = np.ascontiguousarray(cells.T).astype(np.int64)
    d = len(axes)
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for axis in axes:
            upper = (axis >> bit) & 1 == 1
            swap = np.where(upper, 0, (axes[0] ^ axis) & below)
            axes[0] ^= np.where(upper, below, swap)
            axis ^= swap
    for i in range(1, d):
        axes[i] ^= axes[i - 1]
    turn = np.zeros(axes.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    axes ^= turn
    shifts = np.arange(bits - 1, -1, -1)[:, None, None]
    flags = ((axes >> shifts) & 1).astype(np.uint8).reshape(bits * d, -1)
    return np.packbits(flags.T, axis=1)


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return whole_numbers(flat.astype(np.float64).reshape(-1, d))


def _fits(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return (v * v).sum(axis=1) < TOO_LONG


def _extent(d: int):
    """Least and greatest component of each dimension that a task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(d, np.inf), np.full(d, -np.inf)
        for batch in batches:
            v = _matrix(batch, d)
            v = v[_fits(v)]
            low, high = np.minimum(low, v.min(axis=0, initial=np.inf)), np.maximum(high, v.max(axis=0, initial=-np.inf))
        if (low <= high).all():
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(d), pa.int32()), "low": low, "high": high})

    return run


def _place(low: np.ndarray, high: np.ndarray, bits: int):
    step = np.maximum(high - low, 1) / (1 << bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch, len(low))
            ok = np.flatnonzero(_fits(v))
            if not len(ok):
                continue
            v = v[ok]
            cells = np.clip(((v - low) / step).astype(np.int64), 0, (1 << bits) - 1)
            places, data = hilbert_places(cells, bits), narrow(v)
            n = len(ok)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p.tobytes() for p in places], pa.binary()),
                    pa.array(np.frombuffer(os.urandom(4 * n), np.int32)),
                    batch.column("id").take(pa.array(ok)),
                    pa.array([data.dtype.itemsize] * n, pa.int32()),
                    pa.array([x.tobytes() for x in data], pa.binary()),
                ],
                names=["place", "salt", "id", "width", "data"],
            )

    return run


BLOCKS = "n int, longest double, low array<long>, high array<long>, ids array<long>, width int, data binary"


def _block(ids: list, v: np.ndarray) -> pa.RecordBatch:
    data = narrow(v.astype(np.float64)) if v.dtype != np.int16 else v
    x = v.astype(np.float64)
    longs = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([len(v)], pa.int32()),
            pa.array([float((x * x).sum(axis=1).max())]),
            pa.array([v.min(axis=0).astype(np.int64)], longs),
            pa.array([v.max(axis=0).astype(np.int64)], longs),
            pa.array([ids], longs),
            pa.array([data.dtype.itemsize], pa.int32()),
            pa.array([data.tobytes()], pa.binary()),
        ],
        names=["n", "longest", "low", "high", "ids", "width", "data"],
    )


def _pack(d: int, size: int):
    """Blocks of neighbours, in the order in which they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        rows: list = []
        for batch in batches:
            ids += batch.column("id").to_pylist()
            widths, data = batch.column("width").to_pylist(), batch.column("data").to_pylist()
            rows += [np.frombuffer(x, f"<i{w}") for x, w in zip(data, widths, strict=True)]
            while len(rows) >= size:
                yield _block(ids[:size], np.stack(rows[:size]))
                ids, rows = ids[size:], rows[size:]
        if rows:
            yield _block(ids, np.stack(rows))

    return run


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a point of the box, ties included."""
    low, high, c = low.astype(np.float64), high.astype(np.float64), centroids.astype(np.float64)
    nearest = (np.maximum(0, np.maximum(low - c, c - high)) ** 2).sum(axis=1)
    farthest = (np.maximum(np.abs(low - c), np.abs(high - c)) ** 2).sum(axis=1)
    slack = 1e-9 * (farthest.max() + 1)  # far above the rounding of these sums
    near = nearest <= farthest.min() + slack
    # how much nearer than the best centroid of the middle can another one be at most, over the box?
    best = c[((c - (low + high) / 2) ** 2).sum(axis=1).argmin()]
    slope = 2 * (c - best)
    gain = np.maximum(low * slope, high * slope).sum(axis=1) + (best * best).sum() - (c * c).sum(axis=1)
    return np.flatnonzero(near & (gain >= -slack))


def nearest(v: np.ndarray, longest: float, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the nearest centroid of each vector, the first of equals, and the squared distance."""
    norms = (c.astype(np.float64) ** 2).sum(axis=1)
    bound = (np.sqrt(longest) + np.sqrt(norms.max())) ** 2 * 1.001 + 1
    kind = np.float32 if bound < 2.0**24 else np.float64 if bound < 2.0**53 else np.int64
    v, c = v.astype(kind), c.astype(kind)
    far = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(v)), at].astype(np.int64)


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, d: int) -> Iterator[tuple]:
    """Ids, vectors, clusters and distances, block after block."""
    for batch in batches:
        for at in range(batch.num_rows):
            r = batch.slice(at, 1)
            low, high = (r.column(c).flatten().to_numpy() for c in ("low", "high"))
            some = candidates(low, high, centroids)
            v = wide(r.column("data")[0].as_py(), r.column("width")[0].as_py(), d, r.column("n")[0].as_py())
            place, far = nearest(v, r.column("longest")[0].as_py(), centroids[some])
            yield r.column("ids").flatten(), v, some[place], far


def _sums(centroids: np.ndarray, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        total, count = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for _, v, cluster, _ in _assign(batches, centroids, d):
            np.add.at(total, cluster, v.astype(np.int64))
            count += np.bincount(cluster, minlength=k)
        on = np.flatnonzero(count)
        if len(on):
            yield pa.RecordBatch.from_pydict(
                {"cluster": on.astype(np.int32), "n": count[on], "sums": list(total[on])}
            )

    return run


def _labels(centroids: np.ndarray, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, far in _assign(batches, centroids, d):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cluster.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"]
            )

    return run


def zone_map(rows: DataFrame, d: int = D, bits: int = BITS, size: int = BLOCK) -> DataFrame:
    """Stored blocks along the curve, out of rows (id, vector) of d finite components."""
    seen = rows.mapInArrow(_extent(d), "dim int, low double, high double")
    extent = seen.groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect()
    low, high = (np.array([r[c] for r in extent] or [0.0] * d) for c in ("low", "high"))
    placed = staged(
        rows.mapInArrow(_place(low, high, bits), "place binary, salt int, id long, width int, data binary"), "places"
    )
    # the salt spreads equal vectors over neighbouring tasks
    ordered = placed.repartitionByRange("place", "salt").sortWithinPartitions("place", "salt")
    return staged(ordered.mapInArrow(_pack(d, size), BLOCKS), "blocks")


def starting_centroids(rows: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """Integers of the k vectors whose ids have the smallest hashes."""
    whole = F.transform("vector", lambda x: F.floor(x * SCALE).cast("double"))
    # a component of 2^30 is too long by itself, and might be no long
    small = F.forall("vector", lambda x: F.abs(x * SCALE) < 2.0**31)
    named = rows.filter(F.col("id").isNotNull() & small).select(
        F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).alias("h"), whole.alias("v")
    )
    short = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) < TOO_LONG
    first = named.filter(short).orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.float64).astype(np.int64)


def refine(blocks: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after so many rounds of assignment and exact floor of the mean."""
    k, d = centroids.shape
    for _ in range(rounds):
        sums = blocks.mapInArrow(_sums(centroids, d), "cluster int, n long, sums array<long>")
        flat = sums.select("cluster", "n", F.posexplode("sums").alias("dim", "s"))
        whole = F.sum(F.col("s").cast("decimal(38,0)"))
        means = flat.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), whole.alias("s"))
        centroids = centroids.copy()
        for r in means.collect():  # at most k * d rows
            centroids[r["cluster"], r["dim"]] = int(r["s"]) // r["n"]
    return centroids


RESULT = """vec_id long, cluster int, distance long, cluster_inertia long, inertia long,
    centroid_sha256 string"""


def cluster_vectors(
    table: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    k: int = K,
    rounds: int = ROUNDS,
    d: int = D,
    seed: str = SEED,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector."""
    spark = table.sparkSession
    value = F.col(embedding).cast("array<double>")
    rows = table.filter(usable(value) & (F.size(value) == d))
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), value.alias("vector"))
    start = starting_centroids(rows, k, seed)
    if not len(start):
        return spark.createDataFrame([], RESULT)
    blocks = zone_map(rows, d)
    centroids = refine(blocks, start, rounds)
    labels = staged(blocks.mapInArrow(_labels(centroids, d), "vec_id long, cluster int, distance long"), "labels")
    sums = labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    inertia = {r["cluster"]: int(r["s"]) for r in sums.collect()}  # at most k rows
    whole = sum(inertia.values())
    facts = [
        (i, min(inertia[i], LONGEST), min(whole, LONGEST), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for i, c in enumerate(centroids.tolist())
        if i in inertia
    ]
    names = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    # one row per centroid, so at most k
    return labels.join(F.broadcast(spark.createDataFrame(facts, names)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every vector of 64 components after 5 rounds from 40 centroids."""
    return cluster_vectors(read(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    def assign(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(e) AS e, min({{'d': far, 'c': c}}) AS best FROM (
    SELECT v.*, c, (list_inner_product(e, e) - 2 * list_inner_product(e, m) + list_inner_product(m, m))::BIGINT AS far
    FROM v CROSS JOIN c{r}) GROUP BY rid)"""

    def move(r: int) -> str:
        return f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.c, coalesce(new.m, c{r}.m) AS m FROM c{r} LEFT JOIN (
    SELECT c, list(floor(s / n) ORDER BY i) AS m FROM (
      SELECT best.c AS c, i, sum(e[i]) AS s, count(*) AS n
      FROM a{r}, (SELECT unnest(range(1, {D + 1})) AS i) GROUP BY ALL) GROUP BY c) new ON new.c = c{r}.c)"""

    steps = [f"{assign(r)},\n{move(r)}" for r in range(ROUNDS)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
  FROM embeddings WHERE len(embedding) = {D}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}' || vec_id)) - 1 AS c, e AS m
  FROM v WHERE vec_id IS NOT NULL QUALIFY c < {K}),
{", ".join(steps)},
{assign(ROUNDS)},
done AS (SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance FROM a{ROUNDS}),
names AS (
  SELECT c, sha256(list_aggregate(list_transform(m, lambda x: x::BIGINT::VARCHAR), 'string_agg', ',')) AS h FROM c{ROUNDS})
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, h AS centroid_sha256
FROM done JOIN names ON c = cluster"""


ORACLE = _oracle()
