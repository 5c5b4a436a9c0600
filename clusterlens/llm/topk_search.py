"""Exact top-k search by inner product: tiled matrix products and a tree of top lists.

Components x become the integers floor(256 * x). Every task packs the vectors it reads into tiles of
at most ``TILE`` vectors, sorted by id, in the narrowest type that holds them; queries are packed
alike from the same pass. Tiles are a stored table. Candidate tiles are dealt to groups of about
``GROUP_BYTES``, query tiles go to every group, and each pair of tiles is one product of matrices.
From a tile's scores the k greatest of each query are selected and merged into the list that the task
holds for the query tile; the lists of the groups meet in a tree. So a task's memory is some tiles
whatever the number of vectors, and vectors of any number of copies are spread as others are.

Scores are exact: a product is made in 32-bit floats where the lengths of its vectors keep every
partial sum below 2^24, in doubles below 2^53, and in 64-bit integers otherwise.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do
those whose integers have a squared length of 2^60 or more, as scores are longs. An inner product
exists between vectors of equal length only; an empty one has the score 0 with other empty ones. Rows
without an id take no part. A query's own row is every row of its id. Rows that repeat a query are
queries of their own, and rows that repeat a candidate are candidates of their own. Equal scores go to
the smaller id. A query without candidates has no rows. Only the named columns are read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm.common import read, staged
from clusterlens.llm.tree import tree_merge

SCALE = 256
EVERY = 50
K = 5
#: Vectors of a tile, and queries of a slab of its product.
TILE, SLAB = 4096, 512
GROUP_BYTES = 128 << 20
#: Query tiles whose lists a task holds before it passes them on.
HELD = 32
#: Squared lengths from here on do not take part.
TOO_LONG = 2.0**60

TILES = "query boolean, tile long, d int, n int, longest double, width int, ids binary, data binary"
LISTS = "tile long, d int, node long, queries binary, ids binary, scores binary"
NONE = np.iinfo(np.int64).min


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x), as doubles."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * x)


def narrow(v: np.ndarray) -> np.ndarray:
    """Integers in doubles as the narrowest of the stored types; the type follows from its width."""
    top = np.abs(v).max(initial=0)
    return v.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64)


def wide(data: bytes, width: int, d: int, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").reshape(n, d)


def rows_of(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length in a list array without nulls."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, flat[(starts[at][:, None] + np.arange(d)).ravel()].reshape(len(at), d)


def usable(vector) -> F.Column:
    """Neither null nor with a null or non-finite component."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def _tile(query: bool, ids: np.ndarray, v: np.ndarray) -> dict:
    order = np.argsort(ids, kind="stable")
    data = narrow(v[order])
    return {
        "query": query,
        "tile": int.from_bytes(os.urandom(8), "little") >> 1,
        "d": v.shape[1],
        "n": len(ids),
        "longest": float((v * v).sum(axis=1).max(initial=0)),
        "width": data.dtype.itemsize,
        "ids": ids[order].astype("<i8").tobytes(),
        "data": data.astype(data.dtype.newbyteorder("<")).tobytes(),
    }


TILE_SCHEMA = pa.schema(
    [("query", pa.bool_()), ("tile", pa.int64()), ("d", pa.int32()), ("n", pa.int32()), ("longest", pa.float64()),
     ("width", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())]
)


def _pack(every: int):
    """Tiles of the vectors and of the queries among them, as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bool, int], list] = {}

        def add(query: bool, ids: np.ndarray, v: np.ndarray) -> Iterator[dict]:
            key = (query, v.shape[1])
            parts = [*held.pop(key, []), (ids, v)]
            ids, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            while len(ids) >= TILE:
                yield _tile(query, ids[:TILE], v[:TILE])
                ids, v = ids[TILE:], v[TILE:]
            if len(ids):
                held[key] = [(ids, v)]

        for batch in batches:
            names = batch.column("id").to_numpy(zero_copy_only=False)
            for at, x in rows_of(batch.column("vector")):
                v = whole_numbers(x.astype(np.float64))
                with np.errstate(over="ignore", invalid="ignore"):
                    fits = (v * v).sum(axis=1) < TOO_LONG
                at, v = at[fits], v[fits]
                asked = names[at] % every == 0
                out = [*add(False, names[at], v), *add(True, names[at][asked], v[asked])]
                if out:
                    yield pa.RecordBatch.from_pylist(out, TILE_SCHEMA)
        for (query, _), parts in held.items():
            for ids, v in parts:
                yield pa.RecordBatch.from_pylist([_tile(query, ids, v)], TILE_SCHEMA)

    return run


def select(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the k greatest scores of each row, equal ones from the left; the scores change."""
    n, m = scores.shape
    low = -np.inf if scores.dtype.kind == "f" else NONE
    at = np.zeros((n, min(k, m)), np.int64)
    top = np.empty((n, min(k, m)), scores.dtype)
    rows = np.arange(n)
    for i in range(min(k, m)):
        at[:, i] = scores.argmax(axis=1)
        top[:, i] = scores[rows, at[:, i]]
        scores[rows, at[:, i]] = low
    return at, top


def merge_lists(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple:
    """The k best of two lists (scores, ids) of each query; NONE stands for nothing."""
    scores, ids = np.concatenate([a[0], b[0]], axis=1), np.concatenate([a[1], b[1]], axis=1)
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]  # ~s falls as s rises and never overflows
    return np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)


def tile_lists(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, bound: float, k: int):
    """Scores and ids of the k best candidates of a tile for each query; ids are sorted."""
    kind = np.float32 if bound < 2.0**24 else np.float64 if bound < 2.0**53 else np.int64
    turned = c.astype(kind).T
    left, right = np.searchsorted(c_ids, q_ids, "left"), np.searchsorted(c_ids, q_ids, "right")
    out_s = np.full((len(q), k), NONE, np.int64)
    out_i = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    low = NONE if kind is np.int64 else -np.inf
    for at in range(0, len(q), SLAB):
        scores = q[at : at + SLAB].astype(kind) @ turned
        for row in np.flatnonzero(right[at : at + SLAB] > left[at : at + SLAB]):
            scores[row, left[at + row] : right[at + row]] = low
        col, top = select(scores, k)
        there = top != low
        n = col.shape[1]
        out_s[at : at + SLAB, :n][there] = top[there].astype(np.int64)
        out_i[at : at + SLAB, :n][there] = c_ids[col][there]
    return out_s, out_i


def _multiply(k: int):
    """Lists of query tiles; each row is a query tile beside a candidate tile."""

    def row(key: tuple, queries: bytes, lists: tuple) -> dict:
        scores, ids = (x.astype("<i8").tobytes() for x in lists)
        # the group is the node, so a task that runs again sends its lists the same way
        return {"tile": key[0], "d": key[1], "node": key[2], "queries": queries, "ids": ids, "scores": scores}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                q = wide(r["q_data"], r["q_width"], r["d"], r["q_n"])
                c = wide(r["data"], r["width"], r["d"], r["n"])
                q_ids, c_ids = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                bound = np.sqrt(r["q_longest"]) * np.sqrt(r["longest"]) * 1.001 + 1
                got = tile_lists(q, q_ids, c, c_ids, bound, k)
                key = (r["q_tile"], r["d"], r["group"])
                if key in held:
                    held[key] = (r["q_ids"], merge_lists(held[key][1], got, k))
                    continue
                held[key] = (r["q_ids"], got)
                if len(held) > HELD:
                    yield pa.RecordBatch.from_pylist([row(x, *y) for x, y in held.items()], LIST_SCHEMA)
                    held = {}
        if held:
            yield pa.RecordBatch.from_pylist([row(x, *y) for x, y in held.items()], LIST_SCHEMA)

    return run


LIST_SCHEMA = pa.schema(
    [("tile", pa.int64()), ("d", pa.int32()), ("node", pa.int64()), ("queries", pa.binary()),
     ("ids", pa.binary()), ("scores", pa.binary())]
)


def _merge(k: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()

        def lists(r: dict) -> tuple[np.ndarray, np.ndarray]:
            return tuple(np.frombuffer(r[c], "<i8").reshape(-1, k) for c in ("scores", "ids"))

        best = lists(rows[0])
        for r in rows[1:]:
            best = merge_lists(best, lists(r), k)
        out = rows[0] | {"scores": best[0].tobytes(), "ids": best[1].tobytes()}
        return pa.Table.from_pylist([out], LIST_SCHEMA)

    return run


def _unpack(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                scores = np.frombuffer(r["scores"], "<i8")
                there = scores != NONE
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": np.repeat(np.frombuffer(r["queries"], "<i8"), k)[there],
                        "rank": np.tile(np.arange(1, k + 1, dtype=np.int32), len(scores) // k)[there],
                        "vec_id": np.frombuffer(r["ids"], "<i8")[there],
                        "score": scores[there],
                    }
                )

    return run


def pack_tiles(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = EVERY) -> DataFrame:
    """Stored tiles of all usable vectors, and once more of those whose id is divisible by ``every``."""
    value = F.col(embedding).cast("array<double>")
    rows = table.filter(F.col(vec_id).isNotNull() & usable(value))
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), value.alias("vector"))
    return staged(rows.mapInArrow(_pack(every), TILES), "tiles")


def search(tiles: DataFrame, k: int = K, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of each query tile's vectors."""
    parallel = tiles.sparkSession.sparkContext.defaultParallelism
    shards, queries = tiles.filter("not query"), tiles.filter("query").drop("query")
    n, size = shards.agg(F.count("*"), F.sum(F.octet_length("data"))).first()
    groups = max(min(n, parallel), -(-(size or 0) // group_bytes), 1)
    group = F.pmod(F.col("tile"), F.lit(groups)).cast("long")
    dealt = shards.withColumn("group", group).drop("query", "tile")
    asked = queries.select("d", *[F.col(c).alias(f"q_{c}") for c in queries.columns if c != "d"])
    asked = asked.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    lists = asked.join(dealt, ["d", "group"]).mapInArrow(_multiply(k), LISTS)
    return tree_merge(lists, ["tile"], _merge(k), groups).mapInArrow(
        _unpack(k), "query_id long, rank int, vec_id long, score long"
    )


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best candidates of every vector whose id is divisible by 50."""
    return search(pack_tiles(read(spark, sf_dir, "embeddings")))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % {EVERY} = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}"""
