"""Near duplicates among embeddings, found through randomised binary codes.

A vector is normalised and rotated at random. Stored of it are one sign per dimension, packed, with the inner product
of code and vector as its correction factor, and its components rounded to 8 bits. Code times the rounded
components of another vector, divided by the factor, is an unbiased estimate of their inner product up to the
rounding, with a confidence bound of ``EPSILON * sqrt((1 - f^2) / f^2 / (d - 1))``. Pairs whose interval, widened by
the greatest error of the rounding, stays below the threshold are left alone, provided that the angles between vector,
code and the other vector rule a link out for certain too; so nothing is lost to chance. Only for pairs that are
undecided are the vectors themselves fetched, and their cosine computed exactly, in doubles.

Which pairs meet: signs of further random projections give codes, one per band, with log2 n and
``MORE_BITS`` bits each, so chance meetings of a band stay in proportion to n. Vectors meet if one code
agrees. The number of bands follows from the bits: there are as many as keep the probability that
a pair at the threshold agrees in none of them at ``MISS`` or less, whatever n is (at 0.95, 60 bands of 20 bits),
and ``BANDS`` at least; pairs above the threshold are missed less often. That is the recall. Where a low threshold
needs more than ``MOST_BANDS``, codes get shorter instead, down to no bit, where all pairs meet. The projections are
integers times the rounded components, so every task finds the same code for a vector without being sent it, and
a pair is looked at in the first band it agrees in, only there. Buckets are cut into blocks of at most ``BLOCK``
vectors, and each pair of blocks is one group; small buckets share a group. So a bucket with a third of all vectors
becomes many equal groups. No group emits pairs: the first pass names the vectors that have an undecided pair in a
group, the second counts links, and returns a spanning forest of them. Equal vectors are one
vector with a number from the start.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing and are kept, as are vectors of other lengths among themselves: only vectors of equal length
link. Rows without an id have no component, count as nobody's link, and are not kept. Repeated rows
are equal vectors. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm.common import read, staged
from clusterlens.llm.components import components

THRESHOLD = 0.95
EPSILON = 3.0
#: Members of a block; a group holds two blocks at most.
BLOCK = 2048
BANDS, MORE_BITS = 40, 4
#: Greatest probability that a pair at the threshold meets in no band, and what rounding may add to its angle.
MISS, ROUNDING = 0.001, 0.005
MOST_BANDS = 1024
SEED = 20


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _unit(rows: pa.Array, d: int) -> np.ndarray:
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of tiny and huge numbers stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def banding(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a code and number of bands for n vectors, so that at most ``MISS`` of pairs are missed."""
    agree = max(0.0, 1 - (math.acos(max(-1.0, min(1.0, threshold))) + ROUNDING) / math.pi)
    bits = min(53, max(1, math.ceil(math.log2(n + 1)) + MORE_BITS))
    for b in range(bits, 0, -1):
        met = agree**b
        bands = 1 if met >= 1 else math.ceil(math.log(MISS) / math.log1p(-met)) if met > 1e-9 else math.inf
        if bands <= MOST_BANDS:
            return b, max(BANDS, bands)
    return 0, 1


class Bands:
    """Codes of all bands from rounded vectors. Sums of integers are exact, so they are alike everywhere."""

    def __init__(self, d: int, bits: int, bands: int):
        self.bits, self.bands = bits, bands
        planes = np.rint(32 * np.random.default_rng(SEED + 1).standard_normal((d, bands * bits)))
        largest = 127 * np.abs(planes).sum(axis=0).max(initial=0)
        self.planes = planes.astype(np.float32 if largest < 2**24 else np.float64)

    def codes(self, q: np.ndarray) -> np.ndarray:
        out = np.empty((len(q), self.bands), np.int64)
        powers = 1 << np.arange(self.bits, dtype=np.int64)
        for at in range(0, len(q), 512):
            signs = q[at : at + 512].astype(self.planes.dtype) @ self.planes >= 0
            out[at : at + 512] = (signs.reshape(-1, self.bands, self.bits) * powers).sum(axis=2)
        return out


CODED = "id long, copies long, bits binary, factor double, rounded binary, step double"


def _encode(d: int):
    """Sign bits, correction factor, and components in steps of 1 / 127 of the greatest."""
    turn = rotation(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                turned = _unit(part.column("vector"), d) @ turn
                step = np.abs(turned).max(axis=1) / 127
                q = np.rint(turned / step[:, None]).astype(np.int8)
                factor = (np.where(q >= 0, 1.0, -1.0) * turned).sum(axis=1) / math.sqrt(d)
                bits = np.packbits(q >= 0, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("copies"),
                        pa.array([b.tobytes() for b in bits], pa.binary()),
                        pa.array(factor),
                        pa.array([r.tobytes() for r in q], pa.binary()),
                        pa.array(step),
                    ],
                    names=["id", "copies", "bits", "factor", "rounded", "step"],
                )

    return run


def _band_codes(d: int, bits: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Bands(d, bits, bands)
        for batch in batches:
            codes = tool.codes(np.frombuffer(b"".join(batch.column("rounded").to_pylist()), np.int8).reshape(-1, d))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), bands)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), lists.cast(pa.list_(pa.int64()))], names=["id", "codes"]
            )

    return run


def undecided(
    bits: np.ndarray, factor: np.ndarray, q: np.ndarray, step: np.ndarray, threshold: float, epsilon: float
) -> np.ndarray:
    """Pairs of codes (rows) and rounded vectors (columns) that may reach the threshold."""
    d = q.shape[1]
    sign = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
    met = (sign @ q.T.astype(np.float32)) * (step / math.sqrt(d))  # sums of integers: exact
    most = met + step * math.sqrt(d) / 2 + 1e-9  # each component is off by half a step at most
    f, rest = factor[:, None], np.sqrt(np.maximum(1 - factor**2, 0))[:, None]
    spread = epsilon * rest / f / math.sqrt(max(d - 1, 1))
    maybe = most / f + spread >= threshold
    angle = f * most + rest * np.sqrt(np.maximum(1 - np.minimum(most, 1) ** 2, 0))
    return maybe | (most >= f) | (angle >= threshold - 1e-9)


class Group:
    """The members of two blocks of a cell, and their undecided pairs."""

    def __init__(self, table: pa.Table, d: int, bands: Bands, threshold: float, epsilon: float):
        def binary(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(table.column(name).to_pylist()), kind).reshape(table.num_rows, -1)

        self.bits, self.q = binary("bits", np.uint8), binary("rounded", np.int8)
        self.factor, self.step, self.band, self.bucket, side = (
            table.column(c).to_numpy() for c in ("factor", "step", "band", "bucket", "side")
        )
        self.same = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        self.left = np.arange(table.num_rows) if self.same else np.flatnonzero(side == 0)
        self.right = self.left if self.same else np.flatnonzero(side == 1)
        self.bands, self.bound = bands, (threshold, epsilon)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Undecided pairs of one bucket that agree in no earlier band."""
        left, right = self.left, self.right
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            open_ = undecided(self.bits[rows], self.factor[rows], self.q[right], self.step[right], *self.bound)
            if self.same:
                open_ &= right[None, :] > rows[:, None]
            open_ &= self.bucket[rows][:, None] == self.bucket[right][None, :]
            i, j = np.nonzero(open_)
            if not len(i):
                continue
            i, j = rows[i], right[j]
            on, place = np.unique(np.concatenate([i, j]), return_inverse=True)
            codes = self.bands.codes(self.q[on])
            first = np.empty(len(i), bool)
            for k in range(0, len(i), 50_000):
                a, b = place[k : min(k + 50_000, len(i))], place[len(i) + k : len(i) + k + 50_000]
                first[k : k + 50_000] = (codes[a] == codes[b]).argmax(axis=1) == self.band[i[k : k + 50_000]]
            if first.any():
                yield i[first], j[first]


MEMBER = f"cell long, a int, b int, side int, band int, bucket long, {CODED}"


def _open_members(d: int, bits: int, bands: int, threshold: float, epsilon: float):
    """Members of a group that have an undecided pair in it."""

    def run(table: pa.Table) -> pa.Table:
        group = Group(table, d, Bands(d, bits, bands), threshold, epsilon)
        seen = np.zeros(table.num_rows, bool)
        for i, j in group.pairs():
            seen[i] = seen[j] = True
        return table.filter(pa.array(seen))

    return run


def _compare(d: int, bits: int, bands: int, threshold: float, epsilon: float):
    """Links inside one group, from the vectors of its undecided pairs."""

    def run(table: pa.Table) -> pa.Table:
        group = Group(table, d, Bands(d, bits, bands), threshold, epsilon)
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        x = _unit(table.column("vector").combine_chunks(), d)
        count = np.zeros(len(ids), np.int64)
        ii, jj = [], []
        for i, j in group.pairs():
            link = np.empty(len(i), bool)
            for at in range(0, len(i), 100_000):
                a, b = i[at : at + 100_000], j[at : at + 100_000]
                link[at : at + 100_000] = np.einsum("nd,nd->n", x[a], x[b]) >= threshold
            i, j = i[link], j[link]
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            ii.append(i)
            jj.append(j)
        i, j = (np.concatenate(z) if z else np.zeros(0, int) for z in (ii, jj))
        names, place = np.unique(ids, return_inverse=True)  # the least place is the least id
        on, root = _forest(place[i], place[j], len(names))
        sums = np.flatnonzero(count)
        empty = pa.nulls
        return pa.table(
            {
                "id": pa.array(np.concatenate([ids[sums], names[on]])),
                "links": pa.concat_arrays([pa.array(count[sums]), empty(len(on), pa.int64())]),
                "root": pa.concat_arrays([empty(len(sums), pa.int64()), pa.array(names[root])]),
            }
        )

    return run


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each linked place with the least place that its links reach inside the group."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    on = np.flatnonzero(label != np.arange(n))
    return on, label[on]


def _of_length(vectors: DataFrame, d: int, threshold: float, epsilon: float) -> DataFrame:
    """id, links, root parts of all groups of vectors of d components."""
    n = vectors.count()
    bits, bands = banding(n, threshold)
    coded = staged(vectors.mapInArrow(_encode(d), CODED), "codes")
    codes = coded.select("id", "rounded").mapInArrow(_band_codes(d, bits, bands), "id long, codes array<long>")
    keys = staged(codes.select("id", F.posexplode("codes").alias("band", "code")), "band-codes")
    buckets = keys.groupBy("band", "code").agg(F.count("*").alias("held")).filter("held > 1")
    blocks = F.ceil(F.col("held") / F.lit(BLOCK)).cast("int")
    shared = max(1, n * bands // BLOCK)
    # small buckets share a group, a large one is a cell of its own
    bucket = F.col("code") * bands + F.col("band")
    cell = F.when(F.col("held") <= BLOCK // 8, -1 - F.pmod(F.xxhash64("band", "code"), F.lit(shared)))
    cells = buckets.select(
        "band", "code", blocks.alias("blocks"), bucket.alias("bucket"), F.coalesce(cell, bucket).alias("cell")
    )
    met = keys.join(cells, ["band", "code"]).select("id", "band", "bucket", "cell", "blocks")
    dealt = met.join(coded, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # block x meets every block y of its cell in the group (least, greatest)
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    grouped = pairs.select(
        "cell",
        F.least("block", "other").alias("a"),
        F.greatest("block", "other").alias("b"),
        F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"),
        "band",
        "bucket",
        *coded.columns,
    )
    how = (d, bits, bands, threshold, epsilon)
    members = staged(grouped.groupBy("cell", "a", "b").applyInArrow(_open_members(*how), MEMBER), "undecided")
    return (
        members.join(vectors.select("id", "vector"), "id")
        .groupBy("cell", "a", "b")
        .applyInArrow(_compare(*how), "id long, links long, root long")
    )


def near_vectors(
    table: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    threshold: float = THRESHOLD,
    epsilon: float = EPSILON,
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    value = F.col(embedding).cast("array<double>")
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), value.alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = (F.size("vector") > 0) & finite & F.exists("vector", lambda v: v != 0)
    named = F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False))
    rows = staged(rows.withColumn("digest", F.when(named, F.sha2(F.to_json("vector"), 256))), "vectors")
    equal = staged(
        rows.filter(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(
            F.min("vec_id").alias("id"),
            F.count("*").alias("copies"),
            F.any_value("vector").alias("vector"),
        ),
        "distinct-vectors",
    )
    lengths = [r[0] for r in equal.select(F.size("vector")).distinct().collect()]  # dimensions in use
    parts = None
    for d in sorted(lengths):
        got = _of_length(
            equal.filter(F.size("vector") == d).select("id", "copies", "vector"), d, threshold, epsilon
        )
        parts = got if parts is None else parts.unionByName(got)
    if parts is None:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.col("vec_id").isNotNull().alias("kept"),
        )
    parts = staged(parts, "links")
    labels = components(parts.filter("root is not null").select(F.col("id").alias("u"), F.col("root").alias("v")))
    links = parts.filter("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    facts = (
        equal.select("digest", "id", "copies")
        .join(links, "id", "left")
        .join(labels.withColumnRenamed("vertex", "id"), "id", "left")
        .select(
            "digest",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    out = rows.join(facts, "digest", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return out.withColumn("kept", kept)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return near_vectors(read(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (
  SELECT x, y FROM links
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
n AS (SELECT x, count(DISTINCT y) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(l.y, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(l.y, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN least l ON l.x = vec_id"""
