"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of hashed word shingles, named by a digest of the set, so exact copies are one
set from the start. Two sets link if their Jaccard similarity reaches the threshold t.

The rule behind every step: if |x and y| >= o, the first |x| - o + l tokens of x and the first
|y| - o + l tokens of y, in any order that is the same for all sets, share at least l tokens. As o is
at least t times the larger set, a set of n tokens needs a prefix of n - ceil(t n) + l.

1. All sets, in hash order: prefixes are lengthened by ``SPREAD`` of the set, and so many more of
   their tokens must be held by other sets too. Only counts come back. A set that shares boilerplate
   with thousands of others but is no near copy ends here.
2. Remaining sets meet the first set of each of their min-hash bands and are verified. This is no
   filter: it joins groups of near copies early, so that their pairs need not be listed. As that
   first set may itself lie at the rim of a group, each set then meets ``NEIGHBOURS`` others
   of each band, at random, if they belong to other components.
3. Remaining sets, rarest tokens first. Tokens that stay inside one component can tell nothing new
   and come first of all. For each set the prefix is lengthened to the l with the least estimated
   cost: list entries to read, plus candidates to verify, of which there are at most entries / l.
   Pairs of different components that share min(l, l') prefix tokens are verified on whole sets.

A pair is met only if the parities of its sets allow it: each token flips one of ``PARITY`` bits of a
set, so two sets differ in at least as many tokens as their bits differ. That is exact as well.

Defined results: words are runs of ``[^\\x20\\t-\\r]`` after A-Z is lower-cased; a text with fewer
words than a shingle is one token. Null and empty texts are empty sets, which link with nothing.
Rows without an id have no component and are no one's representative. Repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clusterlens.llm.common import UPPER, Words, mix, read, staged, text_slices
from clusterlens.llm.components import components

SIZE = 5
#: Similarity threshold in percent.
PERCENT = 80
#: Share of a set by which prefixes are lengthened in the first step.
SPREAD = 0.1
BANDS, ROWS = 12, 4
#: Sets of a band that are put in random order together, and how many of those before it a set meets.
BLOCK, NEIGHBOURS = 512, 8
#: Bits of a set's parity, in 64-bit words.
PARITY = 1024
WORDS = PARITY // 64

IS_WORD = np.ones(256, bool)
IS_WORD[0x20] = False
IS_WORD[0x09:0x0E] = False


def shingle_sets(raw: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of a slice's documents, sorted within each, and the number of each."""
    w = Words(raw, offs, IS_WORD)
    at, token = w.windows(size)
    doc = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < size))
    if len(short):
        whole = []
        for d in short:
            h = np.uint64(w.count[d])
            for x in w.hash[w.first[d] : w.first[d + 1]]:
                h = mix(np.array([h ^ x]))[0]
            whole.append(h)
        token = np.concatenate([token, np.array(whole, np.uint64)])
        doc = np.concatenate([doc, short])
    order = np.lexsort((token, doc))
    token, doc = token[order], doc[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
    token, doc = token[new], doc[new]
    return token, np.bincount(doc, minlength=len(offs) - 1)


def digests(token: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Name of each set; 0 for the empty one."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(token ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
    ends = np.cumsum(count)
    h = mix((total[ends] - total[ends - count]) ^ (count.astype(np.uint64) << np.uint64(40)))
    h[count == 0] = 0
    return h.view(np.int64)


def _ceil(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def _spread(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, (n * SPREAD).astype(np.int64))


def document_sets(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n, digest for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for raw, offs in text_slices(batch.column("text")):
                token, count = shingle_sets(raw, offs, size)
                ids = batch.column("doc_id").slice(row, len(count))
                row += len(count)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(count.astype(np.int64)), pa.array(digests(token, count))],
                    names=["doc_id", "n", "digest"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest long")


def _prefix_packets(size: int, percent: int, buckets: int):
    """Prefix tokens in hash order, packed by bucket: token and set of each as binary columns."""

    def flush(tokens: list, owners: list) -> pa.RecordBatch:
        token, owner = np.concatenate(tokens), np.concatenate(owners)
        bucket = (token % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        token, owner, bucket = token[order], owner[order], bucket[order]
        start = np.flatnonzero(np.diff(bucket, prepend=-1))
        end = np.append(start[1:], len(bucket))
        cut = [(s, e) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[start]),
                pa.array([token[s:e].tobytes() for s, e in cut], pa.binary()),
                pa.array([owner[s:e].tobytes() for s, e in cut], pa.binary()),
            ],
            names=["bucket", "tokens", "owners"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners, held, seen = [], [], 0, set()
        for batch in batches:
            for raw, offs in text_slices(batch.column("text")):
                token, count = shingle_sets(raw, offs, size)
                digest = digests(token, count)
                # a copy of a set that this task has sent need not be sent again
                new = np.array([d not in seen and not seen.add(d) for d in digest.tolist()], bool)
                if len(seen) > 1_000_000:
                    seen.clear()
                prefix = np.minimum(count, count - _ceil(count, percent) + _spread(count))
                prefix[~new] = 0
                place = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)
                take = place < np.repeat(prefix, count)
                tokens.append(token[take])
                owners.append(np.repeat(digest, prefix))
                held += len(tokens[-1])
                if held > 1_500_000:
                    yield flush(tokens, owners)
                    tokens, owners, held = [], [], 0
        if held:
            yield flush(tokens, owners)

    return run


def _shared_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each set that another set of the bucket holds; packets come sorted by bucket."""

    def count(tokens: list[bytes], owners: list[bytes]) -> pa.RecordBatch:
        token = np.frombuffer(b"".join(tokens), np.uint64)
        owner = np.frombuffer(b"".join(owners), np.int64)
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        same = token[1:] == token[:-1]
        again = np.concatenate([[False], same & (owner[1:] == owner[:-1])])
        token, owner = token[~again], owner[~again]
        same = token[1:] == token[:-1]
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        name, n = np.unique(owner[shared], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(name), pa.array(n)], names=["digest", "shared"])

    now, tokens, owners = None, [], []
    for batch in batches:
        cols = (batch.column(c).to_pylist() for c in ("bucket", "tokens", "owners"))
        for bucket, t, o in zip(*cols, strict=True):
            if bucket != now and tokens:
                yield count(tokens, owners)
                tokens, owners = [], []
            now = bucket
            tokens.append(t)
            owners.append(o)
    if tokens:
        yield count(tokens, owners)


def near_sets(docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """digest of the sets whose prefixes share enough tokens with others."""
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    packets = docs.select("text").mapInArrow(
        _prefix_packets(size, percent, buckets), "bucket int, tokens binary, owners binary"
    )
    counts = (
        packets.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_shared_counts, "digest long, shared long")
        .groupBy("digest")
        .agg(F.sum("shared").alias("shared"))
    )
    # a partner may be smaller, and then its shorter prefix counts
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) * SPREAD).cast("long"))
    named = sets.filter("n > 0").groupBy("digest").agg(F.first("n").alias("n"))
    return counts.join(named, "digest").filter(F.col("shared") >= least).select("digest")


def _tokens(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, offs in text_slices(batch.column("text")):
                token, count = shingle_sets(raw, offs, size)
                ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                bands, parity = _bands(token, count), _parity(token, count)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(digests(token, count)),
                        pa.array(count.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(token.view(np.int64))),
                        *(
                            pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(
                                pa.list_(pa.int64())
                            )
                            for x in (bands, parity)
                        ),
                    ],
                    names=["digest", "n", "tokens", "bands", "parity"],
                )

    return run


def _bands(token: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Min-hash bands of each set (an empty set, which is never asked for, gets zeros)."""
    out = np.zeros((len(count), BANDS), np.int64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    start = (np.cumsum(count) - count)[some]
    for band in range(BANDS):
        h = np.zeros(len(some), np.uint64)
        for row in range(ROWS):
            salt = mix(np.array([band * ROWS + row + 1], np.uint64))[0]
            h = mix(h ^ np.minimum.reduceat(mix(token ^ salt), start))
        out[some, band] = h.view(np.int64)
    return out


def _parity(token: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each set, which of ``PARITY`` bits an odd number of tokens falls on."""
    out = np.zeros((len(count), WORDS), np.int64)
    doc = np.repeat(np.arange(len(count)), count)
    bit = (mix(token ^ np.uint64(0x5DEECE66D)) % np.uint64(PARITY)).astype(np.int64)
    step = 4096  # sets at a time
    ends = np.cumsum(count)
    for at in range(0, len(count), step):
        to = min(at + step, len(count))
        first, last = ends[at] - count[at], ends[to - 1]
        odd = np.bincount((doc[first:last] - at) * PARITY + bit[first:last], minlength=(to - at) * PARITY)
        bits = np.packbits((odd & 1).astype(np.uint8).reshape(to - at, PARITY), axis=1)
        out[at:to] = bits.view(np.int64)
    return out


def _verify(percent: int):
    """Pairs (u, v) of those whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left, right = batch.column("left"), batch.column("right")
            for i in range(batch.num_rows):
                a, b = left[i].values.to_numpy(), right[i].values.to_numpy()
                both = len(a) + len(b) - len(np.union1d(a, b))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of set names that link."""
    left = sets.select(F.col("digest").alias("u"), F.col("tokens").alias("left"))
    right = sets.select(F.col("digest").alias("v"), F.col("tokens").alias("right"))
    rows = pairs.join(right, "v").join(left, "u")
    return rows.select("u", "v", "left", "right").mapInArrow(_verify(percent), "u long, v long")


def _near(n: Column, m: Column, p: list[Column], q: list[Column], percent: int) -> Column:
    """Whether sizes n, m and parities p, q of two sets let them link."""
    differ = [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(p, q, strict=True)]
    # |x and y| >= t |x or y|, so they differ in (1 - t) / (1 + t) of |x| + |y| at most
    near = sum(differ[1:], differ[0]) * (100 + percent) <= (n + m) * (100 - percent)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & near


def _fits(a: str, b: str, percent: int) -> Column:
    """The same for the columns n and p0, p1, ... of a and b."""
    p, q = ([F.col(f"{x}.p{i}") for i in range(WORDS)] for x in (a, b))
    return _near(F.col(f"{a}.n"), F.col(f"{b}.n"), p, q, percent)


PARITIES = [f"p{i}" for i in range(WORDS)]


def _parities(source: str = "parity") -> list[Column]:
    return [F.col(source)[i].alias(p) for i, p in enumerate(PARITIES)]


def first_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links of each set with the least set that each of its bands meets."""
    bands = sets.select("digest", F.posexplode("bands").alias("band", "sig"))
    heads = bands.groupBy("band", "sig").agg(F.min("digest").alias("u"), F.count("*").alias("held"))
    heads = heads.filter("held > 1").select("band", "sig", "u")
    pairs = bands.join(heads, ["band", "sig"]).filter("u < digest")
    pairs = pairs.select("u", F.col("digest").alias("v")).distinct()
    traits = sets.select("digest", "n", *_parities())
    met = (
        pairs.alias("e")
        .join(traits.alias("a"), F.col("e.u") == F.col("a.digest"))
        .join(traits.alias("b"), F.col("e.v") == F.col("b.digest"))
        .filter(_fits("a", "b", percent))
        .select("e.u", "e.v")
    )
    return verified(met, sets, percent)


def neighbour_links(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links of each set with random sets of its bands, where components differ."""
    named = sets.join(labels, sets["digest"] == labels["vertex"], "left").select(
        "digest", "n", "parity", "bands", F.coalesce("component", "digest").alias("component")
    )
    traits = ["digest", "n", "parity", "component"]
    bands = named.select(*traits, F.posexplode("bands").alias("band", "sig"))
    across = bands.groupBy("band", "sig").agg(
        F.count("*").alias("held"), F.min("component").alias("a"), F.max("component").alias("b")
    )
    across = across.filter("a < b").select("band", "sig", F.ceil(F.col("held") / BLOCK).alias("blocks"))
    rows = bands.join(across, ["band", "sig"]).withColumn("random", F.xxhash64("digest", "band"))
    in_block = Window.partitionBy("band", "sig", F.pmod("random", "blocks")).orderBy("random", "digest")
    before = F.collect_list(F.struct(*traits)).over(in_block.rowsBetween(-NEIGHBOURS, -1))

    def may_link(other: Column) -> Column:
        p, q = ([x[i] for i in range(WORDS)] for x in (F.col("parity"), other["parity"]))
        return (other["component"] != F.col("component")) & _near(F.col("n"), other["n"], p, q, percent)

    met = rows.withColumn("before", before).select("digest", F.filter("before", may_link).alias("met"))
    pairs = met.select("digest", F.explode("met.digest").alias("other"))
    pairs = pairs.select(F.least("digest", "other").alias("u"), F.greatest("digest", "other").alias("v"))
    return verified(pairs.distinct(), sets, percent)


def candidate_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of different components that share enough tokens of their prefixes."""
    named = sets.join(labels, sets["digest"] == labels["vertex"], "left").select(
        "digest", "n", "tokens", "parity", F.coalesce("component", "digest").alias("component")
    )
    rows = named.select("digest", "n", "component", F.explode("tokens").alias("token"))
    lists = rows.groupBy("token").agg(
        F.count("*").alias("df"), F.min("component").alias("a"), F.max("component").alias("b")
    )
    across = lists.filter("a < b").select("token", "df")
    rows = staged(rows.join(across, "token"), "prefix-tokens")
    # tokens inside one component come first, and take up the prefix of most sets
    by_set = Window.partitionBy("digest")
    in_order = by_set.orderBy("df", "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = F.ceil(F.col("n") * percent / 100)
    ranked = (
        rows.withColumn("across", F.count("*").over(by_set))
        .filter(F.col("across") >= least)
        .withColumn("place", F.count("*").over(in_order))
        .withColumn("entries", F.sum(F.col("df") - 1).over(in_order))
        # matches that a prefix ending here asks for
        .withColumn("l", F.col("place") + (F.col("n") - F.col("across")) - (F.col("n") - least))
    )
    cost = F.col("entries") + F.col("entries") * F.col("n") / F.col("l")
    best = ranked.withColumn(
        "best", F.min(F.when(F.col("l") >= 1, F.struct(cost.alias("cost"), "l"))).over(by_set)
    )
    prefix = staged(
        best.filter(F.col("l") <= F.col("best.l")).select(
            "token", "digest", F.col("best.l").alias("l")
        ),
        "prefixes",
    )
    traits = named.select("digest", "n", "component", *_parities())
    prefix = prefix.join(traits, "digest")
    a, b = prefix.alias("a"), prefix.alias("b")
    met = a.join(
        b,
        (F.col("a.token") == F.col("b.token"))
        & (F.col("a.digest") < F.col("b.digest"))
        & (F.col("a.component") != F.col("b.component"))
        & _fits("a", "b", percent),
    )
    return (
        met.groupBy(F.col("a.digest").alias("u"), F.col("b.digest").alias("v"))
        .agg(F.count("*").alias("shared"), F.first(F.least("a.l", "b.l")).alias("l"))
        .filter("shared >= l")
        .select("u", "v")
    )


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id that links reach) for every row."""
    docs = docs.select("doc_id", "text")
    sets = staged(document_sets(docs, size), "document-sets")
    known = sets.filter(F.col("doc_id").isNotNull())
    near = near_sets(docs.filter(F.col("doc_id").isNotNull()), known, size, percent)
    heads = (
        known.join(near, "digest")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"))
        .select("doc_id")
        .distinct()
    )
    texts = docs.join(heads, "doc_id", "left_semi").select("text")
    near_tokens = staged(
        texts.mapInArrow(_tokens(size), "digest long, n long, tokens array<long>, bands array<long>, parity array<long>")
        .filter("n > 0")
        .dropDuplicates(["digest"]),
        "shingle-sets",
    )
    links = staged(first_links(near_tokens, percent), "links")
    more = neighbour_links(near_tokens, components(links), percent)
    links = staged(links.unionByName(more), "links")
    pairs = candidate_pairs(near_tokens, components(links), percent)
    links = links.unionByName(verified(pairs, near_tokens, percent))
    labels = components(links)
    rows = sets.join(labels, sets["digest"] == labels["vertex"], "left").select(
        "doc_id", "n", F.coalesce("component", "digest").alias("label")
    )
    least = rows.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "label", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("least"))
        .otherwise(F.col("doc_id"))
        .alias("component_id"),
    )


def representatives(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The row with the least id of each component, with all its columns; rows without an id stay.

    Of rows with that id and equal texts one stays, of different texts under one id each does.
    """
    found = jaccard_components(docs, size, percent)
    heads = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    whole = docs.select(F.struct("*").alias("row"))  # columns of any name are out of the way
    rows = whole.join(heads, F.col("row.doc_id") == F.col("doc_id"), "left_semi")
    one = Window.partitionBy("row.doc_id", F.xxhash64("row.text"), F.sha2("row.text", 256)).orderBy("row.doc_id")
    rows = rows.withColumn("place", F.row_number().over(one)).filter("place = 1")
    return rows.unionByName(whole.filter("row.doc_id IS NULL").withColumn("place", F.lit(1))).select("row.*")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document."""
    return jaccard_components(read(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, sha256(array_to_string(list_slice(w, i, i + 4), ' ')) AS shingle FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b
    ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM both_ JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
reach AS (
  SELECT x, y FROM links
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.y, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.x = d.doc_id"""
