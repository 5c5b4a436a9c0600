"""Benchmark decontamination with suffix arrays of the training text.

Each slice of training documents is a shard. All of its words are ranked by their hashes, without leaving
Arrow's buffers, and all of its suffixes are sorted by prefix doubling: to one word, two, four, and so on up to the
depth of a window, documents' ends included. Every test suffix is binary-searched at every depth among the
sorted suffixes of the shard, and those that occur nowhere to that depth need no deeper search; when none is left, the
shard is sorted no further. What is left at the depth of a window is an interval of the suffix array: all places
of the window. Windows that follow each other on one diagonal are one longest verbatim match. Matches are verified
by a second, independent 64-bit hash of each word.

The words of the benchmark go to the tasks, in blocks of ``block_words`` words of ``WORD_BYTES`` bytes each, which
bounds what a task holds. Further blocks are further passes over the written rows of the pass before.

Defined results: words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z is lower-cased.
Null and empty texts have no words; an item without words matches nothing; an item of fewer words
than ``window`` is one window. Items with equal texts all match, an item id that occurs twice counts
once, items without id are left out. Repeated rows are judged one by one. Other columns of the
documents are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm.common import UPPER, Words, read, staged, text_slices

WINDOW = 10
#: Words of the benchmark that a task holds at a time, and the bytes of each: two hashes, its item, its place,
#: and where a window begins.
BLOCK_WORDS, WORD_BYTES = 4_000_000, 36

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x41:0x5B] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True

SECOND_SEED = 2


class Probe:
    """The words of a block of items, and the windows that are searched, by size."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        raws = [(text or "").encode() for _, text in items]
        offs = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
        raw = np.frombuffer(b"".join(raws), np.uint8)
        words = Words(raw, offs, IS_WORD)
        self.hash, self.second = words.hash, Words(raw, offs, IS_WORD, SECOND_SEED).hash
        self.item_id = np.array([i for i, _ in items], np.int64)
        self.item = words.doc.astype(np.int32)
        self.at = (np.arange(len(words.doc)) - words.first[words.doc]).astype(np.int32)
        self.sizes: dict[int, np.ndarray] = {}
        size = np.minimum(words.count, window)[words.doc]
        self.left = (words.count[words.doc] - self.at).astype(np.int32)  # words up to the end of the item
        for n in np.unique(size):
            self.sizes[int(n)] = np.flatnonzero((size == n) & (self.left >= n))

    def search(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Words per document; longest matches as (document, item, item_at, at, n)."""
        words = Words(raw, offs, IS_WORD)
        array, second, found = SuffixArray(words, self), None, []
        for size, start in self.sizes.items():
            hit, test = array.places(size, start)
            if not len(hit):
                continue
            second = Words(raw, offs, IS_WORD, SECOND_SEED).hash if second is None else second
            same = np.ones(len(hit), bool)
            for k in range(size):
                same &= second[hit + k] == self.second[test + k]
            hit, test = hit[same], test[same]
            found.append(_longest(words, size, hit, self.item[test].astype(np.int64), self.at[test].astype(np.int64)))
        if not found:
            empty = np.zeros(0, np.int64)
            return words.count, (empty, empty, empty, empty, empty)
        merged = [np.concatenate(x) for x in zip(*found, strict=True)]
        order = np.lexsort((merged[2], merged[1], merged[3], merged[0]))
        return words.count, tuple(x[order] for x in merged)


class SuffixArray:
    """The suffixes of a shard, sorted by prefix doubling as deep as test suffixes match.

    A level has, for every suffix of the shard and of the test words, the rank of its first ``depth`` words
    among those of the shard; -1 where the document ends before, and for test suffixes that do not occur.
    """

    def __init__(self, words: Words, probe: Probe):
        names, rank = np.unique(words.hash, return_inverse=True)
        self.levels = {1: (rank.astype(np.int64), _ranks_of(probe.hash, names))}
        #: Words up to the end of the document, or of the test item.
        self.left = words.first[words.doc + 1] - np.arange(len(words.doc)), probe.left

    def _joined(self, depth: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Level of ``depth + step`` words: two suffixes of ``depth`` words, the second ``step`` words on."""
        shard, test = self.levels[depth]
        wide = len(shard) + 1

        def pairs(rank: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.flatnonzero((rank >= 0) & (left >= depth + step))
            at = at[rank[at + step] >= 0]
            return at, rank[at] * wide + rank[at + step]

        at, key = pairs(shard, self.left[0])
        names, rank = np.unique(key, return_inverse=True)
        ranks = np.full(len(shard), -1, np.int64)
        ranks[at] = rank
        test_at, test_key = pairs(test, self.left[1])
        tests = np.full(len(test), -1, np.int64)
        tests[test_at] = _ranks_of(test_key, names)
        return ranks, tests

    def _level(self, depth: int) -> bool:
        """Whether any test suffix matches to a power of two of words; sorts that deep if so."""
        if depth not in self.levels:
            if not self._level(depth // 2):
                return False
            self.levels[depth] = self._joined(depth // 2, depth // 2)
        return bool((self.levels[depth][1] >= 0).any())

    def places(self, size: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the shard of the test windows of a size that begin at ``start``, and the windows'."""
        depth = 1 << (size.bit_length() - 1)
        if not self._level(depth):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        shard, test = self.levels[depth] if size == depth else self._joined(depth, size - depth)
        start = start[test[start] >= 0]
        if not len(start):
            return start, start
        array = np.argsort(shard, kind="stable")
        rank = shard[array]
        low, high = np.searchsorted(rank, test[start], "left"), np.searchsorted(rank, test[start], "right")
        n = high - low
        hit = array[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return hit, np.repeat(start, n)


def _ranks_of(keys: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Places of the keys among sorted names by binary search, -1 for those that are not there."""
    if not len(names):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return np.where(names[at] == keys, at, -1)


def _longest(w: Words, size: int, hit: np.ndarray, item: np.ndarray, item_at: np.ndarray) -> tuple:
    """Window hits that follow each other in both texts are one match."""
    doc = w.doc[hit]
    order = np.lexsort((hit, hit - item_at, item, doc))
    hit, item, item_at, doc = hit[order], item[order], item_at[order], doc[order]
    new = np.ones(len(hit), bool)
    new[1:] = (
        (doc[1:] != doc[:-1])
        | (item[1:] != item[:-1])
        | (hit[1:] - item_at[1:] != hit[:-1] - item_at[:-1])
        | (hit[1:] != hit[:-1] + 1)
    )
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(hit))) - 1 + size
    return doc[start], item[start], item_at[start], hit[start] - w.first[doc[start]], length


MATCHES = "array<struct<item_id:long,item_at:int,at:int,n:int>>"


def find_matches(probe: Probe, text: Column, spark: SparkSession) -> Column:
    """Struct of the number of words and the longest matches of a text."""
    sent = spark.sparkContext.broadcast(probe)

    @F.arrow_udf(f"struct<n_words:int,matches:{MATCHES}>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        probe = sent.value
        for part in parts:
            counts, sizes, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for raw, offs in text_slices(part):
                n, found = probe.search(raw, offs)
                counts.append(n)
                sizes.append(np.bincount(found[0], minlength=len(offs) - 1))
                rows.append(found[1:])
            item, item_at, at, length = (
                [np.concatenate(x) for x in zip(*rows, strict=True)]
                if rows
                else [np.zeros(0, np.int64)] * 4
            )
            match = pa.StructArray.from_arrays(
                [
                    pa.array(probe.item_id[item] if len(item) else item, pa.int64()),
                    *(pa.array(x.astype(np.int32)) for x in (item_at, at, length)),
                ],
                names=["item_id", "item_at", "at", "n"],
            )
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            yield pa.StructArray.from_arrays(
                [
                    pa.array(np.concatenate(counts).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), match),
                ],
                names=["n_words", "matches"],
            )

    return run(text)


def probes(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Probe]:
    """The items in blocks of bounded size; an item is never cut."""
    items: list[tuple[int, str]] = []
    held = 0
    rows = benchmark.select("item_id", "text").filter(
        F.col("item_id").isNotNull() & F.col("text").isNotNull()
    )
    for row in rows.toLocalIterator():
        items.append((row["item_id"], row["text"]))
        held += len(row["text"]) // 2 + 1  # no text has more words
        if held >= block_words:
            yield Probe(items, window)
            items, held = [], 0
    yield Probe(items, window)


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Each row as a struct ``row``, with ``found``: n_words and the longest matches."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    for k, probe in enumerate(probes(benchmark, window, block_words)):
        got = find_matches(probe, F.col("row.text"), spark)
        if k == 0:
            rows = rows.withColumn("found", got)
            continue
        rows = staged(rows, "matches").withColumn("more", got)
        both = F.concat("found.matches", "more.matches")
        rows = rows.select(
            "row", F.struct(F.col("found.n_words"), both.alias("matches")).alias("found")
        )
    return rows


def hit_words(matches: Column) -> Column:
    """Words in the union of the matches."""
    spans = F.array_sort(
        F.transform(matches, lambda m: F.struct(m["at"].alias("at"), (m["at"] + m["n"]).alias("end")))
    )
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))

    def add(acc: Column, span: Column) -> Column:
        more = F.greatest(F.lit(0), span["end"] - F.greatest(acc["end"], span["at"]))
        return F.struct(
            (acc["total"] + more).alias("total"),
            F.greatest(acc["end"], span["end"]).alias("end"),
        )

    return F.aggregate(spans, zero, add)["total"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without any match, with all their columns."""
    rows = contamination(docs, benchmark, window)
    return rows.filter(F.size("found.matches") == 0).select("row.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and matched items of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = contamination(docs, read(spark, sf_dir, "benchmark"))
    ids = F.array_distinct(F.transform("found.matches", lambda m: m["item_id"].cast("string")))
    return (
        rows.select("row.doc_id", "found", F.array_sort(ids).alias("items"))
        .withColumn("n_hit", hit_words(F.col("found.matches")).cast("long"))
        .select(
            "doc_id",
            F.col("found.n_words").cast("long").alias("n_words"),
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), '" + UPPER + "', '" + UPPER.lower() + "'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
tests AS (
  SELECT DISTINCT item_id, size, list_slice(w, s, s + size - 1) AS words FROM (
    SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s
    FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM tests),
places AS (
  SELECT doc_id, size, s, list_slice(w, s, s + size - 1) AS words FROM (
    SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)),
hits AS (
  SELECT p.doc_id, p.size, p.s, t.item_id FROM places p JOIN tests t
    ON t.size = p.size AND t.words = p.words),
hit_words AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (
    SELECT doc_id, unnest(range(s, s + size)) AS spot FROM (SELECT DISTINCT doc_id, s, size FROM hits))
  GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id"""
