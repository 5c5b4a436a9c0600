"""Best-fit packing of documents into token sequences.

Documents become pieces in one map step, which returns lengths and checksums, not ids. Full pieces
are sequences of their own. The others are counted by length, and the counts (at most
``capacity`` numbers) are packed: best-fit decreasing gives the first bins, then a local search
exchanges one for one or two for one, or moves pieces between underfull bins, whenever that raises
the sum of squared fills, until bins empty. Bins with the same contents are handled as one pattern
with a number, so the work depends on the number of lengths, not on the number of documents.

Pieces find their places by length and rank. Ranks are taken within a length and a salt, so a length
that a third of all pieces have is spread over ``SALTS`` groups.

Defined results: null text is an empty text, which is the end token alone. The name of an added token of
the vocabulary in a text is that token. Of pieces of equal length the order is by document, checksum and
start, and pieces that are equal in all of them get their places in any order. Repeated rows are pieces of
their own. Only ``doc_id`` and ``text`` are read. An empty table gives no sequences.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clusterlens.llm.common import read, staged
from clusterlens.llm.tokens import token_ids

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k.json"
END = (0).to_bytes(4, "little")
SALTS = 64


def pieces_of(text: Column, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> Column:
    """Array of (start, length, ids_crc32): a long document is cut from its end."""

    @F.arrow_udf("array<struct<start:long,length:long,ids_crc32:long>>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids_of = token_ids(vocabulary)
        for part in parts:
            ends, start, length, crc = [0], [], [], []
            for text in part:
                ids = ids_of(text.as_py() or "") + END
                n = len(ids) // 4
                at = 0
                size = n % capacity or capacity
                while at < n:
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(memoryview(ids)[4 * at : 4 * (at + size)]))
                    at, size = at + size, capacity
                ends.append(len(start))
            cut = pa.StructArray.from_arrays(
                [pa.array(x, pa.int64()) for x in (start, length, crc)],
                names=["start", "length", "ids_crc32"],
            )
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cut)

    return run(text)


# --- packing of counts ---------------------------------------------------------------------------

#: Contents of a bin: (length, copies), long ones first.
Pattern = tuple[tuple[int, int], ...]


def _with(pattern: Pattern, length: int, copies: int) -> Pattern:
    got = dict(pattern)
    got[length] = got.get(length, 0) + copies
    return tuple(sorted(((k, v) for k, v in got.items() if v), reverse=True))


def best_fit(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Best-fit decreasing: the longest pieces first, each into the fullest bin that takes it."""
    room: dict[int, Counter[Pattern]] = {}
    rooms: list[int] = []

    def put(left: int, pattern: Pattern, n: int) -> None:
        if left not in room:
            room[left] = Counter()
            bisect.insort(rooms, left)
        room[left][pattern] += n

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = min(capacity // length, todo)
                bins = todo // each
                put(capacity - each * length, ((length, each),), bins)
                todo -= each * bins
                continue
            left = rooms[i]
            pattern, n = next(iter(room[left].items()))
            each = min(left // length, todo)
            bins = min(n, todo // each)
            room[left][pattern] -= bins
            if not room[left][pattern]:
                del room[left][pattern]
            if not room[left]:
                del room[left], rooms[i]
            put(left - each * length, _with(pattern, length, each), bins)
            todo -= each * bins
    out: Counter[Pattern] = Counter()
    for bins in room.values():
        out.update(bins)
    return out


def _fill(pattern: Pattern) -> int:
    return sum(k * v for k, v in pattern)


def _exchange(a: Pattern, b: Pattern, capacity: int) -> tuple[Pattern, Pattern] | None:
    """The best change of two bins, the fuller one first: what leaves ``b`` fits into ``a``.

    ``a`` gets longer by d tokens, with d at most its room. As it is the fuller one, every d above
    zero raises the sum of squares, and the largest d raises it most.
    """
    left = capacity - _fill(a)
    mine, theirs = [k for k, _ in a], [k for k, _ in b]
    best = (0, None, None)
    for y in theirs:  # a move
        if best[0] < y <= left:
            best = (y, (), (y,))
    singles = sorted(mine)
    for y in theirs:  # one for one
        i = bisect.bisect_left(singles, y - left)
        if i < len(singles) and best[0] < y - singles[i]:
            best = (y - singles[i], (singles[i],), (y,))
    for one, other, sign in ((a, b, 1), (b, a, -1)):  # two of one bin for one of the other
        have = dict(one)
        pairs = [
            (p, q) for p in have for q in have if p > q or (p == q and have[p] > 1)
        ]
        for p, q in pairs:
            for z in (k for k, _ in other):
                d = (z - p - q) * sign
                if best[0] < d <= left:
                    best = (d, (p, q), (z,)) if sign == 1 else (d, (z,), (p, q))
    if not best[0]:
        return None
    for k in best[1]:
        a, b = _with(a, k, -1), _with(b, k, 1)
    for k in best[2]:
        a, b = _with(a, k, 1), _with(b, k, -1)
    return a, b


def improve(
    bins: Counter[Pattern], capacity: int, patience: int = 200, effort: int = 50_000
) -> Counter[Pattern]:
    """Local search: the emptiest bins give to fuller ones until they are empty.

    A pattern without an exchange is settled, until a new pattern has one with it. The search ends when no bin
    fewer is possible, when no pattern with room has an exchange left, or after ``effort`` looks at a pair of
    patterns. ``patience`` is the number of partners looked at for each change. The packing is whole at every
    moment.
    """
    bins = Counter(bins)
    total = sum(_fill(p) * n for p, n in bins.items())
    least = -(-total // capacity)
    settled: set[Pattern] = set()
    while sum(bins.values()) > least and effort > 0:
        open_bins = [p for p in bins if _fill(p) < capacity]
        heapq.heapify(heap := [(_fill(p), p) for p in open_bins if p not in settled])
        if not heap:
            break
        low, b = heapq.heappop(heap)
        partners = heapq.nlargest(patience, (p for p in open_bins if p != b or bins[b] > 1), key=_fill)
        partners = [p for p in partners if _fill(p) >= low]
        for a in partners:
            effort -= 1
            got = _exchange(a, b, capacity)
            if got:
                n = min(bins[a], bins[b]) if a != b else bins[b] // 2
                for p in (a, b):
                    bins[p] -= n
                    if not bins[p]:
                        del bins[p]
                for p in got:
                    if p:
                        bins[p] += n
                for p in (p for p in got if p and _fill(p) < capacity):
                    for s in [s for s in settled if s in bins]:
                        effort -= 1
                        if _exchange(*sorted((p, s), key=_fill, reverse=True), capacity):
                            settled.discard(s)
                settled.difference_update(got)
                break
        else:
            settled.add(b)
    return bins


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> Counter[Pattern]:
    return improve(best_fit(counts, capacity), capacity)


class Slots:
    """Places of all patterns, found by length and rank among the pieces of that length."""

    def __init__(self, patterns: Counter[Pattern], ranks: dict[tuple[int, int], int]):
        used: Counter[int] = Counter()
        rows = []
        first = 0
        for pattern, n in sorted(patterns.items(), reverse=True):
            offset = 0
            for length, copies in pattern:
                rows.append((length, used[length], first, copies, offset))
                used[length] += copies * n
                offset += length * copies
            first += n
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.length, self.rank, self.first, self.copies, self.offset = table.T
        groups = sorted(ranks)
        before: Counter[int] = Counter()
        self.group = np.array([length * SALTS + salt for length, salt in groups], np.int64)
        self.base = np.zeros(len(groups), np.int64)
        for i, (length, salt) in enumerate(groups):
            self.base[i] = before[length]
            before[length] += ranks[length, salt]

    def place(self, length: np.ndarray, salt: np.ndarray, rank: np.ndarray):
        rank = rank + self.base[np.searchsorted(self.group, length * SALTS + salt)]
        keys = np.stack([self.length, self.rank])
        order = np.lexsort((keys[1], keys[0]))
        start = np.searchsorted(self.length[order], length, side="left")
        end = np.searchsorted(self.length[order], length, side="right")
        # the last slot of the length that begins at the rank or before
        wide = int(max(rank.max(initial=0), self.rank.max(initial=0))) + 1
        at = np.searchsorted(self.length * wide + self.rank, length * wide + rank, side="right") - 1
        assert ((at >= start) & (at < end)).all()
        into = rank - self.rank[at]
        bin_, copy = np.divmod(into, self.copies[at])
        return self.first[at] + bin_, self.offset[at] + copy * length


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    spark = docs.sparkSession
    cut = docs.select("doc_id", F.posexplode(pieces_of(F.col("text"), capacity, vocabulary)).alias("piece", "p"))
    pieces = staged(cut.select("doc_id", "piece", "p.start", "p.length", "p.ids_crc32"), "pieces")
    full = pieces.filter(F.col("length") == capacity).select(
        "*",
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    salt = F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(SALTS))
    rest = pieces.filter(F.col("length") < capacity).withColumn("salt", salt)
    ranks = {
        (r["length"], r["salt"]): r["n"]  # at most capacity x SALTS rows
        for r in rest.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()
    }
    counts: Counter[int] = Counter()
    for (length, _), n in ranks.items():
        counts[length] += n
    slots = spark.sparkContext.broadcast(Slots(pack(counts, capacity), ranks))

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(length: pa.Array, salt: pa.Array, rank: pa.Array) -> pa.Array:
        got = slots.value.place(*(x.to_numpy(zero_copy_only=False) for x in (length, salt, rank)))
        return pa.StructArray.from_arrays([pa.array(x) for x in got], names=["sequence_id", "offset"])

    same = Window.partitionBy("length", "salt").orderBy("doc_id", "ids_crc32", "start")
    ranked = rest.withColumn("rank", F.row_number().over(same).cast("long") - 1)
    placed = ranked.withColumn("at", place("length", "salt", "rank"))
    return placed.select(*pieces.columns, "at.sequence_id", "at.offset").unionByName(full)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and places."""
    return pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
