"""Alignment of two tokenizers, with corpus-wide counts of the token pairs that end together.

Tokenizer A encodes a blank and the text, byte by byte pairs; tokenizer B the text, to which it puts a blank
itself. Both begin anew before a blank after anything but white space, so a long text is encoded in portions
that are cut there. A text that the tokens of both do not give back byte by byte has none. The ids are a stored
table.

Places where a token of A and one of B both end cut the two sequences into groups; the two tokens that end a
group are a link. Alignment is vectorised: ends are running sums of token lengths, common ends an intersection of
sorted numbers, over the documents of a share at a time; a longer document is cut at common ends.

Counts: a first pass over the ids leaves, task by task, its distinct pairs and their counts, in ``SLICES`` slices
by the hash of a pair. Distinct pairs of a slice are united in a tree, and a minimal perfect hash of
them is made: levels of bits, in each of which the pairs that no other meets have their bit set, and a pair's number is
the count of bits before its own. Counts are then dense vectors, indexed by that number and verified by the pair
stored there; a task's counts become such a vector, and vectors are summed in a tree. Slices, hashes and
counts are stored tables. A slice holds at most |A| * |B| / ``SLICES`` pairs whatever the corpus.

The second pass aligns the documents again and looks their links up. The tables go to the workers as long as
they have ``TABLE_BYTES`` at most; larger ones are dealt to several passes, each of which adds what its slices know.

Defined results: null and empty texts, and texts that hold what a tokenizer does not give back (U+2581), have no
tokens, links or groups, and all numbers zero. Literal names of special tokens are plain text. Repeated rows count
as often as they are there; rows without an id are aligned like others. Only the named columns are read.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm.common import mix, read, staged
from clusterlens.llm.tokens import encoding
from clusterlens.llm.tree import FAN, tree_merge

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICES = 256
#: Bits of a level of the hash per pair that is left.
SPARE = 2
#: Pairs a task holds before it passes them on.
HELD = 1 << 20
#: Size of the tables of one pass.
TABLE_BYTES = 64 << 20
#: Ids of either vocabulary fit this.
KIND = np.dtype("<u2")
#: Code points encoded at a time, and tokens of A aligned at a time.
PORTION, SHARE = 1 << 19, 1 << 17
#: Both tokenizers begin anew before a blank that follows no white space.
SAFE = re.compile(r"(?<=\S)(?= )")


@functools.lru_cache(maxsize=1)
def pieces(model: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))


class Strings:
    """Byte strings of numbered things, end to end; joins those of many numbers at once."""

    def __init__(self, strings: list[bytes]):
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        shift = self.first[ids] - (np.cumsum(size) - size)
        return self.data[np.repeat(shift, size) + np.arange(size.sum())]


class Vocabularies:
    """Ids of A and B, and the bytes of their tokens."""

    def __init__(self, a: str, b: str):
        self.encode_a = encoding(a).encode_to_numpy
        names = encoding(a).token_byte_values()
        of_a = {encoding(a).encode_single_token(name): name for name in names}  # added tokens are none of them
        self.pieces = pieces(b)
        self.a = Strings([of_a.get(i, b"") for i in range(max(of_a) + 1)])
        self.b = Strings([self._bytes(i) for i in range(self.pieces.get_piece_size())])
        if max(len(self.a.size), len(self.b.size)) > 1 + np.iinfo(KIND).max:
            raise ValueError("ids are kept as 16-bit numbers")
        self.decimal = Strings([str(i).encode() for i in range(max(len(self.a.size), len(self.b.size)))])

    def _bytes(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        if self.pieces.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def ids(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids of A and B as 16-bit numbers; none if they do not give the text back."""
        if not text:
            return b"", b""
        a, b, good = [], [], True
        for portion in portions(text):
            a.append(self.encode_a(portion, disallowed_special=()).astype(KIND))
            b.append(np.array(self.pieces.encode(portion[1:]), KIND))
            whole = portion.encode()
            good = good and self.a.join(a[-1]).tobytes() == whole and self.b.join(b[-1]).tobytes() == whole
        return (np.concatenate(a).tobytes(), np.concatenate(b).tobytes()) if good else (b"", b"")

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which tokens of A, and which of B, end a group; the ids spell the same bytes."""
        end_a, end_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        met = np.searchsorted(end_b, end_a)
        last_a = end_b[met] == end_a
        last_b = np.zeros(len(b), bool)
        last_b[met[last_a]] = True
        return last_a, last_b

    def pieces_of(self, a: np.ndarray, b: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same ids in pieces of about so many tokens of A, cut where a group ends."""
        while len(a) > size:
            step, cut = size, 0
            while not cut and step < len(a):
                room = int(self.a.size[a[:step]].sum())  # no more tokens of B fit
                end_a, end_b = np.cumsum(self.a.size[a[:step]]), np.cumsum(self.b.size[b[:room]])
                both = np.intersect1d(end_a, end_b, assume_unique=True)
                if len(both):
                    cut, cut_b = (int(np.searchsorted(x, both[-1])) + 1 for x in (end_a, end_b))
                step *= 2
            if not cut:
                break
            yield a[:cut], b[:cut_b]
            a, b = a[cut:], b[cut_b:]
        if len(a):
            yield a, b

    def groups(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple:
        """The groups as text (``a1,a2|b1;a3|b2,b3;``), and where the part of each token of A begins."""
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        until_a = np.flatnonzero(last_a) + 1  # tokens up to the end of each group
        until_b = np.concatenate([[0], np.flatnonzero(last_b) + 1])
        place_a = np.arange(len(a)) + until_b[group_a]
        place_b = np.arange(len(b)) + until_a[group_b]
        n = len(a) + len(b)
        ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a[last_a]], mark[place_b[last_b]] = ord("|"), ord(";")
        size = self.decimal.size[ids]
        ends = np.cumsum(size + 1)
        text = np.empty(int(ends[-1]) if n else 0, np.uint8)
        digits = np.ones(len(text), bool)
        digits[ends - 1] = False
        text[ends - 1] = mark
        text[digits] = self.decimal.join(ids)
        return text, (ends - size - 1)[place_a]


@functools.lru_cache(maxsize=1)
def vocabularies(a: str, b: str) -> Vocabularies:
    """The vocabularies of a worker."""
    return Vocabularies(a, b)


def portions(text: str, size: int | None = None) -> Iterator[str]:
    """A blank and the text, in portions of about so many code points that are encoded alike by themselves."""
    size = size or PORTION
    text = " " + text
    at = 0
    while at < len(text):
        cut = SAFE.search(text, at + size) if len(text) - at > size else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def shares(sizes: list[int], most: int) -> Iterator[list[int]]:
    """Places of neighbours whose sizes add up to that at most, or of one that is larger."""
    held, total = [], 0
    for i, n in enumerate(sizes):
        if held and total + n > most:
            yield held
            held, total = [], 0
        held.append(i)
        total += n
    if held:
        yield held


TOKENS = "doc_id long, a binary, b binary"


def _encode(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = vocabularies(a, b)
        for batch in batches:
            text = batch.column("text")
            for share in shares(pc.fill_null(pc.binary_length(text), 0).to_pylist(), 8 * PORTION):
                part = batch.slice(share[0], len(share))
                got = [tool.ids(text.as_py()) for text in part.column("text")]
                columns = [pa.array([x[i] for x in got], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "a", "b"])

    return run


def encode_documents(docs: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """Stored ids of both tokenizers for every document (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return staged(rows.mapInArrow(_encode(a, b), TOKENS), "tokens")


class Share:
    """The alignment of some documents, or of a piece of one."""

    def __init__(self, tool: Vocabularies, a: list[np.ndarray], b: list[np.ndarray]):
        self.tool = tool
        self.a, self.b = np.concatenate(a), np.concatenate(b)
        self.last_a, self.last_b = tool.align(self.a, self.b)
        self.links = self.a[self.last_a].astype(np.uint64) << np.uint64(32) | self.b[self.last_b].astype(np.uint64)
        #: First token of A, and first link, of each document, and the ends.
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in a])])
        self.link = np.concatenate([[0], np.cumsum(self.last_a)])[self.start]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of the links' values by document."""
        return np.diff(np.concatenate([[0], np.cumsum(values)])[self.link])

    def texts(self) -> list[str]:
        """Groups of each document as text."""
        text, at = self.tool.groups(self.a, self.b, self.last_a, self.last_b)
        begin = np.concatenate([at, [len(text)]])[self.start]
        whole = text.tobytes().decode()
        return [whole[x : max(x, y - 1)] for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def alignments(batch: pa.RecordBatch, tool: Vocabularies) -> Iterator[tuple[list[int], Share]]:
    """Shares of a batch of ids (a, b) with their rows; a long document comes in several shares."""
    ids = [[np.frombuffer(x, KIND) for x in batch.column(c).to_pylist()] for c in ("a", "b")]
    for rows in shares([len(x) for x in ids[0]], SHARE):
        if len(ids[0][rows[0]]) > SHARE:
            for a, b in tool.pieces_of(ids[0][rows[0]], ids[1][rows[0]], SHARE):
                yield rows, Share(tool, [a], [b])
        else:
            yield rows, Share(tool, [ids[0][i] for i in rows], [ids[1][i] for i in rows])


def fold(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def slice_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys) >> np.uint64(56)).astype(np.int64) % SLICES


PARTS = "slice int, node long, keys binary, counts binary"


def _collect(a: str, b: str):
    """A task's distinct pairs with their counts, slice by slice."""

    def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        where = slice_of(keys)
        order = np.argsort(where, kind="stable")
        there, first = np.unique(where[order], return_index=True)
        ends = [*first[1:], len(keys)]
        node = int.from_bytes(os.urandom(8), "little") >> 1
        spans = [order[x:y] for x, y in zip(first, ends, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(there.astype(np.int32)),
                pa.array([node] * len(there), pa.int64()),
                pa.array([keys[s].astype("<u8").tobytes() for s in spans], pa.binary()),
                pa.array([counts[s].astype("<i8").tobytes() for s in spans], pa.binary()),
            ],
            names=["slice", "node", "keys", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = vocabularies(a, b)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for _, share in alignments(batch, tool):
                if len(share.links):
                    held.append(np.unique(share.links, return_counts=True))
                    size += len(held[-1][0])
                if size > HELD:
                    held = [fold(*map(np.concatenate, zip(*held, strict=True)))]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield out(*held[0])
                        held, size = [], 0
        if held:
            yield out(*fold(*map(np.concatenate, zip(*held, strict=True))))

    return run


def minimal_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Words of each level, and the words, of a minimal perfect hash of distinct keys."""
    sizes, words = [], []
    left = keys
    while len(left):
        n = -(-SPARE * len(left) // 64)
        bit = level_bit(left, len(sizes), np.uint64(64 * n)).astype(np.int64)
        alone = np.bincount(bit, minlength=64 * n)[bit] == 1
        flags = np.zeros(64 * n, np.uint8)
        flags[bit[alone]] = 1
        sizes.append(n)
        words.append(np.packbits(flags, bitorder="little").view("<u8"))
        left = left[~alone]
    return sizes, np.concatenate(words) if words else np.empty(0, "<u8")


def level_bit(keys: np.ndarray, level: int, bits: np.ndarray | np.uint64) -> np.ndarray:
    return mix(keys + np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) % 2**64)) % bits


class PairTable:
    """The minimal perfect hashes of some slices as one, with the pairs and what belongs to them."""

    def __init__(self, rows: list[dict], columns: dict[str, str]):
        levels = max((len(r["sizes"]) for r in rows), default=0)
        self.bits = np.zeros((SLICES, max(levels, 1)), np.uint64)
        self.first = np.zeros_like(self.bits)
        at = 0
        for r in rows:
            for level, n in enumerate(r["sizes"]):
                self.bits[r["slice"], level], self.first[r["slice"], level] = 64 * n, 64 * at
                at += n
        self.words = np.frombuffer(b"".join(r["words"] for r in rows), "<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.rank = np.cumsum(ones) - ones
        self.held = np.isin(np.arange(SLICES), [r["slice"] for r in rows])
        self.of = {c: np.frombuffer(b"".join(r[c] for r in rows), kind) for c, kind in columns.items()}

    def place(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key by the hash alone, -1 where no level has its bit."""
        where = slice_of(keys)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level in range(self.bits.shape[1]):
            bits = self.bits[where[left], level]
            left, bits = left[bits > 0], bits[bits > 0]
            bit = level_bit(keys[left], level, bits) + self.first[where[left], level]
            word, low = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            value = self.words[word]
            on = (value >> low) & np.uint64(1) == 1
            below = value[on] & ((np.uint64(1) << low[on]) - np.uint64(1))
            out[left[on]] = self.rank[word[on]] + np.bitwise_count(below).astype(np.int64)
            left = left[~on]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for a key that is not there: the stored key must be the same."""
        at = self.place(keys)
        there = at >= 0
        there[there] = self.of["keys"][at[there]] == keys[there]
        return np.where(there, at, -1)


def _unite(table: pa.Table) -> pa.Table:
    keys = np.unique(np.frombuffer(b"".join(table.column("keys").to_pylist()), "<u8"))
    return table.slice(0, 1).set_column(table.schema.get_field_index("keys"), "keys", pa.array([keys.tobytes()], pa.binary()))


HASHES = "slice int, sizes array<long>, words binary, keys binary"


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            keys = np.frombuffer(r["keys"], "<u8")
            sizes, words = minimal_hash(keys)
            row = {"slice": r["slice"], "sizes": sizes, "words": words.tobytes()}
            by_number = np.empty_like(keys)
            by_number[PairTable([row], {}).place(keys)] = keys
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["slice"]], pa.int32()), pa.array([sizes], pa.list_(pa.int64())),
                 pa.array([row["words"]], pa.binary()), pa.array([by_number.tobytes()], pa.binary())],
                names=["slice", "sizes", "words", "keys"],
            )


DENSE = "slice int, node long, counts binary"
DENSE_SCHEMA = pa.schema([("slice", pa.int32()), ("node", pa.int64()), ("counts", pa.binary())])


def _dense(parts: pa.Table, hashes: pa.Table) -> pa.Table:
    """Counts of some tasks as one dense vector."""
    if not parts.num_rows:
        return DENSE_SCHEMA.empty_table()
    table = PairTable(hashes.to_pylist(), {"keys": "<u8"})
    total = np.zeros(len(table.of["keys"]), np.int64)
    for r in parts.to_pylist():
        at = table.find(np.frombuffer(r["keys"], "<u8"))
        total[at] += np.frombuffer(r["counts"], "<i8")  # a part's pairs are distinct
    first = parts.slice(0, 1)
    return pa.table(
        {"slice": first.column("slice"), "node": first.column("node"), "counts": pa.array([total.tobytes()], pa.binary())}
    ).cast(DENSE_SCHEMA)


def _add(table: pa.Table) -> pa.Table:
    vectors = [np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist()]
    total = vectors[0].copy()
    for v in vectors[1:]:
        total += v
    return pa.table(
        {"slice": table.column("slice")[:1], "node": table.column("node")[:1], "counts": pa.array([total.tobytes()], pa.binary())}
    ).cast(DENSE_SCHEMA)


def pair_counts(tokens: DataFrame, a: str = A, b: str = B) -> DataFrame:
    """Stored slices: the hash, the distinct pairs and their counts over all documents (a, b)."""
    parts = staged(tokens.select("a", "b").mapInArrow(_collect(a, b), PARTS), "pairs")
    rows = parts.groupBy("slice").count().agg(F.max("count")).first()[0] or 1
    keys = tree_merge(parts.select("slice", "node", "keys"), ["slice"], _unite, rows)
    hashes = staged(keys.select("slice", "keys").mapInArrow(_build, HASHES), "hashes")
    leaves = -(-rows // FAN)
    dealt = parts.withColumn("node", F.pmod("node", F.lit(leaves)).cast("long"))
    # the hash of a slice goes to each of its leaves, of which there is one for some tasks
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(leaves - 1).cast("long")))
    known = hashes.withColumn("node", every)
    dense = dealt.groupBy("slice", "node").cogroup(known.groupBy("slice", "node")).applyInArrow(_dense, DENSE)
    counts = tree_merge(dense, ["slice"], _add, leaves)
    return staged(hashes.join(counts.select("slice", "counts"), "slice"), "counts")


def _highest(n: int):
    """The highest count of each B id among some slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros(n, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                ids = (np.frombuffer(r["keys"], "<u8") & np.uint64(0xFFFFFFFF)).astype(np.int64)
                np.maximum.at(top, ids, np.frombuffer(r["counts"], "<i8"))
        on = np.flatnonzero(top)
        yield pa.RecordBatch.from_pydict({"b": on, "top": top[on]})

    return run


def highest_counts(counts: DataFrame, b: str = B) -> np.ndarray:
    """The highest count of every B id; as long as the vocabulary."""
    n = pieces(b).get_piece_size()
    rows = counts.select("keys", "counts").mapInArrow(_highest(n), "b long, top long")
    out = np.zeros(n, np.int64)
    for r in rows.groupBy("b").agg(F.max("top").alias("top")).collect():  # one row per B id
        out[r["b"]] = r["top"]
    return out


ALIGNED = """doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long,
    groups string"""
FOUND = f"{TOKENS}, n_best long, count_sum long"


def _look_up(a: str, b: str, shared, top: np.ndarray, last: bool):
    """Adds what the slices of a pass know; the last pass returns the documents."""

    def links(table: PairTable, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a link's count is the highest of its B id, and the count; zeros if other slices know it."""
        keys, back = np.unique(keys, return_inverse=True)
        at = table.find(keys)
        there = at >= 0
        count = np.zeros(len(keys), np.int64)
        count[there] = table.of["counts"][at[there]]
        best = there & (count == top[(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)])
        return best.astype(np.int64)[back], count[back]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tool = PairTable(shared.value, {"keys": "<u8", "counts": "<i8"}), vocabularies(a, b)
        for batch in batches:
            tokens = [[len(x.as_buffer()) // KIND.itemsize for x in batch.column(c)] for c in ("a", "b")]
            for places in shares(tokens[0], 8 * SHARE):  # groups are longer than ids
                part = batch.slice(places[0], len(places))
                n_links = np.zeros(len(places), np.int64)
                n_best, count_sum = (part.column(c).to_numpy().copy() for c in ("n_best", "count_sum"))
                groups: list[list[str]] = [[] for _ in places]
                for rows, share in alignments(part, tool):
                    best, count = links(table, share.links)
                    n_links[rows] += share.sums(np.ones(len(best), np.int64))
                    n_best[rows] += share.sums(best)
                    count_sum[rows] += share.sums(count)
                    for row, text in zip(rows, share.texts() if last else [], strict=last):
                        if text:
                            groups[row].append(text)
                if last:
                    n = [pa.array(tokens[i][places[0] : places[-1] + 1], pa.int64()) for i in (0, 1)]
                    text = pa.array([";".join(g) for g in groups], pa.string())
                    columns = [*n, *map(pa.array, (n_links, n_links, n_best, count_sum)), text]
                    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
                else:
                    columns = [part.column("a"), part.column("b"), pa.array(n_best), pa.array(count_sum)]
                    names = ["a", "b", "n_best", "count_sum"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", *names])

    return run


def passes(counts: DataFrame, limit: int) -> list[list[int]]:
    """Slices of each pass, so that a pass has no more bytes than that, or is one slice."""
    size = F.octet_length("keys") + F.octet_length("counts") + F.octet_length("words")
    out: list[list[int]] = []
    room = 0
    for r in counts.select("slice", size.alias("size")).orderBy("slice").collect():  # one row per slice
        if r["size"] > room:
            out.append([])
            room = limit
        out[-1].append(r["slice"])
        room -= r["size"]
    return out or [[]]


def align_documents(
    tokens: DataFrame, counts: DataFrame, a: str = A, b: str = B, table_bytes: int = TABLE_BYTES
) -> DataFrame:
    """Numbers of tokens, groups and links of every document (doc_id, a, b), its groups as text, and how
    often its links are linked in the corpus of the counts."""
    spark = tokens.sparkSession
    top = highest_counts(counts, b)
    rows = tokens.withColumn("n_best", F.lit(0).cast("long")).withColumn("count_sum", F.lit(0).cast("long"))
    *first, last = passes(counts, table_bytes)
    for slices in [*first, last]:
        held = [r.asDict() for r in counts.filter(F.col("slice").isin(slices)).orderBy("slice").collect()]
        shared = spark.sparkContext.broadcast(held)  # table_bytes at most, or one slice
        if slices is last:
            return rows.mapInArrow(_look_up(a, b, shared, top, True), ALIGNED)
        rows = staged(rows.mapInArrow(_look_up(a, b, shared, top, False), FOUND), "found")
        shared.unpersist()


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document between the two vocabularies, with the digest of the groups."""
    tokens = encode_documents(read(spark, sf_dir, "documents"))
    found = align_documents(tokens, pair_counts(tokens))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256")
    )
