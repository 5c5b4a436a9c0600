"""Token counts that follow edits without encoding whole documents again.

A document is cut into segments of about ``SEGMENT`` code points, only where a blank or a line feed
follows a letter or digit. No pre-token reaches over such a place, and what follows it is encoded
alike whatever stands before, so a document's count is the sum over its segments. A tree holds
the segments' code points and tokens in its leaves and the sums of both in every subtree. An edit walks down to its
place by code points, encodes the segments it touches (and a neighbour, where it touches the three
characters that make a cut safe), and adds the differences up along the paths to the root.

Trees are a table: doc_id, version, chars, tokens, the number of leaves and the sums of all nodes, level after
level from the leaves; counting after edits returns the trees of the new versions alike. Edits are a table too:
doc_id, start, length, replacement, in places of the text before any of a document's edits.

Defined results: null text is an empty text with one empty segment and no tokens. Edits beyond the
end are moved to the end, negative places to the start; of overlapping edits the later one keeps only
what the earlier left; a null replacement deletes; equal starts are applied by length, then
replacement. Edits without a document are ignored, documents without edits keep their counts. Rows
without an id have no edits. Repeated rows of a document all get its edits. Only named columns are
read. The name of an added token of the vocabulary in a text is that token.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm.common import read, staged
from clusterlens.llm.tokens import token_ids

VOCABULARY = "byte_bpe_50k.json"
#: Code points after which a segment ends at the next safe place.
SEGMENT = 512
#: Children of a node of the tree.
FAN = 16

SAFE = re.compile(r"(?<=[^\W_])(?=[ \n])")


def cuts(text: str, size: int = SEGMENT) -> list[int]:
    """Ends of the segments; the last is the end of the text."""
    out, at = [], 0
    while len(text) - at > size:
        m = SAFE.search(text, at + size)
        if m is None:
            break
        at = m.start()
        out.append(at)
    return [*out, len(text)]


class Tree:
    """Sums of code points and tokens, level after level from the leaves to the root."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.levels = [(list(chars), list(tokens))]
        while len(self.levels[-1][0]) > 1:
            below = self.levels[-1]
            at = range(0, len(below[0]), FAN)
            self.levels.append(tuple([sum(x[i : i + FAN]) for i in at] for x in below))

    @classmethod
    def stored(cls, leaves: int, chars: list[int], tokens: list[int]) -> Tree:
        """The tree of stored nodes, level after level; nothing is summed again."""
        tree = cls.__new__(cls)
        tree.levels, at, n = [], 0, leaves
        while at < len(chars):
            tree.levels.append((chars[at : at + n], tokens[at : at + n]))
            at, n = at + n, -(-n // FAN)
        return tree

    def nodes(self) -> tuple[list[int], list[int]]:
        """Sums of all nodes, level after level."""
        return tuple([n for level in self.levels for n in level[i]] for i in (0, 1))

    @property
    def root(self) -> tuple[int, int]:
        chars, tokens = self.levels[-1]
        return chars[0], tokens[0]

    def find(self, place: int) -> tuple[int, int]:
        """Leaf that holds a place, and where the leaf starts; the last leaf holds the end."""
        node, start = 0, 0
        for level in range(len(self.levels) - 2, -1, -1):
            chars = self.levels[level][0]
            node *= FAN
            last = min(node + FAN, len(chars)) - 1
            while node < last and place >= start + chars[node]:
                start += chars[node]
                node += 1
        return node, start

    def update(self, leaf: int, chars: int, tokens: int) -> None:
        """New sums of a leaf and of all nodes above it."""
        more = chars - self.levels[0][0][leaf], tokens - self.levels[0][1][leaf]
        for level in self.levels:
            for x, d in zip(level, more, strict=True):
                x[leaf] += d
            leaf //= FAN


class Counter:
    """Tokens of a piece of text, and how many code points have been encoded."""

    def __init__(self, vocabulary: str = VOCABULARY):
        self.ids = token_ids(vocabulary)
        self.encoded = 0

    def __call__(self, text: str) -> int:
        self.encoded += len(text)
        return len(self.ids(text)) // 4


def build(text: str, count: Counter) -> Tree:
    ends = cuts(text)
    parts = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    return Tree([len(p) for p in parts], [count(p) for p in parts])


def _touched(text: str, tree: Tree, a: int, b: int) -> tuple[int, int]:
    """First and last leaf to encode again for an edit of [a, b)."""
    chars = tree.levels[0][0]
    first, start = tree.find(a)
    # the cut before the leaf rests on the characters before and at it; earlier edits may have emptied leaves
    if first and a <= start:
        first -= 1
        while first and not chars[first]:
            first -= 1
    last, start = tree.find(max(a, b))
    end = start + chars[last]
    # so does the cut after it
    if b >= end and last + 1 < len(chars):
        last += 1
        while last + 1 < len(chars) and not chars[last]:
            last += 1
    return first, last


def apply_edits(text: str, tree: Tree, edits: list[tuple[int, int, str]], count: Counter) -> str:
    """The new text; the tree follows. Edits are (start, length, replacement) in the old text."""
    clean = []
    done = 0
    for start, length, new in sorted(edits):
        a = max(done, min(max(start, 0), len(text)))
        b = max(a, min(max(start, 0) + max(length, 0), len(text)))
        clean.append((a, b, new))
        done = b
    # edits whose leaves meet are one region
    starts = [0]
    for n in tree.levels[0][0]:
        starts.append(starts[-1] + n)
    regions: list[list] = []
    for a, b, new in clean:
        first, last = _touched(text, tree, a, b)
        if regions and first <= regions[-1][1]:
            regions[-1][1] = max(regions[-1][1], last)
            regions[-1][2].append((a, b, new))
        else:
            regions.append([first, last, [(a, b, new)]])
    out, at = [], 0
    for first, last, inside in regions:
        left, right = starts[first], starts[last + 1]
        out.append(text[at:left])
        piece, here = [], left
        for a, b, new in inside:
            piece += [text[here:a], new]
            here = b
        piece = "".join([*piece, text[here:right]])
        # the region is one leaf now; its other leaves are empty
        tree.update(first, len(piece), count(piece))
        for leaf in range(first + 1, last + 1):
            tree.update(leaf, 0, 0)
        out.append(piece)
        at = right
    out.append(text[at:])
    return "".join(out)


NODES = "leaves int, node_chars array<long>, node_tokens array<long>"
TREE = f"doc_id long, version string, chars long, tokens long, {NODES}"


def _tree_columns(trees: list[Tree]) -> list[pa.Array]:
    longs = pa.list_(pa.int64())
    nodes = [t.nodes() for t in trees]
    leaves = pa.array([len(t.levels[0][0]) for t in trees], pa.int32())
    return [leaves, pa.array([n[0] for n in nodes], longs), pa.array([n[1] for n in nodes], longs)]


def build_trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The tree of every row, with the sums of all of its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = Counter(vocabulary)
            trees = [build(t.as_py(), count) for t in batch.column("text")]
            roots = [pa.array([t.root[i] for t in trees], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("version"), *roots, *_tree_columns(trees)],
                names=["doc_id", "version", "chars", "tokens", "leaves", "node_chars", "node_tokens"],
            )

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.md5(text).alias("version"), text.alias("text"))
    return rows.mapInArrow(run, TREE)


COUNTS = ["doc_id", "n_chars", "n_tokens", "n_edits", "n_chars_after", "n_tokens_after", "n_encoded"]
EDITED = ", ".join(f"{c} long" for c in COUNTS) + f", version string, {NODES}"


def recount(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts before and after the edits, the code points encoded for the edits, and the new tree.

    Rows: doc_id, text, the tree's leaves, node_chars and node_tokens, edits (array of start, length, replacement).
    """
    names = ["doc_id", "text", "leaves", "node_chars", "node_tokens", "edits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, trees, versions = [], [], []
            for row in zip(*[batch.column(c) for c in names], strict=True):
                doc_id, text, leaves, chars, tokens, edits = (x.as_py() for x in row)
                tree, count = Tree.stored(leaves, chars, tokens), Counter(vocabulary)
                n_chars, n_tokens = tree.root
                wanted = [
                    (e["start"], e["length"] or 0, e["replacement"] or "")
                    for e in edits or []
                    if e["start"] is not None
                ]
                if wanted:
                    text = apply_edits(text, tree, wanted, count)
                out.append((doc_id, n_chars, n_tokens, len(wanted), *tree.root, count.encoded))
                trees.append(tree)
                versions.append(hashlib.md5(text.encode()).hexdigest())
            numbers = [pa.array([r[i] for r in out], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(
                [*numbers, pa.array(versions, pa.string()), *_tree_columns(trees)],
                names=[*COUNTS, "version", "leaves", "node_chars", "node_tokens"],
            )

    return rows.mapInArrow(run, EDITED)


def count_edited(
    docs: DataFrame, trees: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY
) -> DataFrame:
    """Counts and trees of all documents after their edits; stored trees spare encoding the rest."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.md5(text).alias("version"))
    known = trees.dropDuplicates(["doc_id", "version"])
    one = F.struct("start", "length", "replacement")
    wanted = edits.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.collect_list(one).alias("edits"))
    same = F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("r.version") == F.col("t.version"))
    # trees meet their edits first, so texts move once; they are never sorted, as the small side is hashed
    due = known.alias("k").join(wanted.alias("e"), F.col("k.doc_id") == F.col("e.doc_id"), "left")
    due = due.select("k.doc_id", "k.version", "leaves", "node_chars", "node_tokens", "edits")
    joined = rows.alias("r").join(due.hint("shuffle_hash").alias("t"), same)
    return recount(joined.select("r.doc_id", "r.text", "leaves", "node_chars", "node_tokens", "edits"), vocabulary)


def _edits(doc_id: Column, text: Column) -> Column:
    """A deletion, an insertion and a replacement made of a text; places follow from the id's hash."""
    n = F.char_length(text)
    words = F.substring(text, 1, 40)

    def edit(k: int, length: int, new: Column) -> Column:
        start = F.pmod(F.xxhash64(doc_id, F.lit(k)), n + 1).cast("int")
        return F.struct(
            start.alias("start"), F.lit(length).alias("length"), new.alias("replacement")
        )

    return F.array(
        edit(1, 25, F.lit("")),
        edit(2, 0, words),
        edit(3, 12, F.concat(F.lit(" "), words, F.lit("\n"))),
    )


def sample_edits(docs: DataFrame) -> DataFrame:
    """Three edits of each document, as a table; rows that repeat a document add none."""
    text = F.coalesce("text", F.lit(""))
    named = docs.filter(F.col("doc_id").isNotNull())
    rows = named.select("doc_id", F.explode(_edits(F.col("doc_id"), text)).alias("e")).select("doc_id", "e.*")
    return rows.distinct()


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after three edits, and what was encoded for them."""
    docs = read(spark, sf_dir, "documents")
    trees = staged(build_trees(docs), "trees")
    edits = staged(sample_edits(docs), "edits")
    return count_edited(docs, trees, edits).select(COUNTS)
