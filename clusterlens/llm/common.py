"""Helpers of the operators: tables, staged results, and vectorised work on Arrow text columns."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.sources.store import shared_folder, staged

__all__ = ["read", "staged", "shared_folder", "held_out", "text_slices", "words", "Words"]

#: Text that one vectorised step works on. A longer document is a step of its own.
SLICE_BYTES = 1 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, every other letter as it is. All-ASCII text takes the faster way."""
    ascii_only = F.octet_length(c) == F.char_length(c)
    return F.when(ascii_only, F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether the CRC-32 of the id's text falls into a fold; an unknown id is in none."""
    part = F.crc32(doc_id.cast("string").cast("binary")) % folds
    return F.coalesce(part == fold, F.lit(False))


def text_slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """UTF-8 bytes and document offsets, a few documents at a time; null is an empty text."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    n = len(text)
    if not n:
        return
    _, offsets, data = text.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes; one to one."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


@functools.lru_cache(maxsize=8)
def _letters(seed: int) -> tuple[np.ndarray, int]:
    """A random number for each byte, A-Z as a-z, and an odd base."""
    rng = np.random.default_rng(seed)
    table = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    table[65:91] = table[97:123]
    return table, int(rng.integers(1, 2**62)) * 2 + 1


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.ones((2, size), np.uint64)
        steps[0, 1:] = np.uint64(base)
        steps[1, 1:] = np.uint64(pow(base, -1, 2**64))
        got = tuple(np.cumprod(steps, axis=1))
        if size == SLICE_BYTES + 1:
            _POWERS[base] = got
    return got[0][:n], got[1][:n]


class Words:
    """Words of a slice of documents: 64-bit hash and document of each, and words per document."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, is_word: np.ndarray, seed: int = 1):
        self.n_docs = len(offs) - 1
        inside = is_word[raw]
        edge = inside.copy()
        bounds = offs[(offs > 0) & (offs < len(raw))]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        starts[bounds] = inside[bounds]
        edge[:-1] &= ~inside[1:]
        edge[bounds - 1] = inside[bounds - 1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(edge) + 1
        table, base = _letters(seed)
        power, inverse = _powers(base, len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(table[raw] * power[: len(raw)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start])
        self.first = np.searchsorted(self.start, offs)  # of each document, and the end
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first words of all windows of so many words, and the windows' hashes."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h *= np.uint64(0xD6E8FEB86659FD93)
            h += self.hash[k : n + k]
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return at, mix(h[at])


def words(raw: np.ndarray, offs: np.ndarray, is_word: np.ndarray, seed: int = 1) -> Words:
    return Words(raw, offs, is_word, seed)
