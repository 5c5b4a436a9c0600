"""Grouped aggregates. All are algebraic: each task sends one partial row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.functions import lenient_double
from clusterlens.operators.running import running_total

#: Characters of a chunk of joined text.
CHUNK_CHARS = 1 << 15


def sum_by(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    lenient: bool = False,
    alias: str = "total",
) -> DataFrame:
    """Sum per key; ``lenient`` reads text the way X-1 does."""
    v = lenient_double(value) if lenient else F.col(value)
    return df.groupBy(*keys).agg(F.sum(v).alias(alias))


def share_of_total(
    df: DataFrame, keys: Sequence[str], entity: Sequence[str], value: str
) -> DataFrame:
    """Sum per entity and its percentage of the key's total.

    The totals come from the already reduced entity sums and are joined back, so that a hot
    key is never gathered into one window partition.
    """
    per_entity = df.groupBy(*keys, *entity).agg(F.sum(value).alias("amount"))
    totals = per_entity.groupBy(*keys).agg(F.sum("amount").alias("total"))
    return per_entity.join(totals, on=list(keys)).select(
        *keys,
        *entity,
        "amount",
        "total",
        (
            F.try_divide(F.col("amount").cast("double"), F.col("total").cast("double"))
            * F.lit(100.0)
        ).alias("pct"),
    )


def distinct_drift(
    df: DataFrame, keys: Sequence[str], value: str, more_than: int = 1
) -> DataFrame:
    """Keys that hold more than one distinct value, and how many."""
    counted = df.groupBy(*keys).agg(F.countDistinct(value).alias("variations"))
    return counted.filter(F.col("variations") > more_than)


def count_distinct(
    df: DataFrame, keys: Sequence[str], col: str, alias: str = "n"
) -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct(col).alias(alias))


def max_of(df: DataFrame, keys: Sequence[str], value: str, alias: str = "peak") -> DataFrame:
    return df.groupBy(*keys).agg(F.max(value).alias(alias))


def value_counts(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Rows per value."""
    return df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """One row per key and distinct value: rows, so no key becomes one huge array."""
    return df.select(*keys, col).distinct()


def status_counts(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many results are critical, warning, missing and passed."""
    return results.groupBy(*keys).agg(
        *[
            F.count_if(F.col("status") == status).alias(name)
            for status, name in [
                ("CRITICAL", "n_critical"),
                ("WARNING", "n_warning"),
                ("DATA MISSING", "n_missing"),
                ("PASS", "n_pass"),
            ]
        ]
    )


def join_text(
    df: DataFrame, keys: Sequence[str], col: str, sep: str = ", ", chunk_chars: int = CHUNK_CHARS
) -> DataFrame:
    """Distinct texts of a key in order, joined, as numbered chunks with their number of texts."""
    names = distinct_values(df.filter(F.col(col).isNotNull()), keys, col)
    return text_chunks(names, keys, col, [col], sep, chunk_chars)


def text_chunks(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    order: Sequence[str],
    sep: str = ", ",
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """Texts of a key in order, joined: keys, chunk (from 0), n, text. ``order`` tells the rows apart.

    Nothing is left out, and no cell is unbounded: a text belongs to the chunk in which the texts before
    it end, so a chunk has ``chunk_chars`` characters and one text at most.
    """
    size = F.char_length(col) + len(sep)
    rows = running_total(df.select(*dict.fromkeys([*keys, *order, col])), keys, order, size, "before")
    chunk = F.floor(F.col("before") / F.lit(chunk_chars)).alias("chunk")
    item = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(col).alias("item"))
    parts = rows.select(*keys, chunk, item.alias("row")).groupBy(*keys, "chunk")
    return parts.agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_list("row")).getField("item"), sep).alias("text"),
    )
