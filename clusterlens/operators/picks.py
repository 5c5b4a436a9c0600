"""Deterministic picks: first, last, top and leading rows per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], ranked: Sequence[Column], take) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    order = [c.alias(f"o{i}") for i, c in enumerate(ranked)]
    row = F.struct(*order, *[F.col(c) for c in rest])
    return (
        df.groupBy(*keys)
        .agg(take(row).alias("pick"))
        .select(*keys, *[F.col(f"pick.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Upsert: one row per key, the greatest by ``order``; ties go to the greatest row."""
    return _pick(df, keys, [F.col(o) for o in order], F.max)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by ``order``; ties go to the smallest row."""
    return _pick(df, keys, [F.col(o) for o in order], F.min)


def top1(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str]) -> DataFrame:
    """Row with the highest value per key; ties go to the smallest ``tie`` columns."""
    rows = df.filter(F.col(value).isNotNull())
    return _pick(rows, keys, [-F.col(value), *[F.col(t) for t in tie]], F.min)


def lead_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int
) -> DataFrame:
    """First n rows per key, numbered in ``rn``.

    Spark pushes the rank limit below the shuffle, so each task sends at most n rows per key.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def lead_text(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    order: Sequence[Column | str],
    sep: str = ", ",
    n: int = 20,
    alias: str = "text",
) -> DataFrame:
    """Text of the first n rows per key, in order. The array never holds more than n entries."""
    rows = lead_rows(df.select(*{c: None for c in [*keys, col]}, *_extra(df, keys, col, order)),
                     keys, order, n)
    items = F.array_sort(F.collect_list(F.struct("rn", F.col(col).alias("item"))))
    return rows.groupBy(*keys).agg(F.array_join(items.getField("item"), sep).alias(alias))


def _extra(df: DataFrame, keys, col, order) -> list[str]:
    """All other columns when the order is given as expressions, else only the named ones."""
    if all(isinstance(o, str) for o in order):
        return [o for o in order if o not in keys and o != col]
    return [c for c in df.columns if c not in keys and c != col]


def first_n_names(df: DataFrame, keys: Sequence[str], col: str, n: int = 3) -> DataFrame:
    """The first n distinct names per key, in order, as an array."""
    names = df.filter(F.col(col).isNotNull()).select(*keys, col).distinct()
    rows = lead_rows(names, keys, [col], n)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(col)).alias("names"))


def sort_findings(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Results in the order of their ids, and of the keys within an id.

    The ids are few; the keys let the rows of one id be dealt over many tasks.
    """
    return results.orderBy("id", *keys)


def union_results(*dfs: DataFrame) -> DataFrame:
    """All rule outputs in one DataFrame."""
    return reduce(lambda a, b: a.unionByName(b), dfs)
