"""Filters and threshold bands over long entity/metric tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens import schema as S
from clusterlens.functions import contains_any


def metric_in(df: DataFrame, names: Sequence[str], col: str = "metric") -> DataFrame:
    """Rows whose metric is one of the names. Reaches the Parquet scan as an IN filter."""
    return df.filter(F.col(col).isin(list(names)))


def like(col: str, pattern: str) -> Column:
    """Case-insensitive LIKE (``%`` and ``_`` are wildcards).

    With ``_`` in it a pattern becomes a regular expression, which costs microseconds per row. The
    longest plain part of the pattern must occur in every match, so a substring search decides
    nearly all rows first.
    """
    if "_" not in pattern:
        return F.col(col).ilike(pattern)
    part = max(re.split("[%_]+", pattern.lower()), key=len)
    if not part:
        return F.col(col).ilike(pattern)
    return F.lower(col).contains(part) & F.col(col).ilike(pattern)


def like_any(col: str, patterns: Sequence[str]) -> Column:
    """Case-insensitive LIKE on any of the patterns."""
    return reduce(lambda a, b: a | b, [like(col, p) for p in patterns])


def metric_ilike(df: DataFrame, patterns: Sequence[str], col: str = "metric") -> DataFrame:
    """Rows whose metric is LIKE any of the patterns, ignoring case."""
    return df.filter(like_any(col, patterns))


def keep_found(df: DataFrame, found: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose ``on`` values occur in an earlier result."""
    return df.join(found.select(*on).distinct(), on=list(on), how="left_semi")


def drop_names(df: DataFrame, col: str, names: Sequence[str]) -> DataFrame:
    """Rows whose name is not on an ignore list; rows without a name stay."""
    return df.filter(F.col(col).isNull() | ~F.col(col).isin(list(names)))


def drop_patterns(df: DataFrame, col: str, regexes: Sequence[str]) -> DataFrame:
    """Rows whose name holds none of the regular expressions (dots are any character).

    An expression that is a dot and plain text can only match where the text occurs; where all are
    of that kind, a substring search spares most rows the regular expression.
    """
    name = F.col(col)
    hit = name.rlike("|".join(regexes))
    texts = [r[1:] for r in regexes if re.fullmatch(r"\.[\w-]+", r)]
    if len(texts) == len(regexes):
        hit = contains_any(name, texts) & hit
    return df.filter(name.isNull() | ~hit)


def value_matches(df: DataFrame, regex: str, col: str = "value") -> DataFrame:
    """Rows whose value holds the regular expression anywhere."""
    return df.filter(F.col(col).rlike(regex))


def values_differ(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows with two different values; a null on either side drops the row."""
    return df.filter(F.col(a) != F.col(b))


def having(agg_df: DataFrame, cond: Column | str) -> DataFrame:
    """Filter over the result of an aggregation."""
    return agg_df.filter(cond)


def band(value: Column, warn: float, crit: float, strict: bool = False) -> Column:
    """Status of a number: CRITICAL at ``crit``, WARNING at ``warn``, else PASS.

    ``strict`` demands more than the threshold; otherwise reaching it is enough.
    """
    over_crit = value > F.lit(crit) if strict else value >= F.lit(crit)
    over_warn = value > F.lit(warn) if strict else value >= F.lit(warn)
    return (
        F.when(over_crit, F.lit(S.CRITICAL))
        .when(over_warn, F.lit(S.WARNING))
        .otherwise(F.lit(S.PASS))
    )


def threshold_band(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    warn: float,
    crit: float,
    strict: bool = False,
    entity: Sequence[str] = (),
) -> DataFrame:
    """Peak value per key with its status, and the entity that holds the peak.

    Equal peaks go to the smallest entity. The peak is one min over a struct, so every task
    sends one row per key whatever the size of a key.
    """
    rows = df.filter(F.col(value).isNotNull())
    worst = F.min(F.struct((-F.col(value)).alias("neg"), *[F.col(e) for e in entity]))
    out = rows.groupBy(*keys).agg(worst.alias("worst"), F.count(F.lit(1)).alias("n_rows"))
    peak = -F.col("worst.neg")
    return out.select(
        *keys,
        peak.alias("peak"),
        *[F.col(f"worst.{e}").alias(f"worst_{e}") for e in entity],
        "n_rows",
        band(peak, warn, crit, strict).alias("status"),
    )


def with_missing(
    clusters: DataFrame,
    agg_df: DataFrame,
    keys: Sequence[str],
    defaults: Mapping[str, object],
) -> DataFrame:
    """One row for every cluster: silent clusters get the default values."""
    joined = clusters.select(*keys).join(agg_df, on=list(keys), how="left")
    for col, value in defaults.items():
        joined = joined.withColumn(col, F.coalesce(F.col(col), F.lit(value)))
    return joined
