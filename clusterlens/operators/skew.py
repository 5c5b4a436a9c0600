"""Skew, deviation, monopoly and volume checks over one metric, grouped by any keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens import schema as S


def mean_skew(
    df: DataFrame,
    keys: Sequence[str],
    entity: str,
    value: str,
    factor: float = 2.0,
    floor: float = 100.0,
) -> DataFrame:
    """Is the largest value above ``factor`` times the mean and above ``floor``?

    Some value passes both tests exactly when the largest one does.
    """
    rows = df.filter(F.col(value).isNotNull())
    worst = F.min(F.struct((-F.col(value)).alias("neg"), F.col(entity)))
    out = rows.groupBy(*keys).agg(
        F.sum(value).alias("total"),
        F.avg(value).alias("mean"),
        F.max(value).alias("peak"),
        F.count(F.lit(1)).alias("n_rows"),
        worst.getField(entity).alias("worst"),
    )
    skewed = (F.col("peak") > F.col("mean") * F.lit(float(factor))) & (
        F.col("peak") > F.lit(float(floor))
    )
    return out.withColumn(
        "status", F.when(skewed, F.lit(S.WARNING)).otherwise(F.lit(S.PASS))
    )


def deviation_skew(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    min_avg: float = 1000.0,
    max_dev_pct: float = 10.0,
    min_rows: int = 2,
) -> DataFrame:
    """Largest deviation from the mean in percent, and whether it counts as skew.

    The largest absolute deviation is at the minimum or the maximum, so one pass of
    min, max and mean gives it.
    """
    out = df.groupBy(*keys).agg(
        F.count(value).alias("n_rows"),
        F.avg(value).alias("mean"),
        F.greatest(F.max(value) - F.avg(value), F.avg(value) - F.min(value)).alias("dev"),
    )
    dev_pct = F.try_divide(F.col("dev"), F.col("mean")) * F.lit(100.0)
    judged = (F.col("n_rows") >= min_rows) & (F.col("mean") >= F.lit(float(min_avg)))
    return out.select(
        *keys,
        "n_rows",
        "mean",
        dev_pct.alias("dev_pct"),
        F.coalesce(judged & (dev_pct > F.lit(float(max_dev_pct))), F.lit(False)).alias("skewed"),
    )


def share_monopoly(
    df: DataFrame,
    keys: Sequence[str],
    entity: str,
    value: str,
    max_pct: int = 80,
    min_amount: int = 100,
) -> DataFrame:
    """Does one entity hold more than ``max_pct`` percent of the key's total?

    The share is truncated to an integer before the test, so 80.9 % is not above 80.
    """
    per_entity = df.groupBy(*keys, entity).agg(F.sum(value).alias("amount"))
    top = F.min(F.struct((-F.col("amount")).alias("neg"), F.col(entity)))
    out = per_entity.groupBy(*keys).agg(
        F.sum("amount").alias("total"), top.alias("top"), F.count(F.lit(1)).alias("n_entities")
    )
    amount = -F.col("top.neg")
    pct = (
        F.try_divide(amount.cast("double"), F.col("total").cast("double")) * F.lit(100.0)
    ).cast("bigint")
    out = out.select(
        *keys,
        "total",
        "n_entities",
        F.col(f"top.{entity}").alias("top_entity"),
        amount.alias("top_amount"),
        pct.alias("top_pct"),
    )
    monopoly = (F.col("top_pct") > max_pct) & (F.col("top_amount") > min_amount)
    return out.withColumn(
        "status",
        F.when(monopoly, F.lit(S.WARNING)).otherwise(F.lit(S.PASS)),
    )


def sum_limit(
    df: DataFrame, keys: Sequence[str], value: str, limit: float | None
) -> DataFrame:
    """Sum per key; WARNING above the limit, always PASS without one."""
    out = df.groupBy(*keys).agg(F.sum(value).alias("total"))
    over = F.col("total") > F.lit(float(limit)) if limit is not None else F.lit(False)
    return out.withColumn(
        "status", F.when(over, F.lit(S.WARNING)).otherwise(F.lit(S.PASS))
    )
