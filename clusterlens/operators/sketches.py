"""Quantiles from stored sketches: a value is read once, when its run is judged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Accuracy of a sketch: ranks are off by about 2.3 / K ** 0.9 at most, and not at all up to K values.
K = 1024


def quantile_sketch(df: DataFrame, keys: Sequence[str], value: str, k: int = K) -> DataFrame:
    """One sketch per key, of bounded size however many values there are; partial sketches leave each task."""
    x = F.col(value).cast("double")
    return df.filter(x.isNotNull()).groupBy(*keys).agg(F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of coarser keys, out of stored ones: of snapshots, of runs, of a whole fleet."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantile(sketches: DataFrame, keys: Sequence[str], quantile: float, alias: str = "q") -> DataFrame:
    """The quantile of each key's sketch."""
    return sketches.select(*keys, F.kll_sketch_get_quantile_double("sketch", F.lit(float(quantile))).alias(alias))
