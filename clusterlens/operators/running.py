"""Running sums over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clusterlens.sources.store import staged


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, alias: str
) -> DataFrame:
    """All rows with the sum of ``amount`` over the rows of their key that come before.

    Rows are dealt by ranges of key and order and stored, so a key that holds a third of all rows is
    summed in many tasks; one row per key and task then tells each task what the tasks before it have.
    """
    sized = df.withColumn("_amount", amount)
    dealt = sized.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    dealt = staged(dealt, "ranges")
    in_part = Window.partitionBy("_part", *keys).orderBy(*order)
    here = F.sum("_amount").over(in_part.rowsBetween(Window.unboundedPreceding, -1))
    parts = dealt.groupBy(*keys, "_part").agg(F.sum("_amount").alias("_sum"))
    over_parts = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_carried", F.sum("_sum").over(over_parts)).drop("_sum")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*keys, "_part"]]
    rows = dealt.withColumn("_here", here).alias("r").join(parts.alias("p"), same)
    before = F.coalesce("_here", F.lit(0)) + F.coalesce("_carried", F.lit(0))
    return rows.select(*[F.col(f"r.{c}") for c in df.columns], before.alias(alias))
