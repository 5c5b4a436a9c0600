"""Merging packed partial results in a tree: a task never reads more than a few of them."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial results that one task merges, on average.
FAN = 16


def tree_merge(
    parts: DataFrame, keys: list[str], merge: Callable[[pa.Table], pa.Table], leaves: int, fan: int = FAN
) -> DataFrame:
    """One row per key out of rows (keys, ``node`` long, more columns), level after level.

    ``node`` is any stored number that spreads rows evenly, ``leaves`` about the greatest number of
    rows of a key. ``merge`` gets the rows of one node, all of one key, and returns rows alike.
    """
    nodes = max(1, leaves)
    while True:
        nodes = -(-nodes // fan)
        dealt = parts.withColumn("node", F.pmod("node", F.lit(nodes)).cast("long"))
        parts = dealt.groupBy(*keys, "node").applyInArrow(merge, parts.schema)
        if nodes == 1:
            return parts
