"""Connected components of an edge table, by alternating large and small stars.

In each round every vertex links its larger neighbours, then its smaller ones, to the least vertex
it knows. All edges end at the least vertex of their component. Rounds are written to the shared
folder; groups are never gathered, a vertex sends one minimum per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.llm.common import staged


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


def components(edges: DataFrame) -> DataFrame:
    """vertex, component for all ends of the edges (u, v); the component is its least vertex."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = staged(edges.filter("u > v").distinct(), "edges")
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        links = F.array(
            F.struct(F.col("u").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
        )
        small = large.join(root, "u").select(F.explode(links).alias("e"))
        small = small.select(F.col("e.a").alias("u"), F.col("e.b").alias("v"))
        edges = staged(small.filter("u > v").distinct(), "edges")
        after = _signature(edges)
        if after == before:
            break
        before = after
    members = edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
