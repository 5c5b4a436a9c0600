"""Statistics per node and namespace, whatever spelling they are reported under."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens.operators.filters import metric_in
from clusterlens.operators.picks import union_results
from clusterlens.operators.sketches import K, quantile_sketch
from clusterlens.rules.core import first_alias, number
from clusterlens.rules.registry import Tables


def namespace_names(*metrics: str) -> list[str]:
    """Spellings of a namespace statistic."""
    return [p + m for m in metrics for p in ("service.", "")]


def namespace_metrics(tables: Tables, keys: Sequence[str], **metrics: str) -> DataFrame:
    """Several statistics per node and namespace side by side, from one scan."""
    wanted = {alias: namespace_names(m) for alias, m in metrics.items()}
    rows = metric_in(tables["namespace_stats"], [n for names in wanted.values() for n in names])
    value = number(rows)
    return rows.groupBy(*keys, "node_id", "namespace").agg(
        *[first_alias(names, value, F.max).alias(alias) for alias, names in wanted.items()]
    )


def metric_sketches(tables: Tables, keys: Sequence[str], metrics: Sequence[str], k: int = K) -> DataFrame:
    """Quantile sketches of some statistics over the nodes and namespaces of each key."""
    parts = []
    for metric in metrics:
        sketch = quantile_sketch(namespace_metrics(tables, keys, x=metric), keys, "x", k)
        parts.append(sketch.select(*keys, F.lit(metric).alias("metric"), "sketch"))
    return union_results(*parts)
