"""Series of readings over several runs, for the rules that need more than one snapshot.

The state is a table with one row per entity and metric (``schema.SERIES``). A run's rules read its own rows and
the state that the run before has left; ``advance`` makes the state for the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens import schema as S
from clusterlens.operators.picks import union_results
from clusterlens.operators.series import MOMENTS, advance_series
from clusterlens.rules.metrics import namespace_metrics
from clusterlens.rules.registry import Tables

# Day zero of the forecast axis, and the statistics that rules follow over snapshots.
EPOCH_DAY = "2024-01-01"
SERIES_METRICS = ("fail_key_busy", "client_proxy", "data_used_pct")

#: What a series belongs to, whatever run its readings come from.
ENTITY = ["cluster_id", "node_id", "namespace"]


def days(time: str) -> Column:
    """Days since the start of the calendar that snapshots are counted from."""
    start = F.unix_micros(F.lit(EPOCH_DAY).cast("timestamp"))
    return (F.unix_micros(time) - start).cast("double") / F.lit(86400e6)


def state_of(tables: Tables, metric: str) -> DataFrame | None:
    """The stored series of a metric, if there are any."""
    if "series" not in tables:
        return None
    rows = tables["series"].filter(F.col("metric") == metric)
    return rows.select(*ENTITY, "last_ts", "last_value", "last_rate", *MOMENTS)


def advance(tables: Tables, run_id: str) -> DataFrame:
    """The series after a run, out of its namespace statistics and the series before it."""
    parts = []
    for metric in SERIES_METRICS:
        rows = namespace_metrics(tables, [c for c in S.KEYS if c != "run_id"], x=metric)
        rows = rows.withColumn("day", days("snapshot_ts"))
        after = advance_series(rows, ENTITY, "snapshot_ts", "day", "x", state_of(tables, metric))
        parts.append(after.select(F.lit(run_id).alias("run_id"), *ENTITY, F.lit(metric).alias("metric"),
                                  "last_ts", "last_value", "last_rate", *MOMENTS))
    return union_results(*parts).select(*S.SERIES.names)
