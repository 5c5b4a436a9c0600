"""Table and result schemas."""

from __future__ import annotations

from pyspark.sql import types as T

#: One verdict per run, snapshot and cluster.
KEYS = ["run_id", "snapshot_ts", "cluster_id"]

PASS = "PASS"
WARNING = "WARNING"
CRITICAL = "CRITICAL"
DATA_MISSING = "DATA MISSING"
SCHEMA_MISMATCH = "SCHEMA MISMATCH"
STATUSES = [PASS, WARNING, CRITICAL, DATA_MISSING, SCHEMA_MISMATCH]

_KEY_FIELDS = [
    T.StructField("run_id", T.StringType()),
    T.StructField("snapshot_ts", T.TimestampType()),
    T.StructField("cluster_id", T.StringType()),
]


def _table(**fields: T.DataType) -> T.StructType:
    return T.StructType(_KEY_FIELDS + [T.StructField(n, t) for n, t in fields.items()])


_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()

#: Long tables written by the ingest, all of them keyed by KEYS first.
TABLES: dict[str, T.StructType] = {
    "cluster_metadata": _table(key=_S, value=_S, n_values=_L),
    "node_stats": _table(node_id=_S, metric=_S, value=_S, value_type=_S),
    "namespace_stats": _table(node_id=_S, namespace=_S, metric=_S, value=_D, source=_S),
    "set_stats": _table(node_id=_S, ns=_S, set_name=_S, key=_S, value=_S),
    "security_stats": _table(node_id=_S, user=_S, connections=_L),
    "node_configs": _table(node_id=_S, config_name=_S, value=_S, source=_S),
    "active_features": _table(node_id=_S, feature=_S),
    "system_info": _table(node_id=_S, metric=_S, value=_S),
}

#: Supplied by the caller, never by the ingest.
STATIC_CONFIGS = _table(node_id=_S, config_name=_S, value=_S)

#: How many rows and nodes each telemetry table holds for a snapshot of a cluster. One row per table
#: and key, so a rule can tell "no such table" from "no such metric" without scanning the tables.
COVERAGE = _table(table_name=_S, n_rows=_L, n_nodes=_L)

#: Distinct metric names per table, so that a LIKE becomes an IN list that Parquet can prune by.
METRIC_NAMES = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("metric", T.StringType()),
    ]
)

RESULT_SCHEMA = _table(
    id=_S, name=_S, status=_S, message=_S, remediation=_S, evidence=T.MapType(_S, _D)
)

FINDING_SCHEMA = _table(id=_S, entity=_S, detail=_S, score=_D)

#: All findings of a rule as text, in numbered chunks.
TEXT_SCHEMA = _table(id=_S, chunk=_L, n=_L, text=_S)

#: What later runs need of a series of readings: one row per entity and metric. ``last_rate`` is the
#: growth per second that led to the last reading; the moments are those of a straight line, days over
#: readings: number, means, and sums of squares and products around the means.
SERIES = T.StructType(
    [
        T.StructField("run_id", _S),
        T.StructField("cluster_id", _S),
        T.StructField("node_id", _S),
        T.StructField("namespace", _S),
        T.StructField("metric", _S),
        T.StructField("last_ts", T.TimestampType()),
        T.StructField("last_value", _D),
        T.StructField("last_rate", _D),
        T.StructField("n", _L),
        T.StructField("mean_x", _D),
        T.StructField("mean_y", _D),
        T.StructField("sxx", _D),
        T.StructField("sxy", _D),
    ]
)

#: Quantile sketches of a statistic over the nodes and namespaces of a snapshot; they merge over runs.
SKETCHES = _table(metric=_S, sketch=T.BinaryType())
