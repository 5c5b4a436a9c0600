"""clusterlens: fleet-scale health checks for database clusters on PySpark.

A corpus of diagnostic bundles is read in parallel, flattened into long telemetry
tables, and judged by grouped DataFrame operators: one verdict for every rule and
every ``(run_id, snapshot_ts, cluster_id)``.
"""

from clusterlens.schema import KEYS, RESULT_SCHEMA, TABLES

__all__ = ["KEYS", "RESULT_SCHEMA", "TABLES"]
