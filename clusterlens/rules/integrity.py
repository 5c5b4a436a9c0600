"""Integrity gate over a result set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterlens import schema as S

RESULT_COLUMNS = ["id", "name", "status", "message", "remediation", "evidence"]


def validate_results(results: DataFrame, keys: Sequence[str] = S.KEYS) -> DataFrame:
    """Results that are not sound, with the reason; an empty DataFrame is a pass.

    Checks the columns at once, then every row: error texts, unknown statuses, and more than one
    row per key and rule.
    """
    absent = [c for c in [*keys, *RESULT_COLUMNS] if c not in results.columns]
    if absent:
        raise ValueError(f"results lack the columns {absent}")
    message = F.coalesce("message", F.lit(""))
    per_rule = results.groupBy(*keys, "id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(
            message.contains("Error") | F.lower(message).contains("no such")
        ).alias("n_error"),
        F.count_if(
            F.col("status").isNull() | ~F.col("status").isin(S.STATUSES)
        ).alias("n_status"),
    )
    problems = F.filter(
        F.array(
            F.when(F.col("n_error") > 0, F.lit("error text")),
            F.when(F.col("n_status") > 0, F.lit("unknown status")),
            F.when(F.col("n") > 1, F.lit("several rows")),
        ),
        lambda p: p.isNotNull(),
    )
    return (
        per_rule.select(*keys, "id", F.array_join(problems, ", ").alias("problem"))
        .filter(F.col("problem") != "")
    )
