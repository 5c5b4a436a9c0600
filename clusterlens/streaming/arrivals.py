"""Bundles judged as they arrive, with the same jobs as a batch run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clusterlens.plans.pipeline import analyze, ingest_documents
from clusterlens.sources import shared_folder, telemetry_documents

BUNDLE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def judge_arrivals(
    spark: SparkSession,
    folder: str,
    out: str,
    run_prefix: str,
    max_files: int = 1000,
    checkpoint: str | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Watch a folder: every batch of new bundles becomes one run, stored and judged.

    A run is named after its batch and replaces itself, so a batch repeated after a failure leaves
    one copy. ``max_files`` bounds a batch, not the corpus.
    """
    bundles = (
        spark.readStream.format("binaryFile")
        .schema(BUNDLE_SCHEMA)
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
        .select(F.col("path").alias("bundle"), "content")
    )

    def judge(batch: DataFrame, batch_id: int) -> None:
        run_id = f"{run_prefix}-{batch_id}"
        ingest_documents(telemetry_documents(batch), out, run_id)
        analyze(batch.sparkSession, out, run_id)

    writer = bundles.writeStream.foreachBatch(judge).option(
        "checkpointLocation", checkpoint or f"{shared_folder(spark)}/arrivals/{run_prefix}"
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
