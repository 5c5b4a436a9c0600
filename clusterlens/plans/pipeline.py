"""The jobs: bundles to tables, tables to verdicts, and verdicts to the datasets of a report.

Each ends in one commit of its run (``sources.store``): readers see all of its tables, or none of them.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from clusterlens import report, rules
from clusterlens import schema as S
from clusterlens.extract import EXTRACTORS, run_extractors
from clusterlens.rules import coverage, metric_names, run_all, series
from clusterlens.rules.core import ENTITY_RULE_TABLES
from clusterlens.rules.metrics import metric_sketches
from clusterlens.rules.registry import REGISTRY
from clusterlens.rules.runner import COVERED
from clusterlens.sources import (
    explode_snapshots,
    latest_nodes,
    read_bundles,
    read_parquet_tables,
    reject_documents,
    repeated_nodes,
    staged,
    telemetry_documents,
)
from clusterlens.sources.store import (
    NAMED,
    TABLE_NAMES,
    attempt_path,
    commit,
    committed,
    new_attempt,
    read_attempt,
    write_attempt,
)

log = logging.getLogger(__name__)


def ingest_documents(
    documents: DataFrame,
    out: str,
    run_id: str,
    extractors: Mapping | None = None,
    static_configs: DataFrame | None = None,
) -> None:
    """Documents to stored tables, beside the settings that are meant to be in force, if given.

    The exploded nodes are written once, with parsed payloads; every extractor then reads that
    table instead of the archives, and the nodes held several times are found once for all of
    them. Executors may come and go: each step starts from stored files. A failure leaves the run as it was. A
    plug-in's extractor is a job of its own: if that fails, its table has no rows and the others go on.
    """
    spark = documents.sparkSession
    attempt = new_attempt()
    nodes_path = attempt_path(out, "nodes", attempt)
    exploded = explode_snapshots(documents, run_id)
    exploded.write.parquet(nodes_path)
    exploded = spark.read.schema(exploded.schema).parquet(nodes_path)

    repeated = staged(repeated_nodes(exploded), "repeated")
    nodes = latest_nodes(exploded, repeated)
    tables = run_extractors(nodes, extractors)
    attempts: dict[str, str] = {"nodes": attempt}

    def nothing(table: str) -> DataFrame:
        schema = S.TABLES.get(table)
        return spark.createDataFrame([], schema) if schema else nodes.select(*S.KEYS).limit(0)

    for table in extractors or EXTRACTORS:
        attempts[table] = attempt
        # A table whose extractor failed has no rows in this run, whatever an earlier one has stored.
        df = tables.get(table)
        try:
            write_attempt(nothing(table) if df is None else df, out, table, run_id, attempt)
        except Exception as e:
            if table in S.TABLES:
                raise
            log.warning("extractor of %s failed: %s", table, e)
            attempts[table] = new_attempt()
            write_attempt(nothing(table), out, table, run_id, attempts[table])
    more = {"rejects": reject_documents(exploded)}
    if static_configs is not None:
        more["static_configs"] = static_configs
    for table, df in more.items():
        write_attempt(df, out, table, run_id, attempt)
        attempts[table] = attempt
    # Rows per table and cluster, from key columns alone, let rules tell a missing table from a missing metric.
    stored = {t: read_attempt(spark, out, t, [a]) for t, a in attempts.items() if t in COVERED}
    write_attempt(coverage(stored), out, "coverage", run_id, attempt)
    names = {t: stored[t] for t in NAMED if attempts.get(t) == attempt}
    if names:
        write_attempt(metric_names(names), out, "metric_names", run_id, attempt)
        attempts["metric_names"] = attempt
    attempts["coverage"] = attempt
    commit(spark, out, run_id, attempts, replace=True)


def ingest(
    spark: SparkSession,
    bundles: str,
    out: str,
    run_id: str,
    static_configs: DataFrame | None = None,
) -> None:
    """A corpus of bundles to the stored tables of one run."""
    documents = telemetry_documents(read_bundles(spark, bundles))
    ingest_documents(documents, out, run_id, static_configs=static_configs)


def series_before(spark: SparkSession, out: str, run_id: str) -> DataFrame | None:
    """What the runs before this one have left of their series: the state of the last of them."""
    attempt = None
    for run, attempts in committed(spark, out).items():
        if run == run_id:
            break
        attempt = attempts.get("series", attempt)
    return None if attempt is None else read_attempt(spark, out, "series", [attempt])


def analyze(
    spark: SparkSession,
    out: str,
    run_id: str,
    catalog_params: Mapping[str, Mapping] | None = None,
    sketch_metrics: Sequence[str] = (),
    **options,
) -> DataFrame:
    """All rules over the stored tables of a run, with the series that earlier runs have left.

    Stored beside them in one commit: results, results of the catalogue, findings as rows and as text, the
    series for later runs, and quantile sketches of the ``sketch_metrics``. Runs are judged in the order of their
    snapshots; a run that is judged again leaves those after it as they are, ``replay`` judges them again.
    """
    plugged = [*EXTRACTORS, *(r.table for r in REGISTRY.values())]
    names = list(dict.fromkeys([*TABLE_NAMES, *plugged]))
    tables = read_parquet_tables(spark, out, [run_id], [n for n in names if n not in JUDGED])
    before = series_before(spark, out, run_id)
    if before is not None:
        tables["series"] = before
    attempt = new_attempt()

    def store(table: str, df: DataFrame) -> DataFrame:
        write_attempt(df, out, table, run_id, attempt)
        return read_attempt(spark, out, table, [attempt])

    made: dict[str, DataFrame] = {}
    if sketch_metrics and "namespace_stats" in tables:
        made["sketches"] = store("sketches", metric_sketches(tables, S.KEYS, sketch_metrics))
        tables["sketches"] = made["sketches"]
    made["results"] = store("results", run_all(tables, **options))
    made["catalog_results"] = store("catalog_results", rules.run_catalog(tables, params=catalog_params))
    chosen = [i for i, needed in ENTITY_RULE_TABLES.items() if all(t in tables for t in needed)]
    if chosen:
        made["findings"] = store("findings", rules.findings(tables, ids=chosen))
        made["finding_texts"] = store("finding_texts", rules.finding_texts(made["findings"]))
    if "namespace_stats" in tables:
        made["series"] = store("series", series.advance(tables, run_id))
    commit(spark, out, run_id, dict.fromkeys(made, attempt))
    return made["results"]


#: Tables that ``analyze`` makes.
JUDGED = ("results", "catalog_results", "findings", "finding_texts", "series", "sketches")


def replay(spark: SparkSession, out: str, run_id: str, **options) -> None:
    """Judge a run and all runs after it again, so that their series follow."""
    runs = list(committed(spark, out))
    for run in runs[runs.index(run_id) :]:
        analyze(spark, out, run, **options)


def report_run(spark: SparkSession, out: str, run_id: str) -> dict[str, DataFrame]:
    """The datasets of a report over a judged run, stored in one commit and read again."""
    tables = read_parquet_tables(spark, out, [run_id])
    results = tables["results"]
    context = staged(report.cluster_context(tables), "context")
    datasets = {
        "report_context": context,
        "report_assessment": report.assessment(results),
        "report_vitals": report.vitals(results),
        "report_narrative": report.narrative(context),
        "report_issues": report.issues(results),
        "report_appendix": report.appendix(results),
        "report_disk_usage": report.disk_usage(tables["namespace_stats"]),
        "report_connections": report.client_connections(tables["node_stats"]),
        "report_hot_keys": report.hot_key_by_node(tables["namespace_stats"]),
    }
    attempt = new_attempt()
    for table, df in datasets.items():
        write_attempt(df, out, table, run_id, attempt)
    commit(spark, out, run_id, dict.fromkeys(datasets, attempt))
    return read_parquet_tables(spark, out, [run_id], list(datasets))
