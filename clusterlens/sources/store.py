"""Parquet tables of runs, and staging in the cluster's shared folder.

A store is a folder with one folder per table and a table of commits. Every writing puts its rows under
an attempt of its own, ``<table>/attempt=<attempt>``; what a run consists of is said by its last commit, one
small row that maps tables to attempts and is written when all of them are complete. Readers open
the attempts that commits name and nothing else, so a run is seen whole or as it was before, whatever fails on
the way, and a writing that was given up is never seen.
"""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterlens import schema as S

#: Sorting a file by this column lets row groups be skipped by metric name.
CLUSTER_BY = {
    "node_stats": ["metric"],
    "namespace_stats": ["metric"],
    "node_configs": ["config_name"],
    "system_info": ["metric"],
    "set_stats": ["key"],
}

_SCHEMAS = {
    **S.TABLES,
    "static_configs": S.STATIC_CONFIGS,
    "coverage": S.COVERAGE,
    "metric_names": S.METRIC_NAMES,
    "series": S.SERIES,
    "sketches": S.SKETCHES,
    "results": S.RESULT_SCHEMA,
    "catalog_results": S.RESULT_SCHEMA,
    "findings": S.FINDING_SCHEMA,
    "finding_texts": S.TEXT_SCHEMA,
}

_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: ``spark.checkpoint.dir``.

    Where it is unset a local session makes a folder of its own; a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="clusterlens-")
    return _LOCAL_FOLDERS[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """The DataFrame written to the shared folder and read back: lineage ends there.

    Unlike a cache it survives lost executors, and unlike recomputation it is paid once.
    """
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staging_folder(spark: SparkSession) -> str:
    """Where this application stages its results."""
    return f"{shared_folder(spark)}/staged/{spark.sparkContext.applicationId}"


def drop_staged(spark: SparkSession) -> None:
    """Delete what this application has staged; DataFrames that read it are of no use afterwards."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(staging_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Tables that are not made by plug-ins.
TABLE_NAMES = tuple(_SCHEMAS)

#: Tables whose names of metrics are stored with them.
NAMED = ("node_stats", "namespace_stats")

#: One row per commit: the attempts that a run's tables consist of from then on.
COMMITS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("attempts", T.MapType(T.StringType(), T.StringType())),
    ]
)


def new_attempt() -> str:
    return f"a-{uuid.uuid4().hex}"


def attempt_path(path: str, table: str, attempt: str) -> str:
    return f"{path.rstrip('/')}/{table}/attempt={attempt}"


def write_attempt(
    df: DataFrame, path: str, table: str, run_id: str, attempt: str, fmt: str = "parquet"
) -> None:
    """Rows of one run, not yet part of it."""
    rows = df.filter(F.col("run_id") == run_id)
    order = CLUSTER_BY.get(table)
    if order:
        rows = rows.sortWithinPartitions(*order)
    rows.write.format(fmt).save(attempt_path(path, table, attempt))


def read_attempt(
    spark: SparkSession,
    path: str,
    table: str,
    attempts: Sequence[str],
    fmt: str = "parquet",
    beside: Sequence[str] = (),
) -> DataFrame:
    """Rows of some attempts. The columns of a plug-in's table come from their files and those ``beside``."""
    paths = [attempt_path(path, table, a) for a in attempts]
    schema = _SCHEMAS.get(table)
    if schema is None:
        every = [attempt_path(path, table, a) for a in dict.fromkeys([*attempts, *beside])]
        schema = spark.read.option("mergeSchema", "true").format(fmt).load(every).schema
    return spark.read.schema(schema).format(fmt).load(paths)


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """All commits; a store without any is empty."""
    try:
        return spark.read.schema(COMMITS).json(f"{path.rstrip('/')}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMITS)


def committed(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """Tables and their attempts of each run, in the order in which runs were first committed."""
    rows = _commits(spark, path).groupBy("run_id").agg(
        F.min("seq").alias("first"), F.max_by("attempts", F.struct("seq", F.to_json("attempts"))).alias("attempts")
    )
    return {r["run_id"]: r["attempts"] for r in sorted(rows.collect(), key=lambda r: r["first"])}  # one row per run


def commit(
    spark: SparkSession, path: str, run_id: str, attempts: Mapping[str, str], replace: bool = False
) -> None:
    """Make attempts the run's tables, beside those it has or instead of them. This is one file."""
    known = {} if replace else committed(spark, path).get(run_id, {})
    last = _commits(spark, path).agg(F.max("seq")).first()[0] or 0
    row = [(run_id, max(last + 1, time.time_ns()), {**known, **attempts})]
    spark.createDataFrame(row, COMMITS).coalesce(1).write.mode("append").json(f"{path.rstrip('/')}/commits")


def write_tables(tables: Mapping[str, DataFrame], path: str, run_id: str) -> None:
    """Tables of a run in one commit; a re-run replaces them, also when they have no rows any more."""
    attempt = new_attempt()
    for table, df in tables.items():
        write_attempt(df, path, table, run_id, attempt)
    for df in tables.values():
        commit(df.sparkSession, path, run_id, dict.fromkeys(tables, attempt))
        break


def read_parquet_tables(
    spark: SparkSession,
    path: str,
    run_ids: Sequence[str] | None = None,
    names: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Stored tables of all committed runs, or of some; files of others are not even listed.

    ``names`` may hold tables of plug-ins. A table that no run has ever stored is left out; one that only other
    runs have is there without rows. The dictionary of metric names is given for a table if it was made with the
    files that are read, in every run; a table that was stored again by itself has none.
    """
    runs = committed(spark, path)
    tables: dict[str, DataFrame] = {}
    for name in names or _SCHEMAS:
        attempts = {run: a[name] for run, a in runs.items() if name in a}
        if not attempts:
            continue
        wanted = [a for run, a in attempts.items() if run_ids is None or run in run_ids]
        df = read_attempt(spark, path, name, wanted or list(attempts.values()), beside=list(attempts.values()))
        tables[name] = df if wanted else df.limit(0)
    if "metric_names" in tables:
        read = [a for run, a in runs.items() if run_ids is None or run in run_ids]
        own = [t for t in NAMED if all(a.get("metric_names") == a[t] for a in read if t in a)]
        tables["metric_names"] = tables["metric_names"].filter(F.col("table_name").isin(own))
    return tables


def write_findings(
    results: DataFrame, path: str, run_id: str, fmt: str = "parquet", table: str = "results"
) -> None:
    """Results of one run as Parquet or JSON; a re-run replaces them."""
    attempt = new_attempt()
    write_attempt(results, path, table, run_id, attempt, fmt)
    commit(results.sparkSession, path, run_id, {table: attempt})


def read_results(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Results of all committed runs."""
    attempts = [a["results"] for a in committed(spark, path).values() if "results" in a]
    if not attempts:
        return spark.createDataFrame([], S.RESULT_SCHEMA)
    return read_attempt(spark, path, "results", attempts, fmt)
