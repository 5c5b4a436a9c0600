"""Telemetry documents: snapshot -> cluster -> node -> payload."""

from __future__ import annotations

import gc
import json
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from clusterlens import schema as S
from clusterlens.functions.variants import flatten
from clusterlens.sources.store import staging_folder

# Spellings of a snapshot time beside the ISO ones, and the day that stands for a
# time that cannot be read.
TIME_FORMATS = ["yyyyMMdd_HHmmss", "yyyy-MM-dd HH:mm:ss z", "yyyy/MM/dd HH:mm:ss"]
NO_TIME = "0001-01-02 00:00:00"
DAY_MICROS = 86_400_000_000

#: What opening a file counts for when files are dealt to tasks, in bytes. With Spark's 4 MB a task would hold 32
#: documents of some kilobytes and cost more than they do.
OPEN_BYTES = 64 << 10

#: Files that the driver lists at a time, and folders that it begins with.
LISTED_FILES, FIRST_FOLDERS = 100_000, 32

DOCUMENT_COLUMNS = ["bundle", "member", "json", "error"]
NODE_COLUMNS = ["bundle", "member", "error", "snapshot", "cluster_id", "node_id", "body"]

#: Characters of node texts after which a batch is handed on.
BATCH_CHARS = 16 << 20

SPACE = re.compile(r"[ \t\n\r]*")
DECODER = json.JSONDecoder()

#: Reads the value at a place of a text; gives the value and where it ends.
Reader = Callable[[str, int], tuple[object, int]]


def snapshot_time(text: Column) -> Column:
    """Snapshot time of a free-form text.

    The time is a key, so it is never null: a text that is no time becomes a moment of the first
    days of the calendar, which sorts first; different texts get different moments.
    """
    parsed = F.coalesce(
        F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS]
    )
    base = F.unix_micros(F.lit(NO_TIME).cast("timestamp"))
    fallback = F.timestamp_micros(base + F.pmod(F.xxhash64(text), F.lit(DAY_MICROS)))
    return F.coalesce(parsed, fallback)


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Folders ``name=value`` below a folder that holds nothing else; none for another folder or a pattern."""
    if re.search(r"[*?\[{\\]", path):
        return []
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root) or not fs.getFileStatus(root).isDirectory():
        return []
    found = []
    for x in fs.listStatus(root):
        name = x.getPath().getName()
        if name.startswith(".") or (name.startswith("_") and "=" not in name):
            continue
        if not x.isDirectory() or "=" not in name:
            return []
        found.append(x.getPath().toString())
    return sorted(found)


#: Size of the cache in which Spark keeps listed files of all DataFrames.
LISTINGS = "spark.sql.hive.filesourcePartitionFileCacheSize"


def _text_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("bundle"),
        F.col("_metadata.file_name").alias("member"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").alias("json"),
        F.lit(None).cast("string").alias("error"),
    )


def read_telemetry_json(spark: SparkSession, path: str) -> DataFrame:
    """Already extracted documents, one per file, in the shape of ``telemetry_documents``.

    The driver holds about a kilobyte for each file that it has listed. A folder of folders ``name=value`` is therefore
    read, and staged, some folders at a time, as many as hold ``LISTED_FILES``; any other folder or pattern is listed
    as a whole. The session's cost of opening a file is set here.
    """
    spark.conf.set("spark.sql.files.openCostInBytes", str(OPEN_BYTES))
    folders = _folders(spark, path)
    if len(folders) <= FIRST_FOLDERS:
        return _text_files(spark, path)
    out = f"{staging_folder(spark)}/documents-{uuid.uuid4().hex}"
    at, step = 0, FIRST_FOLDERS
    while at < len(folders):
        kept, seen = spark.conf.get(LISTINGS), Observation()
        spark.conf.set(LISTINGS, "0")
        try:
            part = _text_files(spark, folders[at : at + step])
        finally:
            spark.conf.set(LISTINGS, kept)
        part.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(out)
        at += step
        # Folders may differ, so the next step is at most four times as long.
        step = max(1, min(4 * step, step * LISTED_FILES // max(1, seen.get["n"])))
        schema = part.schema
        del part
        gc.collect()  # the JVM lets a listing go when Python has let its DataFrame go
    return spark.read.schema(schema).parquet(out)


def _after_space(text: str, at: int) -> int:
    return SPACE.match(text, at).end()


def _members_at(text: str, at: int, read: Reader) -> tuple[dict | None, int]:
    """Members of the object that begins here, each value read by ``read``, and where it ends; the
    last of equal names counts. Null for a value that is no object."""
    if text[at : at + 1] != "{":
        return None, DECODER.raw_decode(text, at)[1]
    found: dict = {}
    at = _after_space(text, at + 1)
    if text[at : at + 1] == "}":
        return found, at + 1
    while True:
        if text[at : at + 1] != '"':
            raise json.JSONDecodeError("a member name is missing", text, at)
        name, at = json.decoder.scanstring(text, at + 1)
        at = _after_space(text, at)
        if text[at : at + 1] != ":":
            raise json.JSONDecodeError("a colon is missing", text, at)
        # Half a surrogate pair is no text that Arrow could hold.
        name = name.encode("utf-8", "replace").decode()
        found[name], at = read(text, _after_space(text, at + 1))
        at = _after_space(text, at)
        end = text[at : at + 1]
        if end == "}":
            return found, at + 1
        if end != ",":
            raise json.JSONDecodeError("a comma is missing", text, at)
        at = _after_space(text, at + 1)


#: Where a node's text begins and ends, and whether it holds a number that JSON has no name for.
Place = tuple[int, int, bool]


def _node_at(text: str, at: int) -> tuple[Place, int]:
    """The place of the node that begins here. Its value is read to find the end, and let go."""
    odd: list[str] = []
    _, end = json.JSONDecoder(parse_constant=odd.append).raw_decode(text, at)
    return (at, end, bool(odd)), end


def _node_text(text: str, place: Place) -> str:
    """A node's text as it stands. NaN and the infinities become texts of that name."""
    at, end, odd = place
    return json.dumps(json.JSONDecoder(parse_constant=str).raw_decode(text, at)[0]) if odd else text[at:end]


def _clusters_at(text: str, at: int) -> tuple[dict | None, int]:
    return _members_at(text, at, lambda t, i: _members_at(t, i, _node_at))


def split_document(text: str | None) -> Iterator[tuple[str, str, str | None, str | None]]:
    """(snapshot, cluster, node, node's text) of a document; a cluster without nodes has nulls.

    The document is read once for the places of its nodes, so that the last of equal names is known, and each
    node's text is made when it is asked for: beside the document, memory holds places and one node.
    """
    start = _after_space(text or "", 0)
    snapshots, end = _members_at(text or "", start, _clusters_at)
    if snapshots is None:
        raise ValueError("not a JSON object")
    if _after_space(text, end) != len(text):
        raise json.JSONDecodeError("text after the end of the object", text, end)
    for snapshot, clusters in snapshots.items():
        for cluster, nodes in (clusters or {}).items():
            for node, place in (nodes or {None: None}).items():
                yield snapshot, cluster, node, place and _node_text(text, place)


def _rows(text: str | None, error: str | None) -> Iterator[tuple]:
    """(error, snapshot, cluster, node, node's text) of a document. An error is found before the first
    node is given out, so a document that cannot be read has no nodes."""
    if error is None:
        try:
            nodes = split_document(text)
            first = next(nodes, None)
            if first is not None:
                yield (None, *first)
                yield from ((None, *row) for row in nodes)
            return
        except json.JSONDecodeError as e:
            error = f"not JSON: {e}"
        except (ValueError, RecursionError) as e:
            error = str(e)
    yield (error, None, None, None, None)


def _split_documents(documents: DataFrame) -> DataFrame:
    """One row per node with its own text, so that no value but the document's text is as large as a
    document. Python's reader is used because it gives the text between two places unchanged."""

    def batch_of(part: list[tuple]) -> pa.RecordBatch:
        columns = zip(*part, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=NODE_COLUMNS)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Nodes of many small documents leave in one batch, those of a large one in several.
        for batch in batches:
            part, size = [], 0
            for doc in zip(*[batch.column(c) for c in DOCUMENT_COLUMNS], strict=True):
                bundle, member, text, error = (v.as_py() for v in doc)
                for row in _rows(text, error):
                    part.append((bundle, member, *row))
                    size += len(row[-1] or "")
                    if size >= BATCH_CHARS:
                        yield batch_of(part)
                        part, size = [], 0
            if part:
                yield batch_of(part)

    return documents.select(*DOCUMENT_COLUMNS).mapInArrow(
        split, ", ".join(f"{c} string" for c in NODE_COLUMNS)
    )


def explode_snapshots(documents: DataFrame, run_id: str) -> DataFrame:
    """One row per document, snapshot, cluster and node.

    Documents that cannot be read stay in the result as rows with an ``error`` and no keys, and a
    cluster without nodes as a row without a ``node_id``, so that one pass over the corpus serves
    nodes and rejects alike. Every node is parsed by itself: one that does not fit a VARIANT is a row
    with an ``error`` and its neighbours stay. Of equal names the last one counts at every level;
    the session's option for that is set here. So is the one that stored payloads stay whole: every extractor opens
    them, and putting them together from columns costs more than reading them.
    """
    conf = documents.sparkSession.conf
    conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    conf.set("spark.sql.variant.writeShredding.enabled", "false")
    # A generated column is not written out again where it is used, so filters of the errors do not parse once more.
    parsed = F.explode(F.array(F.try_parse_json("body"))).alias("payload")
    nodes = _split_documents(documents).select("*", parsed)
    unread = F.col("body").isNotNull() & F.col("payload").isNull()
    reason = F.format_string(
        "node %s of cluster %s: its %s bytes hold a value that is no VARIANT (at most 128 MiB, a text "
        "at most 20 MB)",
        "node_id",
        "cluster_id",
        F.octet_length("body").cast("string"),
    )
    return nodes.select(
        F.lit(run_id).alias("run_id"),
        F.when(F.col("snapshot").isNotNull(), snapshot_time(F.col("snapshot"))).alias(
            "snapshot_ts"
        ),
        "cluster_id",
        "node_id",
        "snapshot",
        "bundle",
        "member",
        "payload",
        F.coalesce("error", F.when(unread, reason)).alias("error"),
    )


def reject_documents(exploded: DataFrame) -> DataFrame:
    """Documents that gave no telemetry, with the reason."""
    return exploded.filter(F.col("error").isNotNull()).select("run_id", "bundle", "member", "error")


NODE = [*S.KEYS, "node_id"]


def repeated_nodes(exploded: DataFrame) -> DataFrame:
    """Nodes that several bundles or snapshot names hold, with the ``last`` place of each."""
    nodes = exploded.filter(F.col("error").isNull() & F.col("node_id").isNotNull())
    return (
        nodes.groupBy(*NODE)
        .agg(F.max(F.struct("bundle", "snapshot")).alias("last"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .drop("n")
    )


def latest_nodes(exploded: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Nodes without rejects; of a node that several bundles hold, the last bundle's copy, and within
    a bundle the last of the snapshot names that mean the same time.

    Only the keys are shuffled to find such nodes. They are few, so AQE broadcasts them and the
    payloads stay where they are. A job with several readers stages the ``repeated`` nodes once.
    """
    nodes = exploded.filter(F.col("error").isNull()).drop("error")
    joined = nodes.join(repeated if repeated is not None else repeated_nodes(exploded), NODE, "left")
    return joined.filter(
        F.col("last").isNull() | (F.struct("bundle", "snapshot") == F.col("last"))
    ).drop("last")


def profile_structure(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Which paths, types and sizes occur under the payloads, and on how many nodes."""
    items = nodes.filter(F.col("node_id").isNotNull()).select(
        "cluster_id", "node_id", F.inline(flatten(F.col("payload"), max_depth, inner=True))
    )
    # A node has a path once per snapshot, so partial counts per node keep the shuffle small.
    per_node = items.groupBy("path", "value_type", "cluster_id", "node_id").agg(
        F.max("n_children").alias("n_children")
    )
    return per_node.groupBy("path", F.col("value_type").alias("type")).agg(
        F.max("n_children").alias("n_children"), F.count(F.lit(1)).alias("n_nodes")
    )
