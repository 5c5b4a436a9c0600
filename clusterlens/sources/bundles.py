"""Diagnostic bundles: archives with one telemetry document each.

Archives are read with Spark's binaryFile source and opened in the executors, one row at a time;
Arrow batches there are bounded in bytes. Python does nothing but undo the compression.
"""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What marks a telemetry member, a compressed one, and the kinds of members.
TELEMETRY_TEXT = ".json"
DECOY_TEXT = "manifest"
ZIP_SUFFIX = ".zip"
GZIP_MAGIC = b"\x1f\x8b"
TELEMETRY_SUFFIX = "ascinfo.json"
CONFIG_SUFFIX = ".conf"
LOG_SUFFIX = ".log"
CATEGORIES = ["telemetry", "configs", "logs", "other"]

MEMBER_SCHEMA = "bundle string, ord bigint, member string, size bigint, error string"
DOCUMENT_SCHEMA = "bundle string, member string, size bigint, json string, error string"

#: Longest archive that fits a row of Spark, which ends at 2 GB with all its columns.
LONGEST_ARCHIVE = 2**31 - 2**20

#: Bytes of texts or archives after which a batch is handed on.
BATCH_BYTES = 16 << 20
#: Members after which a batch is handed on.
BATCH_MEMBERS = 10_000


def read_bundles(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Archives of a folder or glob, as (bundle, content).

    An archive that is too long for one binary value would stop the whole read. Such an archive is
    listed by its name alone, with a null content, and ends among the rejects.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path).withColumnRenamed("path", "bundle")
    longest = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(2**31 - 1)))
    # The length is a filter of the scan, so the content of a longer archive is not asked for.
    fits = F.col("length") <= min(longest, LONGEST_ARCHIVE)
    return (
        files.filter(fits)
        .select("bundle", "content")
        .unionByName(files.filter(~fits).select("bundle", F.lit(None).cast("binary").alias("content")))
    )


def is_candidate(name: str) -> bool:
    low = name.lower()
    return TELEMETRY_TEXT in low and DECOY_TEXT not in low


def decode_member(name: str, data: bytes) -> str:
    """Text of a member that may be zipped, gzipped or both."""
    if name.endswith(ZIP_SUFFIX):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            data = z.read(z.namelist()[0])
    if data.startswith(GZIP_MAGIC):
        data = gzip.decompress(data)
    return data.decode("utf-8")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for bundle, content in zip(batch.column("bundle"), batch.column("content"), strict=True):
            yield bundle.as_py(), content.as_py()


def _archive(content: bytes | None) -> tarfile.TarFile:
    if content is None:
        raise OverflowError("the archive is too long to be read as one value")
    return tarfile.open(fileobj=io.BytesIO(content), mode="r:*")


def _batch(columns: dict[str, tuple[pa.DataType, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=t) for t, values in columns.values()], names=list(columns)
    )


def list_members(bundles: DataFrame) -> DataFrame:
    """Members of every archive, without their content; an unreadable archive is one error row."""

    def batch_of(part: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
        names = ("bundle", "ord", "member", "size", "error")
        return _batch(dict(zip(names, zip(types, map(list, zip(*part, strict=True)), strict=True), strict=True)))

    def open_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        for bundle, content in _rows(batches):
            try:
                with _archive(content) as tar:
                    for n, m in enumerate(tar):
                        part.append((bundle, n, m.name, m.size, None))
            except Exception as e:  # a broken archive must not stop the corpus
                part.append((bundle, None, None, None, f"{type(e).__name__}: {e}"))
            if len(part) >= BATCH_MEMBERS:
                yield batch_of(part)
                part = []
        if part:
            yield batch_of(part)

    return bundles.select("bundle", "content").mapInArrow(open_each, MEMBER_SCHEMA)


def pick_telemetry(members: DataFrame) -> DataFrame:
    """The telemetry member of every bundle: the largest candidate, the first one on ties."""
    name = F.lower("member")
    candidates = members.filter(name.contains(TELEMETRY_TEXT) & ~name.contains(DECOY_TEXT))
    best = F.min(F.struct((-F.col("size")).alias("neg"), "ord", "member"))
    return (
        candidates.groupBy("bundle")
        .agg(best.alias("best"))
        .select("bundle", "best.ord", "best.member", (-F.col("best.neg")).alias("size"))
    )


def telemetry_documents(bundles: DataFrame) -> DataFrame:
    """One row per bundle: its decoded telemetry text, or the reason why there is none.

    A bundle is one row already, so choosing its member (as ``pick_telemetry`` does over listed
    members) and decoding it happen where the archive is open: nothing is shuffled, no other
    member is unpacked into a row, and the corpus is read once.
    """

    def open_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bundle, content in _rows(batches):
            name = size = text = error = None
            try:
                with _archive(content) as tar:
                    found = [m for m in tar.getmembers() if is_candidate(m.name)]
                    if found:
                        member = max(found, key=lambda m: m.size)
                        name, size = member.name, member.size
                        text = decode_member(name, tar.extractfile(member).read())
                    else:
                        error = "no telemetry member"
            except Exception as e:  # a broken archive must not stop the corpus
                error = f"{type(e).__name__}: {e}"
            yield _batch(
                {
                    "bundle": (pa.string(), [bundle]),
                    "member": (pa.string(), [name]),
                    "size": (pa.int64(), [size]),
                    "json": (pa.string(), [text]),
                    "error": (pa.string(), [error]),
                }
            )

    return bundles.select("bundle", "content").mapInArrow(open_each, DOCUMENT_SCHEMA)


def member_category(member: Column, log_names: Sequence[str] = ()) -> Column:
    """Kind of a member by its name.

    ``log_names`` are log file names of the server: a rotated file holds one somewhere in its name
    and no longer ends like a log.
    """
    name = F.lower(member)
    is_log = name.endswith(LOG_SUFFIX)
    for log_name in log_names:
        is_log = is_log | name.contains(log_name.lower())
    return (
        F.when(name.endswith(TELEMETRY_SUFFIX), F.lit("telemetry"))
        .when(name.endswith(CONFIG_SUFFIX), F.lit("configs"))
        .when(is_log, F.lit("logs"))
        .otherwise(F.lit("other"))
    )


def bundle_inventory(members: DataFrame, log_names: Sequence[str] = ()) -> DataFrame:
    """Members of each kind per bundle."""
    rows = members.filter(F.col("member").isNotNull())
    kinds = rows.select("bundle", member_category(F.col("member"), log_names).alias("category"))
    return kinds.groupBy("bundle").agg(
        *[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES]
    )
