"""Line deduplication: lines that several documents hold stay only in the first of them.

Only hashes move. The digests of a document's lines (one row per document and key, with the places
of its lines) are written to the shared folder, range-partitioned by digest and a salt made of the
document, and sorted by digest and document. A streaming window then keeps the first document of
each key and salt: every later row is a repetition. The few first rows of a key, at most one per
salt, go through the same step once more without the salt. So a key held by a third of all
documents is spread over ``SALTS`` groups, and no row meets all others of its key in one task.

What comes back is a bitmap per document, compressed to its runs of kept lines; ``apply_runs`` cuts
a text by them, each run once.

Defined results: null and empty texts are one empty line. A key is a line without ``[ \\t-\\r]`` at
both ends and with A-Z lower-cased; keys of fewer than ``min_chars`` code points are never dropped.
"First" is the smallest document id; an unknown id comes last, and all rows without id count as one
document. Repeated rows of a document get the same bitmap. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clusterlens.llm.common import UPPER, lower_ascii, read, staged

BLANK = " \t\n\x0b\x0c\r"
#: Groups that the documents of one key are dealt to first.
SALTS = 1024


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANK)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_key() -> list[Column]:
    """A document row: its id and the digest of its text."""
    return [F.col("doc_id"), F.xxhash64("text").alias("version")]


def _same_row(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (
        F.col(f"{left}.version") == F.col(f"{right}.version")
    )


def kept_runs(dropped: Column, n_lines: Column) -> Column:
    """The bitmap of kept lines as runs (first, length); ``dropped`` is sorted."""
    before = F.concat(F.array(F.lit(-1)), dropped)
    after = F.concat(dropped, F.array(n_lines))
    runs = F.zip_with(
        before,
        after,
        lambda b, a: F.struct((b + 1).alias("first"), (a - b - 1).alias("length")),
    )
    return F.filter(runs, lambda r: r["length"] > 0)


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """One row per document row that loses lines: doc_id, version, n_dropped, keep (runs)."""
    split = docs.select(*_row_key(), lines_of(F.col("text")).alias("lines"))
    lines = split.select(
        "doc_id", "version", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("at", "line")
    )
    held = staged(
        lines.withColumn("key", line_key(F.col("line")))
        .filter(F.char_length("key") >= min_chars)
        .select(
            F.unhex(F.md5("key")).alias("digest"),
            F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
            "doc_id",
            "version",
            "n_lines",
            "at",
        ),
        "line-digests",
    )
    in_salt = Window.partitionBy("digest", "salt").orderBy(
        F.col("doc_id").asc_nulls_last(), "version", "at"
    )
    stream = in_salt.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = held.repartitionByRange("digest", "salt").withColumn(
        "first", F.first(F.struct("doc_id")).over(stream)
    )
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    # the first document of each key and salt meets those of the other salts
    firsts = (
        near.filter(same)
        .groupBy("digest", "salt", "doc_id")
        .agg(F.collect_list(F.struct("version", "n_lines", "at")).alias("places"))
    )
    order = Window.partitionBy("digest").orderBy(F.col("doc_id").asc_nulls_last())
    late = (
        firsts.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") > 1)
        .select("doc_id", F.explode("places").alias("place"))
        .select("doc_id", "place.version", "place.n_lines", "place.at")
    )
    repeated = near.filter(~same).select("doc_id", "version", "n_lines", "at").unionByName(late)
    dropped = repeated.groupBy("doc_id", "version").agg(
        F.array_sort(F.collect_set("at")).alias("dropped"), F.first("n_lines").alias("n_lines")
    )
    return dropped.select(
        "doc_id",
        "version",
        F.size("dropped").alias("n_dropped"),
        kept_runs(F.col("dropped"), F.col("n_lines")).alias("keep"),
    )


def apply_runs(text: Column, keep: Column) -> Column:
    """The kept lines of a text; without a bitmap the text as it is."""
    lines = lines_of(text)
    kept = F.flatten(F.transform(keep, lambda r: F.slice(lines, r["first"] + 1, r["length"])))
    return F.when(keep.isNull(), text).otherwise(F.array_join(kept, "\n"))


def with_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Each row as a struct ``row``, with n_dropped and keep (null where nothing is dropped)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumns({"doc_id": F.col("row.doc_id"), "version": F.xxhash64("row.text")})
    bitmaps = keep_bitmaps(docs.select("doc_id", "text"), min_chars)
    joined = rows.alias("r").join(bitmaps.alias("b"), _same_row("r", "b"), "left")
    return joined.select("r.row", "b.n_dropped", "b.keep")


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """All columns of ``docs`` (doc_id, text and any others) with the texts cut."""
    rows = with_bitmaps(docs, min_chars)
    cut = apply_runs(F.col("row.text"), F.col("keep"))
    return rows.select(
        *[cut.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and dropped, and the digest of what stays, for every document."""
    rows = with_bitmaps(read(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return rows.select(
        "row.doc_id",
        F.size(lines_of(text)).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(apply_runs(text, F.col("keep")), 256).alias("kept_sha256"),
    )


ORACLE = f"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM cut),
keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
    '{UPPER}', '{UPPER.lower()}') AS key FROM lines),
first_doc AS (
  SELECT key, min(doc_id) AS doc FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (
  SELECT k.doc_id, k.line, k.place, coalesce(f.doc, k.doc_id) = k.doc_id AS stays
  FROM keyed k LEFT JOIN first_doc f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""
