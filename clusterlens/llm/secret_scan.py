"""Secret scans over a content-addressed ledger of versions.

Every version of every path is known by the SHA-256 of its text. The ledger says which pairs of blob
and rule version have been scanned, and with which spans. A run scans only pairs that it does not
hold, each blob once however many paths and versions have it, and joins the spans back to all paths.

Spans are found with built-in functions only: a text split by a pattern gives the pieces between
matches, all matches of the same pattern come from the same engine in the same order, so lengths add
up to places.

Defined results: a null text is an empty text. Rows without an id are paths without a name and keep
their findings. Repeated rows are returned as often as they come. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm.common import read, staged


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if the group has at least so many characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


# fixed values: the patterns of the contract
RULES = [
    Rule(
        "assign",
        1,
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        6,
    ),
    # a run of at least n characters is the same as a whole run that has n characters
    Rule("access", 1, "AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, "[0-9a-f]{24,}", 0, 24),
]

SPAN = "struct<start:int,end:int>"
LEDGER = f"blob string, kind string, version int, spans array<{SPAN}>"


def spans_of(text: Column, rule: Rule) -> Column:
    """Places (code points, end exclusive) of the rule's matches, in order."""
    pattern = F.lit(rule.pattern)
    pieces = F.transform(F.split(text, rule.pattern, -1), lambda x: F.char_length(x))
    matches = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.char_length(x))
    sizes = F.transform(
        F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.char_length(x)
    )
    facts = F.zip_with(
        F.slice(pieces, F.lit(1), F.size(matches)),
        F.zip_with(matches, sizes, lambda n, size: F.struct(n.alias("n"), size.alias("size"))),
        lambda gap, m: F.struct(gap.alias("gap"), m["n"].alias("n"), m["size"].alias("size")),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def add(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        end = start + m["n"]
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        kept = F.when(m["size"] >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    found = F.aggregate(facts, zero, add)["out"]
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def blobs_of(history: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, blob and text of every version."""
    content = F.coalesce(F.col(text), F.lit(""))
    return history.select(
        F.col(path).alias("path"), F.sha2(content, 256).alias("blob"), content.alias("text")
    )


def unseen(blobs: DataFrame, ledger: DataFrame, rules: list[Rule]) -> DataFrame:
    """Blobs that some rule version has not scanned, one path for each, and those rules' kinds."""
    asked = F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules]))
    one = blobs.groupBy("blob").agg(F.min("path").alias("path"))
    pairs = one.select("blob", "path", asked.alias("r")).select("blob", "path", "r.kind", "r.version")
    new = pairs.join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
    return new.groupBy("blob", "path").agg(F.collect_set("kind").alias("kinds"))


def scan(
    history: DataFrame,
    ledger: DataFrame | None = None,
    rules: list[Rule] | None = None,
    path: str = "path",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """New ledger rows, and path, blob and findings (kind, start, end) of every version.

    The new rows are written once, in the shared folder; append them to the ledger for the next run.
    """
    rules = RULES if rules is None else rules
    spark = history.sparkSession
    ledger = empty_ledger(spark) if ledger is None else ledger
    blobs = blobs_of(history, path, text)
    todo = unseen(blobs.select("path", "blob"), ledger, rules)
    texts = blobs.alias("b").join(
        todo.alias("t"),
        (F.col("b.blob") == F.col("t.blob")) & F.col("b.path").eqNullSafe(F.col("t.path")),
    )
    found = F.array(
        *[
            F.when(
                F.array_contains("t.kinds", rule.kind),
                F.struct(
                    F.lit(rule.kind).alias("kind"),
                    F.lit(rule.version).alias("version"),
                    spans_of(F.col("b.text"), rule).alias("spans"),
                ),
            )
            for rule in rules
        ]
    )
    scanned = texts.select("b.blob", F.explode(found).alias("f")).filter("f is not null")
    scanned = scanned.select("blob", "f.kind", "f.version", "f.spans")
    # repeated rows of the one path are scanned alike
    new = staged(scanned.dropDuplicates(["blob", "kind", "version"]), "ledger")
    asked = " or ".join(f"(kind = '{r.kind}' and version = {r.version})" for r in rules)
    known = new.unionByName(ledger).filter(asked).filter(F.size("spans") > 0)
    by_blob = (
        known.select("blob", "kind", F.explode("spans").alias("s"))
        .groupBy("blob")
        .agg(F.collect_set(F.struct("kind", "s.start", "s.end")).alias("findings"))
    )
    paths = blobs.select("path", "blob").join(by_blob, "blob", "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return new, paths.select("path", "blob", F.coalesce("findings", none).alias("findings"))


def findings_text(findings: Column, rules: list[Rule]) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    order = {r.kind: i for i, r in enumerate(rules)}

    def place(kind: Column) -> Column:
        return F.coalesce(*[F.when(kind == k, F.lit(i)) for k, i in order.items()])

    rows = F.array_sort(
        F.transform(
            findings,
            lambda f: F.struct(
                f["start"].alias("start"), place(f["kind"]).alias("at"), f["end"].alias("end"), f["kind"].alias("kind")
            ),
        )
    )
    return F.array_join(
        F.transform(rows, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ","
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; the ledger starts empty."""
    _, found = scan(read(spark, sf_dir, "documents"), path="doc_id")
    spans = findings_text(F.col("findings"), RULES)

    def n(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")

    return found.select(
        F.col("path").alias("doc_id"),
        *[n(r.kind).alias(f"n_{r.kind}") for r in RULES],
        F.sha2(spans, 256).alias("base_sha256"),
        spans.alias("spans"),
    )


def _sql(rule: Rule, rank: int) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, unnest(starts) AS s, unnest(ends) AS e, unnest(sizes) AS size
  FROM (SELECT doc_id, sizes,
      list_transform(range(1, len(m) + 1), lambda i: CAST(list_sum(g[1:i]) + coalesce(list_sum(m[1:i - 1]), 0) AS BIGINT)) AS starts,
      list_transform(range(1, len(m) + 1), lambda i: CAST(list_sum(g[1:i]) + list_sum(m[1:i]) AS BIGINT)) AS ends
    FROM (SELECT doc_id,
        list_transform(regexp_split_to_array(t, '{p}'), lambda x: length(x)) AS g,
        list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x)) AS m,
        list_transform(regexp_extract_all(t, '{p}', {rule.group}), lambda x: length(x)) AS sizes
      FROM d WHERE regexp_matches(t, '{p}')))"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_sql(r, i) for i, r in enumerate(RULES))}),
kept AS (SELECT * FROM found WHERE size >= CASE kind {" ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in RULES)} END),
by_doc AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES)},
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES)},
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN by_doc ON by_doc.doc_id = d.doc_id"""
