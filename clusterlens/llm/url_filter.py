"""URL filters: host and path rules found by hash prefixes.

A rule names a host with all its subdomains and a beginning of the path. Each URL is expanded into
the expressions a rule could have for it: the host's suffixes with as many labels as some rule's
host has, each with the path's beginnings as long as some rule's path is. Expressions meet the rules
on the first ``PREFIX_HEX`` hex digits of their SHA-256, the whole digest confirms, and of all
confirmed rules the longest decides (then the one with the longer host, then block before allow).

Up to ``BROADCAST_RULES`` rules, measured before, go to all tasks. More are joined by shuffles, with the
URLs of one prefix dealt to ``SALTS`` groups, so a host that a third of all pages have is no hot key.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no rule. A URL
that no rule fits is allowed. Rules with null parts are left out, repeated rules count once; without
rules everything is allowed. Repeated rows are returned as often as they come. Only the id and the
URL are read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm.common import lower_ascii, read

PREFIX_HEX = 8
#: Rules of at most ``RULE_CHARS`` characters each; together they are under 20 MB.
BROADCAST_RULES, RULE_CHARS = 50_000, 400
SALTS = 32
DEFAULT = "allow"

# fixed values: the rules of the contract (host, path, verdict)
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _expression(host: Column, path: Column) -> Column:
    """What is hashed; a host holds no slash, so the two parts cannot be confused."""
    return F.concat(host, F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("//"), path)))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _hashed(rules: DataFrame) -> DataFrame:
    """prefix and the rules that share it (digest, length, host length, verdict, rule)."""
    known = rules.dropna().select(
        lower_ascii(F.col("host")).alias("host"), "path", "verdict"
    )
    # of two verdicts on the same rule, block
    known = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.concat("host", "path")
    return (
        known.withColumn("digest", F.sha2(_expression(F.col("host"), F.col("path")), 256))
        .groupBy(F.substring("digest", 1, PREFIX_HEX).alias("prefix"))
        .agg(
            F.collect_list(
                F.struct(
                    "digest",
                    F.char_length(rule).alias("length"),
                    F.char_length("host").alias("host_length"),
                    "verdict",
                    rule.alias("rule"),
                )
            ).alias("rules")
        )
    )


def _shapes(rules: DataFrame) -> dict[int, list[int]]:
    """Path lengths of the rules by number of host labels; as many as rules have shapes."""
    rows = (
        rules.dropna()
        .select(
            F.size(F.split("host", r"\.")).alias("labels"), F.char_length("path").alias("length")
        )
        .distinct()
        .collect()
    )
    out: dict[int, list[int]] = {}
    for r in rows:
        out.setdefault(r["labels"], []).append(r["length"])
    return {k: sorted(v) for k, v in sorted(out.items())}


def _expressions(host: Column, path: Column, shapes: dict[int, list[int]]) -> Column:
    """All expressions of a URL that some rule could have; null where it is too short for one."""
    labels = F.size(F.split(host, r"\."))

    def of(n: int, lengths: list[int]) -> Column:
        suffix = F.substring_index(host, ".", -n)
        known = F.array(*[F.lit(x) for x in lengths])
        starts = F.filter(known, lambda x: x <= F.char_length(path))
        made = F.transform(starts, lambda x: _expression(suffix, F.substr(path, F.lit(1), x)))
        return F.when(labels >= n, made).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n, lengths) for n, lengths in shapes.items()])


def judge(
    pages: DataFrame,
    rules: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    default: str = DEFAULT,
) -> DataFrame:
    """page_id, host, path, rule and verdict for every row."""
    link = F.col(url)
    parts = pages.select(
        F.col(page_id).alias("page_id"), url_host(link).alias("host"), url_path(link).alias("path")
    )
    shapes = _shapes(rules)
    if not shapes:
        return parts.select(
            "*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")
        )
    made = _expressions(F.col("host"), F.col("path"), shapes)
    # repeated rows of one partition are counted, those of others are groups of their own
    asked = parts.select(
        "page_id",
        "host",
        "path",
        F.spark_partition_id().alias("part"),
        F.posexplode_outer(made).alias("at", "expression"),
    ).withColumn("digest", F.sha2("expression", 256))
    asked = asked.withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    hashed = _hashed(rules)
    size = rules.agg(
        F.count("*").alias("n"),
        F.coalesce(F.max(F.char_length("host") + F.char_length("path")), F.lit(0)).alias("longest"),
    ).first()
    if size["n"] <= BROADCAST_RULES and size["longest"] <= RULE_CHARS:
        met = asked.join(F.broadcast(hashed), "prefix", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        salt = F.pmod(F.xxhash64("page_id", "part", "path"), F.lit(SALTS)).cast("int")
        met = asked.withColumn("salt", salt).join(
            hashed.select("*", salts), ["prefix", "salt"], "left"
        )
    confirmed = F.filter("rules", lambda r: r["digest"] == F.col("digest"))
    best = F.struct(
        confirmed[0]["length"].alias("length"),
        confirmed[0]["host_length"].alias("host_length"),
        confirmed[0]["verdict"].alias("verdict"),
        confirmed[0]["rule"].alias("rule"),
    )
    judged = met.groupBy("page_id", "host", "path", "part").agg(
        F.max(F.when(F.size(confirmed) > 0, best)).alias("best"),
        F.sum(F.when(F.coalesce("at", F.lit(0)) == 0, 1)).alias("rows"),
    )
    rows = judged.select("page_id", "host", "path", "best", F.explode(F.sequence(F.lit(1), "rows")))
    return rows.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return judge(read(spark, sf_dir, "pages"), rules_table(spark))


_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

ORACLE = f"""
WITH cut AS (
  SELECT row_number() OVER () AS row_id, page_id,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw_host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
parts AS (
  SELECT row_id, page_id, path,
    translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM cut),
rules(rhost, rpath, rverdict) AS (VALUES {_RULES_SQL}),
fits AS (
  SELECT p.*, r.rhost || r.rpath AS rule, r.rverdict, row_number() OVER (
    PARTITION BY row_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, length(r.rhost) DESC) AS rn
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, '{DEFAULT}') AS verdict FROM fits WHERE rn = 1"""
