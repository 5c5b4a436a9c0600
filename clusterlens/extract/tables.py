"""Long tables from node payloads. Every extractor is one narrow pass: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens import schema as S
from clusterlens.extract.registry import extractor
from clusterlens.functions import is_plain_number, lenient_bigint
from clusterlens.functions.variants import (
    as_map,
    child,
    entries,
    first_block,
    leaf_rows,
    text,
)

# Blocks that are no settings, and how an absent value is written in text columns.
NOT_CONFIG = ["statistics", "meta_data", "histogram", "latency"]
NULL_TEXT = "None"

AS_STAT = "as_stat"

#: Levels of a payload that are opened as rows: down to the statistics and settings of a namespace.
UPPER_LEVELS = 6


def payload() -> Column:
    return F.col("payload")


def flatten_payload(
    nodes: DataFrame, max_depth: int | None = None, upper_levels: int = UPPER_LEVELS
) -> DataFrame:
    """All leaves of the payload with dotted names, however deep; nulls are dropped.

    The upper levels become rows first, the trees below them are opened in one expression each.
    """
    rows = leaf_rows(nodes.select(*S.KEYS, "node_id", "payload"), "payload", upper_levels, max_depth)
    return rows.filter(F.col("value").isNotNull()).select(
        *S.KEYS, "node_id", F.col("path").alias("metric"), "value", "value_type"
    )


@extractor("node_stats")
def extract_node_stats(nodes: DataFrame) -> DataFrame:
    return flatten_payload(nodes)


@extractor("node_configs")
def extract_configs(nodes: DataFrame) -> DataFrame:
    """Settings from the config block, or from all of the node's block when there is none."""
    config = F.coalesce(child(payload(), AS_STAT, "config"), child(payload(), AS_STAT))
    rows = leaf_rows(
        nodes.select(*S.KEYS, "node_id", config.alias("config")),
        "config",
        UPPER_LEVELS - 2,
        skip=lambda key: key.isin(NOT_CONFIG),
    )
    return rows.select(
        *S.KEYS,
        "node_id",
        F.col("path").alias("config_name"),
        F.coalesce("value", F.lit(NULL_TEXT)).alias("value"),
        F.lit("config").alias("source"),
    )


@extractor("namespace_stats")
def extract_namespace_stats(nodes: DataFrame) -> DataFrame:
    """Plain numbers per namespace; names start with ``service.``."""
    container = first_block(payload(), [AS_STAT, "statistics", "namespace"], [AS_STAT, "namespaces"])
    per_ns = nodes.select(*S.KEYS, "node_id", F.explode(container).alias("namespace", "body"))
    # Only text leaves the generator, so the rows do not carry the object they came from.
    metrics = first_block(F.col("body"), ["service"], [], of="string")
    rows = per_ns.select(*S.KEYS, "node_id", "namespace", F.explode(metrics).alias("name", "text"))
    name = F.col("name")
    return rows.filter(is_plain_number("text")).select(
        *S.KEYS,
        "node_id",
        "namespace",
        F.when(name.startswith("service."), name)
        .otherwise(F.concat(F.lit("service."), name))
        .alias("metric"),
        F.col("text").try_cast("double").alias("value"),
        F.lit("statistics").alias("source"),
    )


@extractor("set_stats")
def extract_set_stats(nodes: DataFrame) -> DataFrame:
    """Key/value rows of every set."""
    sets = child(payload(), AS_STAT, "statistics", "set")
    per_ns = nodes.select(
        *S.KEYS, "node_id", F.inline(entries(sets)).alias("ns", "ns_body")
    )
    per_set = per_ns.select(
        *S.KEYS, "node_id", "ns", F.inline(entries(F.col("ns_body"))).alias("set_name", "body")
    )
    pairs = F.transform(
        entries(F.col("body")),
        lambda e: F.struct(
            e.getField("key").alias("key"),
            F.coalesce(text(e.getField("value")), F.lit(NULL_TEXT)).alias("value"),
        ),
    )
    return per_set.select(*S.KEYS, "node_id", "ns", "set_name", F.inline(pairs))


@extractor("security_stats")
def extract_security(nodes: DataFrame) -> DataFrame:
    """Connections per user; 0 when a user reports none."""
    users = child(payload(), AS_STAT, "acl", "users")
    rows = F.transform(
        F.filter(entries(users), lambda e: as_map(e.getField("value")).isNotNull()),
        lambda e: F.struct(
            e.getField("key").alias("user"),
            F.coalesce(
                lenient_bigint(text(child(e.getField("value"), "connections"))),
                F.lit(0).cast("bigint"),
            ).alias("connections"),
        ),
    )
    return nodes.select(*S.KEYS, "node_id", F.inline(rows))


@extractor("system_info")
def extract_system_info(nodes: DataFrame) -> DataFrame:
    """First-level members of the system block as text."""
    pairs = F.transform(
        entries(child(payload(), "sys_stat")),
        lambda e: F.struct(
            e.getField("key").alias("metric"),
            F.coalesce(text(e.getField("value")), F.lit(NULL_TEXT)).alias("value"),
        ),
    )
    return nodes.select(*S.KEYS, "node_id", F.inline(pairs))
