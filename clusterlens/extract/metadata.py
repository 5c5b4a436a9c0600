"""Cluster metadata: version, platform, consistency, storage and topology of every cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens import schema as S
from clusterlens.extract.registry import extractor
from clusterlens.extract.tables import AS_STAT, payload
from clusterlens.functions import contains_any, path_get
from clusterlens.functions.scalars import variant_path
from clusterlens.functions.variants import as_map, child, entries, has_key, is_true, text

# Labels, and the texts that give a platform away.
UNKNOWN = "Unknown"
STRONG = "Strong Consistency (SC)"
AVAILABLE = "Available/Partition-Tolerant (AP)"
ON_PREMISES = "Bare Metal / On-Prem"
AWS_TEXTS = ["amazonaws", "ec2.internal", "10.94."]
AZURE_TEXTS = ["azure", "cloudapp", "10.181."]
TIERED_PLATFORMS = [
    ("AWS", ["amazonaws.com", "ec2.internal", "ami-id", "aws-"]),
    ("Azure", ["azure.com", "cloudapp.net", "hv_vmbus", "microsoft"]),
    ("GCP", ["googleapis.com", "gce.internal", "google-managed"]),
    ("Azure", ["10.181.", "_va7"]),
    ("AWS", ["10.94.", "us-east-"]),
]
FLASH_INDEX = "Flash (All-Flash)"
MEMORY_INDEX = "RAM (shmem)"
MOUNT_PATTERN = "service.index-type.mount%"

METADATA_KEYS = [
    "server_version",
    "major_version",
    "cloud_platform",
    "consistency_model",
    "storage_flavor",
    "topology",
]


def server_version() -> Column:
    """Build of the server; an empty build counts as absent."""
    build = path_get(payload(), [variant_path(AS_STAT, "meta_data", "asd_build")], falsy_empty=True)
    service = path_get(
        payload(), [variant_path(AS_STAT, "statistics", "service", "asd_build")], UNKNOWN
    )
    return F.coalesce(build, service)


def major_version(version: Column) -> Column:
    return F.split_part(version, F.lit("."), F.lit(1))


def _namespace_configs() -> Column:
    return entries(child(payload(), AS_STAT, "config", "namespace"))


def consistency_model() -> Column:
    strong = F.exists(
        _namespace_configs(),
        lambda e: is_true(e.getField("value"), "service", "strong-consistency"),
    )
    return F.when(strong, F.lit(STRONG)).otherwise(F.lit(AVAILABLE))


def _storage_kind(engine: Column) -> Column:
    name = F.lower(text(engine))
    by_name = (
        F.when(name.contains("device"), F.lit("DEVICE"))
        .when(name.contains("file"), F.lit("FILE"))
        .otherwise(F.lit("MEMORY"))
    )
    by_key = (
        F.when(has_key(engine, "devices") | has_key(engine, "device"), F.lit("DEVICE"))
        .when(has_key(engine, "files") | has_key(engine, "file"), F.lit("FILE"))
        .otherwise(F.lit("MEMORY"))
    )
    return (
        F.when(F.schema_of_variant(engine) == "STRING", by_name)
        .when(as_map(engine).isNotNull(), by_key)
        .otherwise(F.lit("MEMORY"))
    )


def storage_flavor() -> Column:
    """Storage kinds of all namespaces, sorted and joined."""
    kinds = F.array_sort(
        F.array_distinct(
            F.transform(
                _namespace_configs(),
                lambda e: _storage_kind(child(e.getField("value"), "service", "storage-engine")),
            )
        )
    )
    return F.when(F.size(kinds) > 0, F.array_join(kinds, "/")).otherwise(F.lit("MEMORY"))


def searched_text(mode: str = "simple") -> Column:
    """Text that gives the platform away, in lower case: all of the payload, or (``tiered``) its
    settings, its statistics and the node's name."""
    if mode == "simple":
        return F.lower(F.to_json(payload()))
    if mode != "tiered":
        raise ValueError(f"unknown mode {mode!r}")
    parts = [
        F.coalesce(F.to_json(child(payload(), AS_STAT, block)), F.lit("{}"))
        for block in ("config", "statistics")
    ]
    return F.lower(F.concat(*parts, F.col("node_id")))


def cloud_platform(body: Column, mode: str = "simple") -> Column:
    """Platform by texts in the node's telemetry. ``tiered`` looks for explicit cloud names first,
    and for habits of addresses and names after them."""
    simple = [("AWS", AWS_TEXTS), ("Azure", AZURE_TEXTS)]
    (first, texts), *rest = simple if mode == "simple" else TIERED_PLATFORMS
    out = F.when(contains_any(body, texts), F.lit(first))
    for platform, texts in rest:
        out = out.when(contains_any(body, texts), F.lit(platform))
    return out.otherwise(F.lit(ON_PREMISES))


def topology() -> Column:
    xdr = child(payload(), AS_STAT, "statistics", "xdr")
    members = F.size(as_map(xdr))
    filled = F.coalesce(
        F.when(as_map(xdr).isNotNull(), members > 0).otherwise(~text(xdr).isin("", "[]")),
        F.lit(False),
    )
    return F.when(filled, F.lit("XDR Enabled")).otherwise(F.lit("Standalone"))


def node_metadata(nodes: DataFrame, platform_mode: str = "simple") -> DataFrame:
    """One row per node with all metadata as columns."""
    return _metadata_columns(nodes.filter(F.col("node_id").isNotNull()), platform_mode)


def _metadata_columns(nodes: DataFrame, platform_mode: str) -> DataFrame:
    # The text is searched many times: it is a column of its own so that it is made once.
    searched = nodes.select(
        *S.KEYS,
        "node_id",
        "payload",
        searched_text(platform_mode).alias("body"),
        server_version().alias("version"),
    )
    version = F.col("version")
    return searched.select(
        *S.KEYS,
        "node_id",
        version.alias("server_version"),
        major_version(version).alias("major_version"),
        cloud_platform(F.col("body"), platform_mode).alias("cloud_platform"),
        consistency_model().alias("consistency_model"),
        storage_flavor().alias("storage_flavor"),
        topology().alias("topology"),
    )


@extractor("cluster_metadata")
def extract_metadata(nodes: DataFrame, platform_mode: str = "simple") -> DataFrame:
    """One row per cluster and key: the value of the last node, and how many values there are."""
    name = F.struct(F.lit("cluster_name").alias("key"), F.col("cluster_id").alias("value"))
    pairs = [F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in METADATA_KEYS]
    # A cluster without nodes has its name alone.
    known = F.when(F.col("node_id").isNotNull(), F.array(name, *pairs)).otherwise(F.array(name))
    per_node = _metadata_columns(nodes, platform_mode).select(
        *S.KEYS, F.coalesce("node_id", F.lit("")).alias("node_id"), F.inline(known)
    )
    # Nodes of a cluster mostly agree: one row per distinct value is left before the last pick.
    values = (
        per_node.groupBy(*S.KEYS, "key", "value")
        .agg(F.max("node_id").alias("node_id"))
    )
    return (
        values.groupBy(*S.KEYS, "key")
        .agg(
            F.max(F.struct("node_id", "value")).getField("value").alias("value"),
            F.count(F.lit(1)).alias("n_values"),
        )
        .select(*S.KEYS, "key", "value", "n_values")
    )


def index_location(clusters: DataFrame, meta: DataFrame, ns_stats: DataFrame, keys=S.KEYS) -> DataFrame:
    """Where the index of a cluster lives: what its metadata says, else what its mounts tell."""
    said = meta.filter((F.col("key") == "index_flavor") & (F.col("value") != UNKNOWN)).select(
        *keys, F.col("value").alias("said")
    )
    mounts = (
        ns_stats.filter(F.col("metric").ilike(MOUNT_PATTERN))
        .groupBy(*keys)
        .agg(F.lit(True).alias("mounted"))
    )
    return (
        clusters.select(*keys)
        .join(said, on=list(keys), how="left")
        .join(mounts, on=list(keys), how="left")
        .select(
            *keys,
            F.coalesce(
                "said",
                F.when(F.col("mounted"), F.lit(FLASH_INDEX)).otherwise(F.lit(MEMORY_INDEX)),
            ).alias("index_location"),
        )
    )
