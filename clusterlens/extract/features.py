"""Which product features a node uses, from its counters and settings."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterlens import schema as S
from clusterlens.extract.registry import extractor
from clusterlens.extract.tables import AS_STAT, payload
from clusterlens.functions.variants import above

# Counters that show a feature is in use when any of them is above zero.
SERVICE_COUNTERS = {
    "KVS": ["stat_read_reqs", "stat_write_reqs"],
    "Batch": ["batch_initiate", "batch_index_initiate"],
    "UDF": ["udf_read_reqs", "udf_write_reqs"],
    "Scan": [
        "tscan_initiate",
        "basic_scans_success",
        "aggr_scans_success",
        "udf_bg_scans_success",
    ],
    "Query": ["query_reqs", "query_success"],
    "SIndex": ["sindex-used-bytes-memory"],
    "XDR": ["stat_read_reqs_xdr", "xdr_read_success", "stat_write_reqs_xdr"],
    "Rack-aware": ["self-group-id"],
}
NAMESPACE_COUNTERS = {
    "KVS": ["client_read_success", "client_write_success"],
    "UDF": ["client_udf_complete", "client_udf_error"],
    "Index-on-flash": ["index_flash_used_bytes", "index_flash_alloc_bytes"],
}
NAMESPACE_COUNTER_PREFIXES = {
    "PIndex Query": "pi_query_",
    "SIndex Query": "si_query_",
}
FEATURES = [
    "KVS",
    "Batch",
    "UDF",
    "Scan",
    "Query",
    "SIndex",
    "XDR",
    "Rack-aware",
    "Security",
    "TLS",
    "PIndex Query",
    "SIndex Query",
    "SC",
    "Index-on-flash",
]


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def _fields(names: Iterable[str], of: str) -> str:
    return ", ".join(f"`{n}`: {of}" for n in names)


def what_is_read() -> str:
    """Type of what the conditions read of a payload. A value that does not fit its type is null; a VARIANT is null only
    where the member is absent."""
    service = ", ".join(_fields(keys, "double") for keys in SERVICE_COUNTERS.values())
    statistics = f"service: struct<{service}>, namespace: map<string, struct<service: map<string, double>>>"
    settings = "`rack-id`: double, `strong-consistency`: string, `index-type`: string"
    network = _fields(["service", "fabric"], "struct<`tls-port`: variant>")
    config = (
        f"xdr: variant, security: struct<`enable-security`: string>, network: struct<{network}>, "
        f"namespace: map<string, struct<service: struct<{settings}>>>"
    )
    return f"struct<{AS_STAT}: struct<statistics: struct<{statistics}>, config: struct<{config}>>>"


def _true(text: Column) -> Column:
    return F.coalesce(F.lower(text) == "true", F.lit(False))


def feature_conditions(block: Column, namespaces: Column) -> dict[str, Column]:
    """Condition of every feature over what is read of a node, and the (counters, settings) pairs of its namespaces."""
    config, service = block["config"], block["statistics"]["service"]
    conds: dict[str, list[Column]] = {f: [] for f in FEATURES}
    for feature, keys in SERVICE_COUNTERS.items():
        conds[feature] += [above(service[k]) for k in keys]
    conds["XDR"].append(config["xdr"].isNotNull())
    conds["Security"].append(_true(config["security"]["enable-security"]))
    for part in ("service", "fabric"):
        conds["TLS"].append(above(config["network"][part]["tls-port"].try_cast("double")))

    def in_namespaces(test) -> Column:
        """Does any namespace pass the test on its counters and settings?"""
        return F.exists(namespaces, lambda n: test(n.getField("counters"), n.getField("settings")))

    for feature, keys in NAMESPACE_COUNTERS.items():
        conds[feature].append(
            in_namespaces(lambda c, s, keys=keys: _any([above(F.try_element_at(c, F.lit(k))) for k in keys]))
        )
    for feature, prefix in NAMESPACE_COUNTER_PREFIXES.items():
        conds[feature].append(
            in_namespaces(
                lambda c, s, prefix=prefix: F.exists(
                    F.map_keys(c),
                    lambda k: k.startswith(prefix) & above(F.try_element_at(c, k)),
                )
            )
        )
    conds["Rack-aware"].append(in_namespaces(lambda c, s: above(s.getField("rack-id"))))
    conds["SC"].append(in_namespaces(lambda c, s: _true(s.getField("strong-consistency"))))
    conds["Index-on-flash"].append(
        in_namespaces(lambda c, s: F.coalesce(s.getField("index-type") == "flash", F.lit(False)))
    )
    return {f: _any(c) for f, c in conds.items()}


def namespace_pairs(block: Column) -> Column:
    """Counters and settings of every namespace that reports statistics; null without any."""
    settings = block["config"]["namespace"]
    return F.transform(
        F.map_entries(block["statistics"]["namespace"]),
        lambda e: F.struct(
            e.getField("value").getField("service").alias("counters"),
            F.try_element_at(settings, e.getField("key")).getField("service").alias("settings"),
        ),
    )


@extractor("active_features")
def detect_features(nodes: DataFrame) -> DataFrame:
    """Features per node. A TLS port that is no number leaves the node without any feature."""
    block = F.col("block")
    ports = [block["config"]["network"][part]["tls-port"] for part in ("service", "fabric")]
    broken = _any([port.isNotNull() & port.try_cast("double").isNull() for port in ports])
    conds = feature_conditions(block, F.col("namespaces"))
    found = F.filter(
        F.array(*[F.when(cond, F.lit(f)) for f, cond in conds.items()]),
        lambda f: f.isNotNull(),
    )
    # A payload is read once, for all conditions: every path into it that leads to nothing costs as much as the rest.
    read = payload().try_cast(what_is_read())[AS_STAT].alias("block")
    return (
        nodes.filter(F.col("node_id").isNotNull())
        .select(*S.KEYS, "node_id", read)
        .select(*S.KEYS, "node_id", "block", namespace_pairs(block).alias("namespaces"))
        .select(*S.KEYS, "node_id", F.explode(F.when(~broken, found)).alias("feature"))
    )
