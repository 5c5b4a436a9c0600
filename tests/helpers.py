"""Small bundles and documents, made by the tests."""

from __future__ import annotations

import datetime as dt
import gzip
import io
import json
import tarfile
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TS = "2024-01-01 00:00:00"
K = {"run_id": "r1", "snapshot_ts": dt.datetime(2024, 1, 1), "cluster_id": "c"}


def tar_bytes(members: list[tuple[str, bytes]], mode: str = "w:gz") -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def zipped(data: bytes, name: str = "x.json") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, data)
    return out.getvalue()


def gzipped(data: bytes) -> bytes:
    return gzip.compress(data)


def document(payload: dict, ts: str = TS, cluster: str = "c", node: str = "n1") -> str:
    return json.dumps({ts: {cluster: {node: payload}}})


def nodes_of(spark, payloads: dict[str, dict | str], cluster: str = "c") -> DataFrame:
    """Nodes DataFrame from node name to payload."""
    rows = [
        (cluster, n, p if isinstance(p, str) else json.dumps(p)) for n, p in payloads.items()
    ]
    df = spark.createDataFrame(rows, "cluster_id string, node_id string, j string")
    return df.select(
        F.lit("r1").alias("run_id"),
        F.lit(TS).cast("timestamp").alias("snapshot_ts"),
        "cluster_id",
        "node_id",
        F.lit(TS).alias("snapshot"),
        F.parse_json("j").alias("payload"),
    )


def rows(df: DataFrame, *cols: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
