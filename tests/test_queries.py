"""The driver contract, and a sample of queries against DuckDB (tools/compare.py runs all)."""

import duckdb
import pytest

import __spark_entry__ as entry
from clusterlens.plans import queries
from tools.compare import TABLES, canon

SAMPLE = [
    "x1_lenient_numbers",
    "f9_threshold_band",
    "j2_paired_settings",
    "a8_deviation_skew",
    "d4_first_names",
    "s3_decode_members",
    "n1_node_stats",
    "n15_features",
    "r1a_error_skew",
    "r2c_deadlock",
    "r6a_connections",
    "c4a_rate",
    "c5a_forecast",
    "run_all",
    "s4_explode_snapshots",
    "s10_store_findings",
    "d5_sort_findings",
    "p3_vitals",
    "p4_narrative",
]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["cluster_id", "id", "status", "message", "peak"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    own = set(queries.QUERIES)
    assert own <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    got = [list(r.asDict(recursive=True).values()) for r in df.collect()]
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert canon(df.columns, got) == canon(cols, cur.fetchall())
