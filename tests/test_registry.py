"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry_module
from streamops.plans.registry import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
             "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
WITHOUT_SQL = set()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def in_order(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sql, name):
    df = entry_module.queries()[name](spark, SF_DIR)
    result = sql.execute(entry_module.oracle_sql()[name])
    names = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    expected = result.fetchall()
    columns = sorted(df.columns)
    assert columns == sorted(names)
    assert {f.name: SQL_TYPES[f.dataType.simpleString()] for f in df.schema} == types
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    at = [names.index(c) for c in columns]
    assert in_order(got) == in_order([tuple(r[i] for i in at) for r in expected])
    assert got


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(QUERIES) <= set(entry_module.queries())


def test_partition_key_counts_every_event(spark):
    import zlib

    spread = entry_module.queries()["partition_key"](spark, SF_DIR).collect()
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    assert sum(r.records for r in spread) == events
    assert all(r.partition == zlib.crc32(str(r.user_id).encode()) % 8 for r in spread)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["page", "window_start", "window_end", "views"] and df.count() > 0
