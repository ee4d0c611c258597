"""The registered queries against their SQL, and the pipeline against its parts."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from streamops.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "labels", "pages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    result = connection.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    expected = sorted(result.fetchall(), key=str)
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=str) == expected


def test_every_operator_is_registered():
    names = entry_module.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_pipeline_stages(spark, corpus):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = corpus([(9001, None), (9002, "123 !!"), (9003, ""), (None, "some nameless words of text"),
                    (9004, docs.first().text)]).drop("extra")
    docs = docs.unionByName(extra)
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.stored(stage(spark, docs, SF_DIR), f"test-{name}")
        if name != "encoding":
            assert after.schema == docs.schema
        counts.append(after.count())
        docs = after
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert 9001 not in ids and 9002 not in ids and 9004 not in ids and None in ids
    assert counts[1] == counts[0] - 3 and counts[2] < counts[1]
    assert counts[3] <= counts[2] and counts[4] == counts[5] == counts[3]
    assert docs.where("decoded <> text").count() == 0


def test_stages_keep_further_columns_whatever_their_names(spark, corpus):
    texts = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60).collect()
    own = ("key", "score", "spans", "_id", "bands", "found", "Lang_Pred")
    docs = corpus([(r.doc_id, r.text) for r in texts]).drop("extra").withColumns(
        {c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in own})
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF_DIR)
        assert after.columns[:len(docs.columns)] == docs.columns
        rows = after.select("doc_id", *own).collect()
        assert len(rows) > 20 and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in own)
