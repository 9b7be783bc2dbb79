"""The queries that have SQL, against it, on the smallest tables; the digests of the others on what they were made from."""

import os

import pytest

from lodestar.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_a_row_for_every_document(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = queries.QUERIES[name](spark, DATA)
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
