"""Registered queries over the smallest tables, against SQL where there is any."""

import os

import pytest

from auditlake.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_equal(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    rows = duck.execute(queries.ORACLE_SQL[name])
    names = sorted(c[0] for c in rows.description)
    order = [[c[0] for c in rows.description].index(c) for c in names]
    assert names == sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in rows.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.ORACLE_SQL.keys()))
def test_one_row_for_each_document(spark, name):
    if not os.path.isdir(DIR):
        pytest.skip("no tables here")
    table, key = ("embeddings", "vec_id") if name.startswith("op13_") else ("documents", "doc_id")
    got = queries.QUERIES[name](spark, DIR)
    want = spark.read.parquet(f"{DIR}/{table}.parquet")
    assert got.select(key).distinct().count() == want.select(key).distinct().count()
