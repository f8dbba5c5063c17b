"""Every registered query against its SQL on the smallest tables."""

import math
import os

import pytest

from auditlake.plans import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages documents".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_equal(spark, duck, name):
    df = queries.QUERIES[name](spark, DIR)
    rows = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in rows.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((repr(tuple(plain(r[names.index(c)]) for c in sorted(names))) for r in rows.fetchall()))
    assert sorted(repr(tuple(plain(r[c]) for c in sorted(names))) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.ORACLES.keys()))
def test_rows_come(spark, name):
    if not os.path.isdir(DIR):
        pytest.skip("no tables here")
    assert queries.QUERIES[name](spark, DIR).count() > 0
