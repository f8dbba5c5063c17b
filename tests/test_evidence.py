"""Evidence that is kept, and functions for SQL."""

import pytest
from pyspark.sql import functions as F

from auditlake.functions.register import register
from auditlake.sources.evidence import VERSION, EvidenceStore

PAGES = [(i, f"https://a.example/{i}", f"<html><head><title>Page {i % 3}</title></head><body><a href='/x{i}'>x</a>{'<img src=i.png>' * (i % 2)}</body></html>", 9 - i) for i in range(9)] + [(9, "https://a.example/9", None, None)]
SCHEMA = "page_id long, url string, html string, discovery_order int"


@pytest.fixture
def store(spark, tmp_path):
    return EvidenceStore(spark, f"file://{tmp_path}/evidence")


def test_a_run_is_parsed_once_and_read_in_parts(spark, store):
    rows = store.retain("r1", spark.createDataFrame(PAGES, SCHEMA))
    assert rows.count() == 10 and {tuple(r) for r in rows.select("run_id", "version").distinct().collect()} == {("r1", VERSION)} and "html" not in rows.columns
    titled = store.read("r1").select("page_id", F.try_element_at("evidence.titles", F.lit(1)).alias("t"))
    both = titled.join(store.read("r1").groupBy(F.try_element_at("evidence.titles", F.lit(1)).alias("t")).agg(F.count(F.lit(1)).alias("n")), "t")
    plan = both._jdf.queryExecution().executedPlan().toString()
    # Both sides scan two columns of the written table; nothing is parsed again.
    assert "MapInArrow" not in plan and plan.count("FileScan") >= 1 and "links" not in plan
    assert {r["page_id"]: r["n"] for r in both.collect()} == {i: 3 for i in range(9)}
    assert tuple(store.summary("r1").first()) == ("r1", 10, 9, 4, 0, 0)


def test_limit_by_discovery(spark, store):
    kept = store.retain("r2", spark.createDataFrame(PAGES, SCHEMA), most=4)
    # The last in the table were discovered first; a page without a place comes last.
    assert {r["page_id"] for r in kept.select("page_id").collect()} == {8, 7, 6, 5}
    assert store.retain("r3", spark.createDataFrame(PAGES, SCHEMA), most=100).count() == 10


def test_versions_and_missing_runs(spark, store):
    store.retain("r4", spark.createDataFrame(PAGES, SCHEMA))
    with pytest.raises(ValueError, match="version 1, not 2"):
        store.read("r4", 2)
    with pytest.raises(ValueError, match="no evidence of run r5"):
        store.read("r5")
    with pytest.raises(Exception, match="exists"):
        store.retain("r4", spark.createDataFrame(PAGES, SCHEMA))
    assert store.retain("r6", spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql_over_pages(spark):
    register(spark)
    register(spark)
    got = spark.sql("SELECT page_id, get(titles, 0) AS t, size(links) AS n, get(links, 0).resolved AS r FROM html_evidence(TABLE(SELECT page_id, url, html FROM {p})) ORDER BY page_id", p=spark.createDataFrame(PAGES, SCHEMA)).collect()
    assert [tuple(x) for x in got[:2]] == [(0, "Page 0", 1, "https://a.example/x0"), (1, "Page 1", 1, "https://a.example/x1")] and got[9]["n"] == 0
    assert spark.sql("SELECT normalize_url('HTTP://A.example:80/../b').normalized AS n, nfkc_casefold(' ẞ ') AS k, governed_url('https://a.example/?utm_source=x&b=1').stripped AS g").first().asDict() == {"n": "http://a.example/b", "k": "ss", "g": "https://a.example/?b=1"}
