"""Segments of ordered tables and sitemap bundles, against plain loops."""

import random

import pytest

from auditlake.operators import sitemap_bundle
from auditlake.operators.segments import segmented


def greedy(sizes, most, capacity):
    out, n, held, at = [], 0, 0, -1
    for s in sizes:
        if at < 0 or n + 1 > most or held + s > capacity:
            at, n, held = at + 1, 0, 0
        n, held = n + 1, held + s
        out.append(at)
    return out


@pytest.mark.parametrize(("n", "most", "capacity", "range_rows"), [(500, 7, 40, 7), (500, 3, 1000, 16), (333, 20, 25, 20), (64, 8, 64, 8), (65, 64, 10**6, 64), (1, 5, 9, 5), (40, 50, 30, 10)])
def test_segments(spark, n, most, capacity, range_rows):
    r = random.Random(n + most)
    sizes = [r.randint(1, 9) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(sizes)), "index long, bytes long").repartition(5)
    # Few maps compose at once, so starts go up and down several levels.
    got = {x["index"]: x["segment"] for x in segmented(df, most, capacity, range_rows, fan_in=2).collect()}
    assert [got[i] for i in range(n)] == greedy(sizes, most, capacity)


def test_no_rows(spark):
    assert segmented(spark.createDataFrame([], "index long, bytes long"), 5, 50).count() == 0


def urls(spark, *names):
    return spark.createDataFrame([(u, i) for i, u in enumerate(names)], "url string, sequence long")


def test_documents_split_by_bytes_then_entries(spark):
    names = [f"https://a.example/{i}" + "x" * (60 if i < 4 else 0) for i in range(12)]
    entry = lambda u: len(f"  <url>\n    <loc>{u}</loc>\n  </url>\n")
    made = sitemap_bundle.bundle(urls(spark, *names, names[0]), "https://a.example/", most_entries=5, most_bytes=110 + 2 * entry(names[0]) + 5, range_rows=4)
    got = [(r["number"], r["name"], r["entries"], r["split_reason"], r["first_url"]) for r in made.documents.orderBy("number").collect()]
    assert [(g[0], g[2], g[3]) for g in got] == [(1, 2, None), (2, 2, "byte_limit"), (3, 4, "byte_limit"), (4, 4, "byte_limit")] and got[2][4] == names[4]
    assert [g[1] for g in got] == [f"sitemap-{i}.xml" for i in range(1, 5)] and made.rejections.count() == 0
    docs = {r["number"]: r for r in made.documents.collect()}
    assert all(len(d["xml"].encode()) == d["bytes"] <= 110 + 2 * entry(names[0]) + 5 for d in docs.values())
    index = made.index.first()
    assert index["entries"] == 4 and index["warning"] is None and index["xml"].count("<loc>https://a.example/sitemap-") == 4
    made = sitemap_bundle.bundle(urls(spark, *names), most_entries=5)
    assert [(r["entries"], r["split_reason"]) for r in made.documents.orderBy("number").collect()] == [(5, None), (5, "entry_limit"), (2, "entry_limit")] and made.index.first()["warning"] == "index_blocked_missing_base_url"


def test_rejections_and_escapes(spark):
    good = "https://a.example/?a=1&b='2'"
    made = sitemap_bundle.bundle(urls(spark, good, "", None, "https://A.example/", "ftp://a.example/", "https:///x", "https://a.example/\x01", "https://a.example/" + "y" * 2100, "no url", "https://a.example/" + "z" * 600), most_bytes=500)
    assert {(r["sequence"], r["reason"]) for r in made.rejections.collect()} == {(1, "invalid_url"), (2, "invalid_url"), (3, "invalid_url"), (4, "unsupported_scheme"), (5, "missing_host"), (6, "xml_illegal_character"), (7, "url_too_long"), (8, "invalid_url"), (9, "entry_exceeds_document_byte_limit")}
    one = made.documents.first()
    assert (one["name"], one["entries"], made.index.count()) == ("sitemap.xml", 1, 0)
    assert one["xml"] == '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n  <url>\n    <loc>https://a.example/?a=1&amp;b=&apos;2&apos;</loc>\n  </url>\n</urlset>\n'


def test_no_urls_and_index_limits(spark):
    empty = sitemap_bundle.bundle(urls(spark))
    assert (empty.documents.first()["entries"], empty.documents.first()["bytes"], empty.documents.count()) == (0, 110, 1)
    names = [f"https://a.example/{i}" for i in range(4)]
    assert sitemap_bundle.bundle(urls(spark, *names), "https://a.example/", most_entries=1, most_indexed=3).index.first()["warning"] == "index_blocked_entry_limit"
    assert sitemap_bundle.bundle(urls(spark, *names), "https://a.example/", most_entries=1, most_index_bytes=150).index.first()["warning"] == "index_blocked_byte_limit"
