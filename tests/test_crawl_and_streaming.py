import pytest
from pyspark.sql import functions as F

from auditlake.operators import combined, crawl, indexability
from auditlake.streaming import ingest

SCHEMA = "page_id long, body binary, status int, content_type string, fetch_failed boolean, body_truncated boolean"


@pytest.mark.parametrize(
    ("row", "reason"),
    [
        ((b"<p>", 200, "text/html; charset=utf-8", False, False), None), ((None, None, None, True, False), "fetch_failed"), ((b"x", 200, "text/html", False, True), "response_truncated"), ((None, 200, "text/html", False, False), "missing_body"),
        ((b"x", 404, "text/html", False, False), "http_error_response"), ((b"", 200, "text/html", False, False), "empty_body"), ((b"  <HTML>", 200, None, False, False), None), ((b"plain", 200, "application/octet-stream", False, False), "non_html_content"), ((b"%PDF", 200, "application/pdf", False, False), "non_html_content"),
    ],
)
def test_preflight(spark, row, reason):
    assert crawl.preflight(spark.createDataFrame([(1, *row)], SCHEMA)).first().skip_reason == reason


@pytest.mark.parametrize(
    ("body", "kind", "text", "charset"),
    [("é".encode(), "text/html; charset=utf-8", "é", "utf-8"), (b"\xef\xbb\xbfa", None, "a", "utf-8"), (b'<meta charset="latin-1">\xe9', "text/html", '<meta charset="latin-1">é', "latin-1"), (b"\x80", None, "€", "cp1252"), (b"\xff", "x; charset=utf-8", "�", "utf-8"), (b"a", "x; charset=nothing", "a", "cp1252"), (None, None, None, None)],
)
def test_charsets(body, kind, text, charset):
    assert crawl.decode_body(body, kind) == (text, charset)


def test_replay(spark):
    links = [("a", 0, "/b", "b", "http", True), ("a", 1, "/c", "c", "http", True), ("a", 2, "/b", "b", "http", True), ("a", 3, "#x", None, "fragment", True), ("a", 4, "", None, "invalid", True), ("a", 5, "/a", "a", "http", True), ("a", 6, "http://o", "o", "http", False), ("a", 7, "javascript:", None, "javascript", True), ("b", 0, "/d", "d", "http", True), ("b", 1, "/c", "c", "http", True), ("c", 0, "/e", "e", "http", True), ("d", 0, "/f?q", "f?q", "http", True)]
    df = spark.createDataFrame(links, "source_url string, link_sequence int, href string, resolved string, link_type string, in_scope boolean")
    seeds = spark.createDataFrame([("a",)], "url string")
    admitted, decided = crawl.replay(seeds, df, crawl.Limits(100, 2))
    assert {(r.url, r.depth, r.place) for r in admitted.collect()} == {("a", 0, 0), ("b", 1, 1), ("c", 1, 2), ("d", 2, 3), ("e", 2, 4)}
    got = {(r.source_url, r.link_sequence): r.reason for r in decided.collect()}
    assert got == {("a", 0): "admitted", ("a", 1): "admitted", ("a", 2): "duplicate_url", ("a", 3): "fragment_only", ("a", 4): "empty_href", ("a", 5): "same_document", ("a", 6): "scope_denied", ("a", 7): "unsupported_scheme", ("b", 0): "admitted", ("b", 1): "duplicate_url", ("c", 0): "admitted", ("d", 0): "depth_exceeded"}
    few, why = crawl.replay(seeds, df, crawl.Limits(2, 5, False))
    assert [r.url for r in few.orderBy("place").collect()] == ["a", "b"] and {r.reason: r.links for r in crawl.counters(why).collect()}["url_limit_reached"] == 3


def decisions_by_hand(n, max_urls, max_depth):
    from auditlake.plans.site import SITE

    links = {p: [(10 * p + i, t) for i, (t, ok) in enumerate(((3 * p + 1, (3 * p + 1) % 11), (3 * p + 2, (3 * p + 2) % 11), (p // 3, p), (0, p % 2 == 0), (p + 1, p % 6 == 0))) if ok and t < n] for p in range(n)}
    level = sorted((p for p in range(0, n, 25)), key=str)[:max_urls]
    known, out, depth = set(level), [], 0
    while level and depth <= max_depth:
        depth += 1
        fresh, now = [], set()
        for p in level:
            for seq, t in links[p]:
                reason = "same_document" if t == p else "depth_exceeded" if depth > max_depth else "duplicate_url" if t in known or t in now else "url_limit_reached" if len(known) + len(fresh) >= max_urls else "admitted"
                if reason in ("admitted", "url_limit_reached"):
                    now.add(t)
                if reason == "admitted":
                    fresh.append(t)
                out.append((f"{SITE}{p}", seq, f"{SITE}{t}", depth, reason))
        known |= set(fresh)
        level = fresh
    return out


@pytest.mark.parametrize(("n", "limits"), [(400, None), (1600, None), (400, (60, 50)), (400, (10, 50)), (400, (400, 1))])
def test_decisions_over_all_pages(spark, tmp_path, monkeypatch, n, limits):
    from auditlake.plans import queries

    if limits:
        monkeypatch.setitem(crawl.PROFILES, "absolute", crawl.Limits(*limits))
    spark.range(n).select(F.col("id").alias("page_id"), F.lit("").alias("url"), F.lit("").alias("html")).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in queries.crawl_decisions(spark, str(tmp_path)).collect())
    assert got == sorted(decisions_by_hand(n, *(limits or (50_000, 50))))
    # The number of pages that the crawl meets grows with the table.
    assert limits or len({r[0] for r in got}) > n / 25


def test_directives(spark):
    assert indexability.parse_header("auditbot: noindex, nofollow") == {"agent": "auditbot", "directives": ["noindex", "nofollow"], "warning": None}
    assert indexability.parse_header("max-snippet: 5, noindex")["directives"] == ["max-snippet: 5", "noindex"] and indexability.parse_header(" ")["warning"] == "empty_x_robots_tag" and indexability.parse_header("a b: x")["warning"] == "invalid_x_robots_tag"
    pages = spark.createDataFrame([(1, ["index"], ["noindex"]), (2, ["max-snippet:5"], ["max-snippet:6"]), (3, ["noindex"], ["noindex", "somebot: nofollow"]), (4, ["follow"], None)], "page_id long, meta array<string>, h array<string>")
    got = {(r.page_id, r.conflict) for r in indexability.conflicts(pages.withColumn("records", indexability.x_robots("h"))).collect()}
    assert got == {(1, "meta_header_index_conflict"), (2, "parameter_conflict"), (3, "crawler_specific_difference")}


def test_stream_keeps_first_sightings(spark, tmp_path):
    rows = [("http://a/1", "2024-01-01 00:00:00"), ("http://a/1", "2024-01-01 00:01:00"), ("http://b/1", "2024-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "url string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = ingest.first_sightings(ingest.page_stream(spark, str(tmp_path / "in"), df.schema))
    ingest.keep_current(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["http://a/1", "http://b/1"]
    assert ingest.arrivals(df, "at").count() == 2


def test_combined_outputs(spark):
    from auditlake.operators import sitemap
    from auditlake.plans.site import crawl_sql

    base = spark.range(200).select(F.col("id").alias("page_id"), F.lit("A title").alias("title"), F.lit(1).alias("n_titles"))
    pages = spark.sql(crawl_sql("{base}", False), base=base)
    facts, found = combined.url_facts(pages, sitemap.recommendations(pages)), combined.findings(pages)
    assert combined.broken_invariants(facts) == []
    out = combined.artifacts(facts, found)
    assert out["pages"].count() == 200 and out["sitemap_urls"].count() + out["exclusions"].count() <= 200 and [r.priority for r in out["issues"].collect()] == sorted(r.priority for r in out["issues"].collect())
    assert combined.summary(facts, found).where("dimension = 'affected'").first().urls == found.select("page_id").distinct().count()
