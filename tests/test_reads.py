"""Result resources, exports, discovery, variants and the mended limits, by literal cases."""

import pytest
from pyspark.sql import functions as F

from auditlake.functions.urls import UrlError, normal_host
from auditlake.operators import governance, graph, images, links, migration, reads, sitemap, structured


def test_resources_name_their_filters_and_sorts(spark):
    rows = spark.createDataFrame([(i, ["include", "exclude"][i % 2], "a,redirect" if i % 3 else None, "x") for i in range(20)], "page_id long, state string, reasons string, primary_reason string")
    got = reads.read("recommendations", rows, {"state": "exclude", "contains_reasons": "REDIRECT"}, "page_id", True, 1, 2)
    assert [r.page_id for r in got.collect()] == [17, 13]
    with pytest.raises(ValueError, match="unknown filter: page_id"):
        reads.read("recommendations", rows, {"page_id": 1})
    with pytest.raises(ValueError, match="unknown sort: reasons"):
        reads.read("recommendations", rows, sort="reasons")
    assert [r.page_id for r in reads.read("recommendations", rows.where("false")).collect()] == []


def test_evidence_of_one_version(spark):
    rows = spark.createDataFrame([("a", 2, 1), ("a", 1, 1), ("b", 1, 7)], "run_id string, sequence int, version int")
    assert [r.sequence for r in reads.evidence_scan(rows, "a", 1).collect()] == [1, 2]
    with pytest.raises(ValueError, match="another version"):
        reads.evidence_scan(rows, "b", 1)


def test_run_gate(spark):
    runs = spark.createDataFrame([("a", "completed"), ("b", "running"), ("c", "failed")], "run_id string, lifecycle string")
    own = lambda *ids: spark.createDataFrame([(i,) for i in ids], "run_id string")
    got = {r.run_id: tuple(r)[1:] for r in reads.run_gate(runs, {"pages": own("a", "a", "b"), "links": own("a", "c")}, own("a", "b", "a")).collect()}
    assert got == {"a": (True, 2, 1, True, True), "b": (False, 1, 0, True, False), "c": (True, 0, 1, False, False)}


def test_rule_tester(spark):
    rules = [("r", "path_contains", "/x/", False, "mark_for_review", 1, "global", []), ("s", "exact_path", "/X/y", True, "exclude_from_discovery", 1, "preset", ["r"])]
    found, decided = governance.tested(spark.createDataFrame([("https://a.test/X/y",), ("https://a.test/z",), ("nonsense",)], "url string"), rules)
    assert {(r.url_id, r.rule_id) for r in found.collect()} == {("https://a.test/X/y", "r"), ("https://a.test/X/y", "s")}
    assert [(r.url_id, r.layer, r.primary_rule) for r in decided.collect()] == [("https://a.test/X/y", "discovery", "s")]


def test_types(spark):
    bad = ["", " A", "A b", "@id", "ftp://x.test/A", "https:///A"]
    df = spark.createDataFrame([(x,) for x in [*bad, "A", "schema:A", "https://schema.org/A"]], "t string")
    assert [r.t for r in df.where(structured.malformed_type(F.col("t"))).collect()] == bad


@pytest.mark.parametrize(
    ("alt", "state"),
    [
        (None, "missing"), ("", "empty"), (" \n ", "whitespace"), (" read \n more ", "generic"), ("IMG-12", "filename"), ("dsc7", "filename"), ("image_1-2", "filename"), ("menu-final2", "filename"), ("a b.webp", "filename"),
        ("http://a", "url"), ("www.a", "url"), ("/a b", "url"), ("C:\\\\x"[:3] + "x y", "url"), ("shop.de/ x", "url"), ("x" * 201, "overlong"), ("x " * 100, "present"), ("a\u00a0 view", "present"), ("image", "generic"), ("imagine 1", "present"),
    ],
)
def test_alternative_texts(spark, alt, state):
    row = (1, 0, "/a.png", alt, "1", "1", "lazy", None, None, False, False, True, 200)
    df = spark.createDataFrame([row], "page_id int, index int, src string, alt string, width string, height string, loading string, decoding string, priority string, linked boolean, decorative boolean, internal boolean, resource_status int")
    assert images.occurrences(df).first().alt_state == state


def test_chains_of_any_length_are_no_loops(spark):
    rows = [(f"c{i}", f"c{i + 1}") for i in range(150)] + [("x", "y"), ("y", "x"), ("z", "x"), ("one", "end")]
    got = {r.source_url: r.diagnostic for r in migration.planned_graph(spark.createDataFrame(rows, "source_url string, destination_url string")).collect()}
    assert {got[f"c{i}"] for i in range(149)} == {"redirect_map_chain"} and got["c149"] is None and got["one"] is None
    assert got["x"] == got["y"] == got["z"] == "redirect_map_loop"


def test_following_all_links_has_no_limit(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_PATH", 3)
    edges = spark.createDataFrame([(str(i), str(i + 1), "direct", 1, 0) for i in range(6)], "source string, adjusted string, edge_state string, occurrences int, nofollows int")
    pages = spark.createDataFrame([(str(i), "eligible") for i in range(7)], "identity string, eligibility string")
    seeds = spark.createDataFrame([("0",)], "identity string")
    assert graph.reachability(edges, pages, seeds).count() == 4 and graph.reachability(edges, pages, seeds, follow_all=True).count() == 7


def test_sitemaps_are_heard_of_in_order(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    robots = one([("https://a.test", "User-agent: *\nSITEMAP : /s.xml\nsitemap: https://b.test/x.xml\n")], "origin string, body string")
    got = {r.url: (r.source, r.sources) for r in sitemap.discovered(one([("https://a.test",)], "origin string"), one([("https://a.test/sitemap.xml",)], "url string"), robots).collect()}
    assert got["https://a.test/s.xml"] == ("robots", "robots") and got["https://a.test/sitemap.xml"] == ("explicit", "explicit,common_path") and len(got) == 4


def test_images_meet_the_page_that_redirects_end_at(spark):
    pages = spark.createDataFrame([(1, "a", "c", 200), (2, "b", None, 404), (3, "d", "c", 500)], "page_id int, identity string, final_identity string, http_status int")
    own = spark.createDataFrame([("a",), ("c",), ("x",)], "page_identity string")
    assert {r.page_identity: r.http_status for r in images.with_pages(own, pages, "page_id", "http_status").collect()} == {"a": 200, "c": 200, "x": None}


def test_exports_of_links(spark):
    found = spark.createDataFrame([("t", "broken_internal_link", "target_404", "high", "remove_link", "high", 3), ("u", "working_internal_link", "working", "info", "no_action", "high", 1)], "target_identity string, broken_state string, reason string, severity string, action string, confidence string, source_pages int")
    links_ = spark.createDataFrame([(1, "t"), (2, "t"), (3, "u"), (4, "v")], "page_id int, target_identity string")
    assert sorted(r.page_id for r in links.broken_links(links_, found).collect()) == [1, 2]
    chains = spark.createDataFrame([("t", "a b", 1, False)], "target_identity string, nodes string, hop_count int, loop boolean")
    assert [(r.target_identity, r.current_chain, r.hop_count) for r in links.redirect_map(found, chains, "target_identity").collect()] == [("t", "a b", 1)]


@pytest.mark.parametrize(("host", "want"), [("EXAMPLE.com", "example.com"), ("b\u00fccher.de", "xn--bcher-kva.de"), ("a\u3002b", "a.b"), ("192.0.2.1", "192.0.2.1"), ("2001:DB8::0:1", "2001:db8::1")])
def test_hosts(host, want):
    assert normal_host(host) == want


@pytest.mark.parametrize(("host", "code"), [("", "missing_hostname"), ("-a.de", "invalid_hostname"), ("a..b", "invalid_hostname"), ("x" * 64, "invalid_hostname"), (".".join(["a" * 60] * 5), "invalid_hostname"), ("\u00fc" * 70, "invalid_hostname")])
def test_hosts_that_are_none(host, code):
    with pytest.raises(UrlError, match=code):
        normal_host(host)
