import pytest
from pyspark.sql import functions as F

from auditlake.operators import governance, graph, images, links, metadata, migration, resultset, structured
from auditlake.functions.urls import governed_url, normalize_url


def edge_frame(spark, rows):
    return spark.createDataFrame([(a, b, b, "direct", 1, n, "", False) for a, b, n in rows], "source string, target string, adjusted string, edge_state string, occurrences long, nofollows long, anchors string, sitewide boolean")


def test_reach_takes_the_queue_order(spark):
    edges = edge_frame(spark, [("s", "b", 0), ("s", "a", 0), ("b", "c", 0), ("a", "d", 0), ("a", "c", 0), ("c", "s", 0), ("d", "n", 1), ("d", "x", 0), ("c", "e", 0), ("d", "e", 0)])
    pages = spark.createDataFrame([(i, "excluded_broken" if i == "x" else "eligible") for i in "sabcdenx"], "identity string, eligibility string")
    got = {r.identity: (r.distance, r.predecessor, r.path) for r in graph.reachability(edges, pages, pages.where("identity = 's'").select("identity")).collect()}
    assert got["c"] == (2, "a", ["s", "a", "c"]) and got["d"] == (2, "a", ["s", "a", "d"]) and got["e"] == (3, "c", ["s", "a", "c", "e"]) and "n" not in got and "x" not in got
    every = {r.identity for r in graph.reachability(edges, pages, pages.where("identity = 's'").select("identity"), follow_all=True).collect()}
    assert every == set("sabcdenx")


def test_dominant_anchor_ties_go_to_the_first(spark):
    own = spark.createDataFrame([("t", "late", 9), ("t", "early", 2), ("t", "late", 11), ("t", "early", 12)], "target string, anchor string, seq long")
    assert graph.dominant_anchors(own).first().dominant == "early"


TARGET = {"source_available": True, "source_partial": False, "internal": True, "in_scope": True, "redirect_loop": False, "hop_count": 0, "final_internal": True, "final_in_scope": True, "category": "html", "fetch_failed": False, "http_status": 200, "failure_code": "", "n_permanent": 0, "n_temporary": 0, "sitewide": False}


@pytest.mark.parametrize(
    ("change", "state", "reason"),
    [
        ({}, "working_internal_link", "working"), ({"http_status": 404}, "broken_internal_link", "target_404"), ({"http_status": 451}, "broken_internal_link", "target_other_4xx"), ({"source_available": False, "http_status": 404}, "source_page_unavailable", "source_fetch_failed"),
        ({"internal": False}, "external_link_not_audited", "external_target"), ({"category": "pdf"}, "target_non_html", "target_non_html"), ({"fetch_failed": True, "http_status": None, "failure_code": "Read_Timeout"}, "target_fetch_failed", "target_timeout"),
        ({"http_status": None}, "unverified_internal_link", "target_not_crawled"), ({"hop_count": 1, "n_permanent": 1}, "redirecting_internal_link", "permanent_redirect"), ({"hop_count": 2, "n_permanent": 1, "n_temporary": 1}, "redirecting_internal_link", "mixed_redirect_chain"),
        ({"hop_count": 1, "http_status": 500}, "redirecting_internal_link", "redirect_target_5xx"), ({"redirect_loop": True}, "redirecting_internal_link", "redirect_loop_detected"), ({"hop_count": 11}, "redirecting_internal_link", "redirect_chain_too_long"),
    ],
)
def test_target_decisions(spark, change, state, reason):
    schema = "source_available boolean, source_partial boolean, internal boolean, in_scope boolean, redirect_loop boolean, hop_count int, final_internal boolean, final_in_scope boolean, category string, fetch_failed boolean, http_status int, failure_code string, n_permanent int, n_temporary int, sitewide boolean"
    r = links.classified(spark.createDataFrame([tuple((TARGET | change).values())], schema)).first()
    assert r.broken_state == state and reason in (r.reason, r.redirect_reason)


def test_chains(spark):
    hops = spark.createDataFrame([(1, 2, "b", "a", 302), (1, 1, "a", "b", 301), (2, 1, "x", "y", 301)], "page_id long, sequence int, from_url string, to_url string, status int")
    got = {r.page_id: (r.nodes, r.hop_count, r.loop, r.mixed) for r in links.chains(hops).collect()}
    assert got == {1: ("a b a", 2, True, True), 2: ("x y", 1, False, False)}


def test_page_index_prefers_the_requested_page(spark):
    pages = spark.createDataFrame([(1, "A", "B", 200), (2, "B", None, 404), (3, "C", "D", 200), (4, "E", "D", 500)], "page_id long, identity string, final_identity string, http_status int")
    got = {r.key: r.http_status for r in links.page_index(pages, "page_id", "http_status").collect()}
    assert got == {"A": 200, "B": 404, "C": 200, "D": 200, "E": 500}


IMAGE = "page_id long, index int, src string, alt string, width string, height string, loading string, decoding string, priority string, linked boolean, decorative boolean, internal boolean, resource_status int"


@pytest.mark.parametrize(("alt", "linked", "decorative", "state"), [(None, False, False, "missing"), ("", True, True, "link_empty"), ("", False, True, "decorative"), ("", False, False, "empty"), ("   ", False, False, "whitespace"), ("x" * 201, False, False, "overlong"), (" Logo ", False, False, "generic"), ("IMG_12", False, False, "filename"), ("hero-v2", False, False, "filename"), ("a.JPG", False, False, "filename"), ("https://x", False, False, "url"), ("A red pen", False, False, "present")])
def test_alternative_texts(spark, alt, linked, decorative, state):
    own = spark.createDataFrame([(1, 0, "/a.png", alt, "1", "1", "lazy", None, None, linked, decorative, True, 200)], IMAGE)
    assert images.occurrences(own).first().alt_state == state


@pytest.mark.parametrize(("width", "height", "state"), [(None, None, "both_missing"), ("1", None, "height_missing"), (None, "1", "width_missing"), ("x", "1", "invalid_width"), ("1", "2.5", "invalid_height"), ("0", "1", "zero"), ("-1", "1", "review"), (" 10 ", "20", "present")])
def test_dimensions(spark, width, height, state):
    own = spark.createDataFrame([(1, 0, "/a.png", "ok then", width, height, None, None, None, False, False, True, 200)], IMAGE)
    assert images.occurrences(own).first().dimension_state == state


def test_governance_layers(spark):
    rules = [("a", "path_contains", "/x", False, "exclude_from_discovery", 1, "global", []), ("b", "exact_path", "/x", False, "mark_for_review", 1, "preset", []), ("c", "exact_url", "http://h.com/x?q=1", False, "exclude_from_sitemap", 1, "per_audit", ["a"]), ("d", "query_parameter_equals", "Q=1", True, "exclude_from_sitemap", 9, "per_audit", [])]
    urls = spark.createDataFrame([(1, "http://h.com/x?q=1"), (2, "http://h.com/X"), (3, "http://h.com/x?Q=1"), (4, "bad")], "url_id long, url string").select("url_id", governed_url(F.col("url")).alias("g"))
    found = governance.matches(urls, rules)
    assert {(r.url_id, r.rule_id) for r in found.collect()} == {(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "a"), (3, "b"), (3, "d"), (3, "c")}
    got = {(r.url_id, r.layer): r.primary_rule for r in governance.decisions(found).collect()}
    assert (1, "discovery") not in got and got[2, "discovery"] == "a" and got[3, "sitemap"] == "c" and got[1, "review"] == "b"
    preset = governance.preset_rules()
    assert len(preset) == 11 and len(governance.preset_rules(True)) == 16
    assert [r[4] for r in governance.effective([preset, [(preset[0][0], *preset[0][1:4], "mark_for_review", 1, "per_audit", [])]])][0] == "mark_for_review"


def test_exclusions_end_at_segments(spark):
    rules = [("path_prefix", "/a"), ("path_prefix", "/"), ("query_parameter", "q"), ("query_parameter_equals", "q=1"), ("path_suffix", ".pdf"), ("exact_url", "http://h.com/a"), ("exact_path", "/a/b"), ("path_contains", "b")]
    urls = spark.createDataFrame([(1, "http://h.com/a"), (2, "http://h.com/ab?q=2"), (3, "http://h.com/a/b?q=1"), (4, "http://h.com/x.pdf"), (5, "bad")], "url_id long, url string").select("url_id", normalize_url("url").alias("u"))
    got = {}
    for r in governance.exclusion_matches(urls, rules).orderBy("place").collect():
        got.setdefault(r.url_id, []).append(r.place)
    assert got == {1: [0, 1, 5], 2: [1, 2, 7], 3: [0, 1, 2, 3, 6, 7], 4: [1, 4]}


def test_inventory_first_source_wins(spark):
    a = spark.createDataFrame([("k", "u1", 5), ("m", "u2", 1)], "key string, url string, seq long")
    b = spark.createDataFrame([("k", "u3", 0), ("n", "u4", 0)], "key string, url string, seq long")
    assert {(r.key, r.source, r.url) for r in governance.inventory([("crawl", a), ("sitemap", b)]).collect()} == {("k", "crawl", "u1"), ("m", "crawl", "u2"), ("n", "sitemap", "u4")}


BLOCKS = (
    "page_id long, index int, format string, types array<string>, ids array<string>, properties map<string,array<string>>, fingerprint string, error string, "
    "truncated boolean, contexts array<string>, `references` array<string>, diagnostics array<string>, script_type string, root string"
)


def block(page, index, form="json_ld", types=("Thing",), ids=("e",), properties=None, fingerprint=None, error=None, truncated=False, contexts=("https://schema.org",), references=(), told=(), script="application/ld+json", root="object"):
    return (page, index, form, list(types), list(ids), properties or {}, fingerprint or f"f{page}-{index}", error, truncated, list(contexts), list(references), list(told), script, root)


@pytest.mark.parametrize(
    ("codes", "row"),
    [
        ({"json_ld_invalid_json", "json_ld_empty_block"}, {"error": "invalid_json", "root": "empty", "types": ()}),
        ({"json_ld_scalar_root", "json_ld_missing_type"}, {"error": "no_type", "root": "scalar", "types": ()}),
        ({"json_ld_truncated", "json_ld_missing_context"}, {"truncated": True, "contexts": ()}),
        ({"json_ld_unrecognized_context", "json_ld_unsupported_script_type"}, {"contexts": ("https://Schema.ORG", "http://x.test"), "script": None}),
        (set(), {"script": " Application/LD+json ;charset=x"}),
        ({"microdata_missing_itemtype", "microdata_empty_itemscope", "microdata_unresolved_itemref"}, {"form": "microdata", "types": (), "told": ("microdata_unresolved_itemref:x",)}),
        ({"microdata_property_outside_scope", "microdata_invalid_itemid"}, {"form": "microdata", "properties": {"p": ["1"]}, "told": ("microdata_property_outside_scope", "microdata_invalid_itemid")}),
        ({"rdfa_missing_vocabulary_context", "rdfa_property_without_subject"}, {"form": "rdfa", "contexts": (), "ids": (), "properties": {"p": ["1"]}}),
        ({"rdfa_invalid_prefix_mapping", "rdfa_unsupported_pattern"}, {"form": "rdfa", "told": ("rdfa_invalid_prefix_mapping", "rdfa_unsupported_pattern")}),
    ],
)
def test_structured_block_codes(spark, codes, row):
    assert {r.code for r in structured.block_findings(spark.createDataFrame([block(1, 0, **row)], BLOCKS)).collect()} == codes


def test_structured_entity_and_site_codes(spark):
    rows = [
        block(1, 0, types=("Article", "@bad"), properties={"name": ["", " "], "sameAs": ["/x", "HTTP://y"], "tag": ["a", "a"]}, references=("e", "far"), told=("property_missing_value:name",), fingerprint="same"),
        block(2, 0, ids=(), fingerprint="same"),
        block(3, 0, types=("Hotel",)),
        block(3, 1, form="microdata", types=("Restaurant",), ids=("m",), fingerprint="micro"),
        block(4, 0, form="microdata", types=("Hotel",), ids=("m",), fingerprint="micro"),
    ]
    own = spark.createDataFrame(rows, BLOCKS)
    assert {(r.page_id, r.entity, r.code, r.subject) for r in structured.entity_findings(own).collect()} == {
        (1, 0, "property_empty_value", "name"), (1, 1, "property_empty_value", "name"), (1, 0, "property_missing_value", "name"), (1, 1, "property_missing_value", "name"),
        (1, 0, "property_duplicate_value", "tag"), (1, 1, "property_duplicate_value", "tag"), (1, 0, "property_url_invalid", "sameAs"), (1, 1, "property_url_invalid", "sameAs"),
        (1, 0, "property_reference_unresolved", "far"), (1, 1, "property_reference_unresolved", "far"), (1, 1, "json_ld_invalid_type", None), (2, 0, "entity_missing_identifier", None),
    }
    assert {(r.page_id, r.code, r.subject) for r in structured.consistency_findings(own).collect()} == {
        (1, "json_ld_duplicate_block", "same"), (3, "entity_duplicate_on_page", "micro"), (1, "json_ld_duplicate_entity_id", "e"), (1, "entity_inconsistent_across_pages", "e"), (1, "entity_conflicting_types", "e"),
        (1, "page_multiple_primary_entities", None), (3, "page_multiple_primary_entities", None), (None, "sitewide_schema_inconsistency", None),
    }
    pages = spark.createDataFrame([(1, 404, "text/html; charset=x", "indexable"), (2, 200, "application/pdf", "non_indexable"), (3, None, None, None)], "page_id long, http_status int, content_type string, indexability_state string")
    assert {(r.page_id, r.code) for r in structured.page_findings(own, pages).collect()} == {(1, "page_structured_data_on_error_status"), (2, "page_structured_data_on_non_html_content"), (2, "page_structured_data_on_nonindexable_page")}
    found = structured.findings(own, pages)
    assert found.where("severity is null").isEmpty() and {r.severity for r in found.where("code = 'property_duplicate_value'").collect()} == {"info"}
    acts = {(r.page_id, r.action, r.scope) for r in structured.recommendations(own, found).collect()}
    assert {(None, "review_sitewide_schema_inconsistency", "site"), (1, "review_article_publisher", "entity"), (3, "review_schema_format_mix", "page"), (2, "review_unknown_type", "entity"), (1, "fix_empty_property", "page")} <= acts
    none = own.where("false")
    assert structured.findings(none, pages).isEmpty() and structured.recommendations(none, structured.findings(none, pages)).isEmpty()


@pytest.mark.parametrize(
    ("name", "values", "state"),
    [
        ("name", None, "missing"), ("name", [], "empty"), ("name", [" "], "empty"), ("name", ["a", " a"], "present"), ("name", ["a", "b"], "conflicting"), ("author", ["a", "b"], "present"), ("author", ["[structured]"], "indeterminate"),
        ("url", ["/x"], "invalid"), ("url", ["HTTPS://x.test"], "present"), ("url", ["http:///x"], "invalid"), ("price", ["1e3"], "present"), ("price", ["3,50"], "invalid"), ("priceCurrency", ["EUR"], "present"), ("priceCurrency", ["EU1"], "invalid"),
        ("datePublished", ["2024-01-02T03"], "present"), ("startDate", ["2024-1-2"], "invalid"), ("startDate", ["2024-01-0"], "invalid"),
    ],
)
def test_profile_states(spark, name, values, state):
    df = spark.createDataFrame([(name, values)], "n string, v array<string>")
    assert df.select(structured.profile_state(F.col("n"), F.col("v")).alias("s")).first().s == state


def test_structured_profiles(spark):
    own = spark.createDataFrame([
        block(1, 0, "microdata", ["https://schema.org/Product"], properties={"name": ["x"], "offers": [" "]}, fingerprint="f1"), block(2, 0, types=["Physician"], fingerprint="f2"),
        block(2, 1, types=[], ids=[], fingerprint="f3"), block(3, 0, types=["Product"], properties={"name": ["x"]}, fingerprint="f1"),
    ], BLOCKS)
    states = {(r.page_id, r.profile, r.property): r.state for r in structured.profile_observations(own).collect()}
    assert states == {
        (1, "Product", "name"): "present", (1, "Product", "offers"): "empty", (2, "LocalBusiness", "name"): "missing", (2, "LocalBusiness", "address"): "missing", (3, "Product", "name"): "present", (3, "Product", "offers"): "missing",
    }
    assert [(r.fingerprint, r.kind) for r in structured.duplicates(own).collect()] == [("f1", "cross_page_duplicate")]
    assert structured.entity_consistency(own).first().pages == 3


def test_unmapped_source(spark):
    sources = spark.createDataFrame([("http://other/x", None)], "source_url string, proposed string")
    planned = spark.createDataFrame([], "source_url string, destination_url string, expected_status int")
    pages = spark.createDataFrame([], "page_id long, url string, final_url string, canonical_url string, title string, description string, category string, indexable boolean")
    r = migration.mappings(sources, planned, pages, pages, "http://old", "http://new").first()
    assert (r.method, r.state, r.cardinality, r.confidence) == ("unmapped", "unmapped", "unmapped", "indeterminate")


def test_result_pages(spark):
    df = spark.range(30).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"), F.concat(F.lit("Row "), "id").alias("t"))
    seen, after = [], None
    while rows := resultset.keyset_page(df, ["a", "b"], after, 7).collect():
        seen += [(r.a, r.b) for r in rows]
        after = seen[-1]
    assert seen == sorted((i % 3, i) for i in range(30))
    assert resultset.filtered(df, {"min_b": 10, "contains_t": "ROW 1", "a": 1}).count() == 4
    with pytest.raises(ValueError, match="unknown filter"):
        resultset.filtered(df, {"nothing": 1})
    c = resultset.cursor({"a": 1}, 20)
    assert resultset.cursor_position(c, {"a": 1}) == 20
    with pytest.raises(ValueError, match="other filters"):
        resultset.cursor_position(c, {"a": 2})
    assert resultset.any_field_contains(df, "ROW 29").count() == 1 and resultset.capped(df, 5)[1] is True
    assert resultset.latest(df, ["a"], [F.desc("b")]).agg(F.sum("b")).first()[0] == 27 + 28 + 29


def test_planned_graph(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("s", "s"), ("one", "end")]
    got = {r.source_url: r.diagnostic for r in migration.planned_graph(spark.createDataFrame(rows, "source_url string, destination_url string")).collect()}
    assert got == {"a": "redirect_map_chain", "b": "redirect_map_chain", "c": None, "x": "redirect_map_loop", "y": "redirect_map_loop", "s": "redirect_map_loop", "one": None}


def test_inventory_states(spark):
    rows = [(0, "http://a.com/1", "d1"), (1, "http://a.com/1", "d2"), (2, "http://a.com/2", None), (3, "http://A.com/2", None), (4, "ftp://x", None), (5, "http://b.com/", None)]
    got = {r.seq: r.state for r in migration.inventory_states(spark.createDataFrame(rows, "seq long, raw string, proposed string"), "http://a.com").collect()}
    assert got == {0: "conflict", 1: "conflict", 2: "valid", 3: "duplicate", 4: "invalid", 5: "out_of_scope"}


def test_freshness(spark):
    df = spark.sql("select timestamp'2024-01-01' as a, timestamp'2024-03-01' as b, cast(null as timestamp) as c")
    assert tuple(df.select(migration.freshness(F.col("a"), F.col("b")), migration.freshness(F.col("b"), F.col("b")), migration.freshness(F.col("c"), F.col("b"))).first()) == ("stale", "current", "unknown")


def test_mapping_codes_and_sitewide(spark):
    sources = spark.createDataFrame([(f"http://o/{i}", None) for i in range(12)] + [("http://x/1", None)], "source_url string, proposed string")
    planned = spark.createDataFrame([("http://o/1", "http://n/a"), ("http://o/1", "http://n/b"), ("http://o/2", "http://n/c"), ("http://o/3", "http://n/c")], "source_url string, destination_url string")
    none = spark.createDataFrame([], "page_id long, url string, final_url string, canonical_url string, title string, description string, category string, indexable boolean")
    mapped = migration.mappings(sources, planned, none, none, "http://o", "http://n")
    got = {(r.source_url, r.code, r.confidence) for r in migration.mapping_findings(mapped).collect()}
    assert got == {
        ("http://x/1", "mapping_unmapped", "indeterminate"), ("http://o/1", "mapping_ambiguous", "low"), ("http://o/1", "mapping_one_to_many", "low"), ("http://o/1", "mapping_conflicting_explicit", "low"),
        ("http://o/1", "redirect_one_to_many_review", "low"), ("http://o/1", "content_split_review", "low"),
        *((f"http://o/{i}", c, "medium") for i in (2, 3) for c in ("mapping_many_to_one", "mapping_destination_collision")),
    }
    found = spark.createDataFrame([("mapping_unmapped",)] * 3 + [("destination_404",)] * 2 + [("destination_5xx",)] + [("redirect_chain",)] * 2, "code string")
    metrics = migration.sitewide(found, mapped)
    assert {(r.code, r.occurrences, r.affected) for r in migration.sitewide_findings(metrics).collect()} == {("sitewide_unmapped_source_urls", 3, 3), ("sitewide_destination_errors", 3, 3)}
    assert {r.state for r in migration.sitewide(found, mapped.limit(9)).collect()} == {"small_inventory"}


def test_migration_evidence_findings(spark):
    mapped = spark.createDataFrame([("http://o/1", "http://n/1"), ("http://o/2", "http://n/2"), ("http://o/3", None)], "source_url string, destination_url string")
    pages = spark.createDataFrame([("http://n/1", 200, 1, True, "http://n/1"), ("http://n/2", 404, 0, False, "http://n/9")], "url string, http_status int, redirect_count int, indexable boolean, canonical_url string")
    links = spark.createDataFrame([(1, "http://o/1"), (1, "http://n/1"), (1, "http://n/2"), (1, "http://staging.x/1")], "page_id long, target string")
    assert {(r.target, r.code) for r in migration.link_findings(links, pages, "http://o", "http://n").collect()} == {("http://o/1", "internal_link_to_legacy_url"), ("http://n/1", "internal_link_to_redirect"), ("http://n/2", "internal_link_to_broken_destination"), ("http://staging.x/1", "internal_link_to_staging_host"), ("http://staging.x/1", "internal_link_host_mismatch")}
    old = spark.createDataFrame([(1, "http://o/1"), (1, "http://o/2"), (1, "http://o/3")], "page_id long, target string")
    assert [r.source_url for r in migration.unlinked_targets(old, mapped, links.where("target <> 'http://n/2'")).collect()] == ["http://o/2"]
    entries = spark.createDataFrame([("http://o/5",), ("http://n/2",)], "url string")
    assert {(r.url, r.code) for r in migration.sitemap_findings(entries, mapped, pages, "http://o", "http://n").collect()} == {("http://o/5", "legacy_url_in_destination_sitemap"), ("http://n/2", "broken_url_in_sitemap"), ("http://n/2", "nonindexable_url_in_sitemap"), ("http://n/2", "canonical_conflict_in_sitemap"), ("http://n/1", "destination_url_missing_from_sitemap")}
    schema = "page_url string, src string, alt string, width string, height string, loading string"
    was = spark.createDataFrame([("http://o/1", "a", "x", "1", "1", None), ("http://o/1", "b", "x", "1", "1", None), ("http://o/2", "c", "x", "1", "1", "lazy"), ("http://o/2", "d", "x", "1", None, None), ("http://o/2", "e", None, "1", "1", None)], schema)
    now = spark.createDataFrame([("http://n/1", "a", "x", "1", "1", None), ("http://n/2", "c", None, "1", "1", None), ("http://n/2", "d", "y", "1", "2", None), ("http://n/2", "e", None, "1", "1", None)], schema)
    assert {(r.src, r.code) for r in migration.image_findings(mapped, was, now).collect()} == {
        ("b", "image_missing_after_migration"), ("c", "image_alt_missing_after_migration"), ("c", "image_loading_regression"), ("d", "image_alt_materially_changed"), ("d", "image_dimension_regression"),
    }
    shown = spark.createDataFrame([("p", "http://o/i", 200, False), ("p", "http://dev.n/i", 404, True), ("p", "http://n/dev/i", None, None)], "page_url string, resolved string, http_status int, redirected boolean")
    assert {(r.resolved, r.code) for r in migration.image_references(shown, "http://o").collect()} == {
        ("http://o/i", "image_legacy_host_reference"), ("http://dev.n/i", "image_staging_host_reference"), ("http://dev.n/i", "image_broken_after_migration"), ("http://dev.n/i", "image_redirect_dependency"),
    }
    schema = "page_url string, type string, format string, error string"
    blocks = spark.createDataFrame([("http://o/1", "T", "json_ld", None), ("http://o/2", "T", "json_ld", None)], schema)
    new = spark.createDataFrame([("http://n/2", "U", "json_ld", "invalid_json")], schema)
    assert {(r.source_url, r.code) for r in migration.structured_findings(mapped, blocks, new).collect()} == {("http://o/1", "structured_data_removed"), ("http://o/2", "structured_data_type_changed"), ("http://o/2", "structured_data_invalid_after_migration")}


def test_page_projection(spark):
    from auditlake.sources import html

    page = '<html lang="de"><title>A</title><title>B</title><link rel=canonical href="https://b.com/x"><meta name=robots content="noindex">'
    rows = [(1, "https://a.com/x", page, 200, "text/html", 0), (2, "https://a.com/y", None, None, None, 1), (3, "https://a.com/z", "", 404, "image/png", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, http_status int, content_type string, discovery_order int")
    got = {r.page_id: r for r in html.page_projection(html.parsed(df), "run").collect()}
    assert got[1].title_presence == "multiple" and got[1].canonical_cross_host and got[1].meta_noindex and got[1].language == "de" and got[1].category == "html" and got[1].parsed_as_html
    assert {"multiple_titles", "conflicting_titles", "short_title", "missing_meta_description", "cross_host_canonical", "parser_recovery_used"} <= set(got[1].warnings)
    assert got[2].fetch_failed and got[2].title_presence == "unavailable" and got[3].category == "image" and not got[3].parsed_as_html
    import hashlib

    identity = hashlib.sha256(b"https://a.com/x").hexdigest()
    assert got[1].identity == identity and got[1].evidence_id == hashlib.sha256(b"run\x000\x00" + identity.encode()).hexdigest()


def test_image_and_block_aggregates(spark):
    rows = [(1, "lazy", "missing_alt", "add_alt", "high"), (1, "missing", "valid_image_occurrence", "no_action", "info"), (2, "lazy", "missing_alt", "add_alt", "medium")]
    own = spark.createDataFrame([(p, 0, "s", l, r, a, s) for p, l, r, a, s in rows], "page_id long, index int, src string, loading_state string, reason string, action string, severity string")
    assert {r.loading_state: r.occurrences for r in images.loading_distribution(own).collect()} == {"lazy": 2, "missing": 1}
    assert images.findings(own).count() == 2 and {(r.src, r.action, r.pages) for r in images.recommendations(own).collect()} == {("s", "add_alt", 2)}
    blocks = spark.createDataFrame([(1, ["Article"], "f"), (1, ["Person"], "g"), (2, ["Article"], "h")], "page_id long, types array<string>, fingerprint string")
    assert {(r.page_id, r.blocks, r.entities) for r in structured.page_counts(blocks).collect()} == {(1, 2, 2), (2, 1, 1)}
    assert {(r.type_set, r.pages) for r in structured.type_sets(blocks).collect()} == {("Article,Person", 1), ("Article", 1)}
    counts = spark.createDataFrame([("a", 2), ("b", 5)], "run string, stored long")
    actual = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "run string")
    assert {(r.run, r.stored, r.actual) for r in resultset.reconciled(counts, actual, "run", "stored").collect()} == {("b", 5, 1), ("c", None, 1)}


def test_duplicate_titles_and_their_samples(spark):
    titles = ["Red  Boots", "red boots", "ＲＥＤ boots", "Straße", "STRASSE", "alone", "", None]
    df = spark.createDataFrame([(10 - i, t) for i, t in enumerate(titles)], "page_id long, title string")
    assert {(r.members, r.first_page) for r in metadata.duplicate_groups(df, "title", [], "title").collect()} == {(3, 8), (2, 6)}
    assert {(r.kind, r.members, r.first_page, r.sample) for r in metadata.duplicate_samples(df, "title", [], "title", 2).collect()} == {("title", 3, 8, "8,9"), ("title", 2, 6, "6,7")}
