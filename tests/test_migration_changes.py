"""Inputs of a migration, and what changed between its crawls, against literal rows."""

import pytest
from pyspark.sql import functions as F

from auditlake.operators import migration, migration_changes, migration_inputs

OLD, NEW = "https://old.example", "https://new.example"


def test_inventory_rows(spark):
    rows = [
        (0, "https://old.example/1", NEW + "/a", ""), (1, "HTTPS://OLD.example/1#x", NEW + "/a", ""), (2, "/1", NEW + "/b", ""), (3, "ftp://old.example/", None, ""), (4, "https://old.example:x/", None, ""), (5, "https://else.example/", None, ""),
        (6, "/2", None, ""), (7, "/2", None, ""), (8, "/3", None, "n" * 4097), (9, "/3", NEW + "/c", ""), (10, "", None, ""),
    ]
    got = {r["seq"]: (r["state"], r["diagnostics"]) for r in migration_inputs.inventory(spark.createDataFrame(rows, "seq long, raw string, proposed string, note string"), OLD, NEW, ("raw", "note")).collect()}
    conflict, duplicate = "inventory_conflicting_destination", "inventory_duplicate_source"
    assert got == {
        0: ("conflict", [conflict]), 1: ("duplicate", [duplicate]), 2: ("conflict", [conflict, duplicate]), 3: ("invalid", ["inventory_unsupported_scheme"]), 4: ("invalid", ["inventory_invalid_url"]), 5: ("out_of_scope", ["inventory_out_of_scope"]),
        6: ("valid", []), 7: ("duplicate", [duplicate]), 8: ("invalid", ["inventory_field_too_long", conflict]), 9: ("conflict", [conflict, duplicate]), 10: ("invalid", ["inventory_invalid_url"]),
    }


def test_redirect_map_rows(spark):
    rows = [
        (0, OLD + "/a", NEW + "/a", "301"), (1, "/a", "/a", "301"), (2, OLD + "/a", NEW + "/b", "302"), (3, OLD + "/c", NEW + "/a", "308"), (4, OLD + "/a", NEW + "/a", "301"), (5, OLD + "/d", OLD + "/e", ""), (6, OLD + "/e", NEW + "/e", "404"),
        (7, OLD + "/f", OLD + "/g", "301"), (8, OLD + "/g", OLD + "/h", "301"), (9, OLD + "/h", OLD + "/g", "301"), (10, "", NEW + "/x", "301"), (11, OLD + "/i", "bad host", "x"),
    ]
    got = {r["seq"]: (r["state"], set(r["diagnostics"])) for r in migration_inputs.redirect_map(spark.createDataFrame(rows, "seq long, raw_source string, raw_destination string, status string"), OLD, NEW).collect()}
    collision = "redirect_destination_collision"
    assert got == {
        0: ("valid", {collision}), 1: ("duplicate", {"redirect_map_duplicate_source", collision}), 2: ("conflict", {"redirect_map_conflicting_destination"}), 3: ("valid", {collision}),
        # The source is known there by then, and no new one follows.
        4: ("duplicate", {"redirect_map_duplicate_source"}), 5: ("valid", {"redirect_map_status_missing"}), 6: ("invalid", {"redirect_map_unsupported_status"}),
        7: ("valid", {"redirect_map_loop", collision}), 8: ("valid", {"redirect_map_loop"}), 9: ("valid", {"redirect_map_loop", collision}), 10: ("invalid", {"redirect_map_invalid_url"}), 11: ("invalid", {"redirect_map_invalid_url", "redirect_map_status_missing"}),
    }


GOOD = {
    "configuration_valid": True, "destination_known": True, "destination_terminal": True, "destination_pages": 5, "evidence_expired": False, "foreign_versions": 0, "sources": 3, "bad_sources": 0, "bad_redirects": 0, "source_run_named": False, "source_run_usable": False,
    "compare_internal_links": True, "compare_sitemaps": True, "compare_images": True, "compare_structured_data": True, "links": 1, "sitemaps": 1, "images": 1, "structured_data": 1,
}
CASES = [
    ({}, "ready", [], None),
    ({"configuration_valid": False, "sources": 0}, "invalid_configuration", ["configuration_snapshot_invalid", "source_inventory_missing"], "readiness_invalid_configuration"),
    ({"destination_known": False, "destination_pages": 0}, "missing_evidence", ["destination_run_missing"], "readiness_missing_evidence"),
    ({"destination_terminal": False}, "missing_evidence", ["destination_run_nonterminal"], "readiness_missing_evidence"),
    ({"destination_pages": 0, "evidence_expired": True}, "missing_evidence", ["destination_page_evidence_missing"], "readiness_missing_evidence"),
    ({"evidence_expired": True, "foreign_versions": 2, "links": 0}, "expired", ["destination_page_evidence_expired", "internal_link_evidence_missing"], "readiness_expired_evidence"),
    ({"foreign_versions": 2}, "incompatible", ["destination_page_evidence_version_unsupported"], "readiness_incompatible_evidence"),
    ({"evidence_expired": True, "sources": 0}, "missing_evidence", ["destination_page_evidence_expired", "source_inventory_missing"], "readiness_missing_evidence"),
    ({"bad_sources": 1, "bad_redirects": 1}, "ready_with_warnings", ["source_inventory_contains_invalid_rows", "redirect_map_contains_invalid_or_conflicting_rows"], None),
    ({"source_run_named": True, "images": 0, "compare_sitemaps": False, "sitemaps": 0}, "ready_with_warnings", ["source_comparison_evidence_missing", "image_evidence_missing"], None),
    ({"structured_data": None}, "ready_with_warnings", ["structured_data_evidence_missing"], None),
]


def test_readiness(spark):
    schema = "i int, " + ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'long'}" for k, v in GOOD.items())
    df = spark.createDataFrame([(i, *(GOOD | c[0]).values()) for i, c in enumerate(CASES)], schema)
    got = {r["i"]: (r["state"], r["reasons"], r["code"]) for r in migration_inputs.readiness(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(CASES)}


PAGE = "page_id long, url string, final_url string, http_status int, title string, description string, category string, canonical_url string, indexable boolean, meta_robots string, x_robots string, language string"


def page(i, url, title="Red boots", description="All of them", category="html", canonical=None, indexable=True, robots=None, language="en", status=200, final=None):
    return (i, url, final, status, title, description, category, canonical, indexable, robots, None, language)


def compared(spark, old, new, pairs=(("o", "n"),)):
    mapped = spark.createDataFrame([*pairs], "source_url string, destination_url string")
    got = migration_changes.page_comparisons(mapped, spark.createDataFrame(old, PAGE), spark.createDataFrame(new, PAGE)).collect()
    return [(r["status_state"], r["metadata_state"], r["content_state"], r["canonical_state"], r["indexability_state"], r["similarity"], r["codes"].split(",")) for r in got]


def test_pages_compared(spark):
    assert compared(spark, [page(1, "o")], [page(1, "n", title="RED  boots")]) == [("preserved", "preserved", "preserved", "preserved", "preserved", "1.000000", ["content_likely_preserved"])]
    got = compared(spark, [page(1, "o")], [page(1, "n", "zzzzzz", None, "pdf", "c", False, "noindex", "de", 404)])
    assert got == [("changed", "changed", "changed", "changed", "changed", "0.000000", [
        "title_materially_changed", "meta_description_missing_after_migration", "canonical_target_changed", "robots_regression", "indexability_regression", "content_type_changed", "language_changed", "content_materially_changed", "content_similarity_low",
    ])]
    # Two of three comparable signals are equal: 0.667 is above 0.65.
    assert compared(spark, [page(1, "o", description=None)], [page(1, "n", title="Red boot", description=None)])[0][5:] == ("0.666667", ["content_likely_preserved"])
    assert compared(spark, [], [page(1, "n")])[0] == ("confirmed", "not_available", "indeterminate", "not_available", "not_available", None, ["source_metadata_unavailable", "content_similarity_indeterminate"])
    assert compared(spark, [page(1, "o")], [])[0] == ("missing", "not_available", "missing", "not_available", "not_available", None, ["content_missing"])
    # The later page of an address stands, found under its final address too.
    assert compared(spark, [page(1, "o")], [page(1, "n", "Else"), page(2, "m", final="n")])[0][2] == "preserved"


def test_signature_of_five(spark):
    old = spark.createDataFrame([("s1", *page(1, "s1")), ("s2", *page(2, "s2", title="Two")), ("s3", *page(3, "s3", title=None, description=None)), ("s4", *page(4, "s4", canonical="x"))], f"source_url string, {PAGE}")
    new = [page(1, "n1", title="red BOOTS"), page(2, "n2", title="Two", category="pdf"), page(3, "n3", title=None, description=None), page(4, "n4", canonical="x"), page(5, "n5", canonical="x"), page(6, "n6", final="n1")]
    got = {tuple(r) for r in migration.content_matches(old, spark.createDataFrame(new, PAGE)).collect()}
    # n6 ends at n1, which is one address; n4 and n5 are two; nulls equal nulls.
    assert got == {("s1", "n1"), ("s3", "n3")}


def test_link_graphs(spark):
    mapped = spark.createDataFrame([("o1", "n1", "mapped"), ("o2", "n2", "mapped"), ("o3", None, "unmapped")], "source_url string, destination_url string, state string")
    old = spark.createDataFrame([("o1", "o2"), ("o1", "o2"), ("o2", "o1"), ("o2", "x"), ("o1", None)], "page_url string, target string")
    new = spark.createDataFrame([("n1", "n2"), ("n1", "o3"), ("n2", "o3"), ("n2", "o1"), ("n2", None)], "page_url string, target string")
    assert {tuple(r) for r in migration_changes.link_changes(mapped, old, new).collect()} == {
        ("source_link_target_unmapped", "o3", None, 2, 2), ("navigation_target_regression", "o2", "n2", 2, 1), ("navigation_target_regression", "x", None, 1, 1),
        ("destination_orphan_candidate", "o1", "n1", 0, 0), ("redirect_dependency_sitewide", None, None, 3, 2),
    }
    assert {tuple(r) for r in migration_changes.edge_differences(mapped, old, new).collect()} == {
        ("n1", "n2", "kept", 2, 1), ("n2", "n1", "lost", 1, 0), ("n2", "x", "lost", 1, 0), ("n1", "o3", "gained", 0, 1), ("n2", "o3", "gained", 0, 1), ("n2", "o1", "gained", 0, 1),
    }
    none = new.where("false")
    assert {r["code"] for r in migration_changes.link_changes(mapped, none, none).collect()} == {"destination_orphan_candidate"}


BLOCK = "page_url string, block_id string, format string, error string, types array<string>, identifiers array<string>"


@pytest.mark.parametrize(
    ("new", "codes"),
    [
        (("json_ld", ["A", "B"], ["#1"]), set()),
        (("rdfa", ["B", "A"], ["#1"]), {("structured_data_format_changed", "gone=json_ld new=rdfa")}),
        (("json_ld", ["A"], ["#1"]), {("structured_data_type_changed", "gone=B new="), ("structured_data_profile_regression", "gone=B"), ("structured_data_identity_conflict", "shared=#1")}),
        (("json_ld", ["A", "B", "C"], ["#2"]), {("structured_data_type_changed", "gone= new=C"), ("structured_data_profile_regression", "gone="), ("structured_data_entity_id_changed", "gone=#1 new=#2")}),
        (("json_ld", ["A", "B"], None), {("structured_data_entity_id_changed", "gone=#1 new=")}),
    ],
)
def test_structured_changes(spark, new, codes):
    mapped = spark.createDataFrame([("o", "n")], "source_url string, destination_url string")
    old = spark.createDataFrame([("o", "1", "json_ld", None, ["A"], ["#1"]), ("o", "2", "json_ld", None, ["B"], [])], BLOCK)
    new_blocks = spark.createDataFrame([("n", "3", new[0], None, new[1], new[2])], BLOCK)
    none = spark.createDataFrame([], "url string, final_url string, indexable boolean")
    assert {(r["code"], r["detail"]) for r in migration_changes.structured_changes(mapped, old, new_blocks, none).collect()} == codes


def test_structured_data_gone_broken_or_unseen(spark):
    mapped = spark.createDataFrame([("o", "n")], "source_url string, destination_url string")
    old = spark.createDataFrame([("o", "1", "json_ld", None, ["A"], ["#1"]), ("p", "2", "json_ld", None, ["A"], ["#1"])], BLOCK)
    new = spark.createDataFrame([("q", "3", "json_ld", "invalid_json", [], []), ("r", "4", "json_ld", None, ["A"], [])], BLOCK)
    pages = spark.createDataFrame([("r0", "r", False), ("q", None, True)], "url string, final_url string, indexable boolean")
    assert {tuple(r) for r in migration_changes.structured_changes(mapped, old, new, pages).collect()} == {
        ("structured_data_removed", "o", "n", None, None), ("structured_data_removed", "p", None, None, None), ("structured_data_invalid_after_migration", None, "q", "3", "invalid_json"), ("structured_data_nonindexable_destination", None, "r", "4", None),
    }


def test_entities_by_path(spark):
    assert migration_changes.flat({"a": {"b": [1, {"c": "x"}]}, "d": None, "e": True}) == {"a.b[0]": "1", "a.b[1].c": "x", "d": "null", "e": "true"}
    mapped = spark.createDataFrame([("o", "n"), ("p", None)], "source_url string, destination_url string")
    old = spark.createDataFrame([("o", "#1", '{"name": "A", "offers": {"price": 3}}'), ("o", "#2", '{"name": "B"}'), ("o", "#3", "broken"), ("p", "#1", '{"x": 1}')], "page_url string, entity string, json string")
    new = spark.createDataFrame([("n", "#1", '{"name": "A", "offers": {"price": "4"}, "brand": "Z"}'), ("n", "#3", "[1]")], "page_url string, entity string, json string")
    assert {tuple(r)[2:] for r in migration_changes.entity_differences(mapped, old, new).collect()} == {("#1", "offers.price", "changed", "3", "4"), ("#1", "brand", "added", None, "Z"), ("#2", "name", "removed", "B", None)}
    assert migration_changes.entity_differences(mapped, old.where("false"), new.where(F.lit(False))).count() == 0
