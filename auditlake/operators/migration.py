"""Website migration: mapping of old to new URLs, findings, recommendations, sitewide patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.functions.text import nfkc_casefold, sequence_ratio, stable_id
from auditlake.functions.urls import normalize_url
from auditlake.shared import written

#: Mapping methods in order of precedence, with their confidence. Fixed values.
METHODS = (
    ("explicit_redirect_map", "high"), ("explicit_proposed_destination", "high"), ("observed_redirect", "high"), ("exact_normalized_url", "high"), ("configured_origin_substitution", "medium"), ("path_match", "low"), ("canonical_hint", "low"),
    ("content_similarity_hint", "low"),
)
DECISIVE = ("explicit_redirect_map", "explicit_proposed_destination", "observed_redirect")
#: Code, condition on a joined mapping, category, action, confidence. A condition sees the mapping, the planned row, the
#: page observed under the old URL (observed_*), the destination (page_*), the old page (old_*) and the page that the
#: destination's canonical names (c_*). Fixed values.
FINDINGS = (
    ("redirect_missing", "planned AND NOT observed", "redirect", "add_missing_redirect", "high"), ("redirect_wrong_destination", "observed AND observed_final <> destination_url", "redirect", "correct_redirect_destination", "high"),
    ("redirect_temporary", "observed_status IN (302, 307)", "redirect", "replace_temporary_redirect", "high"), ("redirect_status_mismatch", "planned AND observed_status <> expected_status", "redirect", "correct_redirect_destination", "high"),
    ("redirect_loop", "observed_loop", "redirect", "resolve_redirect_loop", "high"), ("redirect_chain", "observed_hops > 1", "redirect", "shorten_redirect_chain", "high"), ("redirect_to_error", "page_status >= 400", "redirect", "fix_redirect_to_error", "high"),
    ("redirect_to_nonindexable", "page_known AND NOT page_indexable", "redirect", "remove_destination_noindex", "high"), ("redirect_to_external", "target_origin NOT IN (source_origin, destination_origin)", "redirect", "correct_redirect_destination", "high"),
    ("redirect_to_out_of_scope", "target_origin = source_origin", "redirect", "correct_redirect_destination", "high"), ("redirect_query_dropped", "source_url LIKE '%?%' AND destination_url NOT LIKE '%?%'", "redirect", "review_query_string_policy", "high"),
    ("redirect_many_to_one_review", "cardinality = 'many_to_one'", "redirect", "review_many_to_one_mapping", "medium"), ("redirect_destination_collision", "cardinality = 'many_to_one'", "redirect", "resolve_mapping_conflict", "medium"),
    ("content_consolidated", "cardinality = 'many_to_one'", "content", "review_many_to_one_mapping", "medium"), ("destination_missing", "NOT page_known", "destination", "restore_missing_destination_page", "high"),
    ("destination_status_unknown", "page_known AND page_status IS NULL", "destination", "fix_destination_error", "indeterminate"), ("destination_404", "page_status = 404", "destination", "restore_missing_destination_page", "high"),
    ("destination_410", "page_status = 410", "destination", "restore_missing_destination_page", "high"), ("destination_other_4xx", "page_status BETWEEN 400 AND 499 AND page_status NOT IN (404, 410)", "destination", "fix_destination_error", "high"),
    ("destination_5xx", "page_status >= 500", "destination", "fix_destination_error", "high"), ("destination_redirecting", "page_status BETWEEN 300 AND 399 OR (page_status < 300 AND page_hops > 0)", "destination", "correct_redirect_destination", "high"),
    ("destination_non_html", "page_category <> 'html'", "destination", "fix_destination_error", "high"), ("destination_noindex", "page_known AND NOT page_indexable", "destination", "remove_destination_noindex", "high"),
    ("destination_blocked_by_robots", "page_robots = false", "destination", "review_robots_block", "high"), ("destination_canonical_missing", "page_known AND page_canonical IS NULL", "destination", "correct_destination_canonical", "high"),
    ("destination_canonical_elsewhere", "page_canonical <> destination_url", "destination", "correct_destination_canonical", "high"), ("source_metadata_unavailable", "page_known AND NOT old_known", "metadata", "review_content_continuity", "indeterminate"),
    ("content_similarity_indeterminate", "page_known AND NOT old_known", "content", "review_content_continuity", "indeterminate"), ("title_missing_after_migration", "page_known AND old_title IS NOT NULL AND page_title IS NULL", "metadata", "restore_missing_metadata", "high"),
    ("title_materially_changed", "title_changed", "metadata", "review_material_metadata_change", "medium"), ("canonical_target_changed", "page_known AND old_known AND NOT canonical_same", "metadata", "review_canonical_conflict", "medium"),
    ("meta_description_missing_after_migration", "page_known AND old_description <> '' AND coalesce(page_description, '') = ''", "metadata", "restore_missing_metadata", "high"),
    ("meta_description_materially_changed", "description_changed", "metadata", "review_material_metadata_change", "medium"),
    ("content_missing", "NOT page_known", "content", "restore_missing_destination_page", "high"),
    ("content_type_changed", "old_category <> page_category", "metadata", "review_content_continuity", "high"), ("language_changed", "old_language <> page_language", "metadata", "review_material_metadata_change", "medium"),
    ("indexability_regression", "page_known AND old_indexable AND NOT page_indexable", "metadata", "review_indexability_regression", "high"), ("canonical_points_to_legacy_url", "page_canonical LIKE concat(source_origin, '%')", "canonical", "review_canonical_conflict", "high"),
    ("canonical_points_to_wrong_host", "canonical_origin <> destination_origin", "canonical", "correct_destination_canonical", "high"), ("canonical_points_to_redirect", "c_hops > 0", "canonical", "correct_destination_canonical", "high"),
    ("canonical_points_to_error", "c_status >= 400", "canonical", "correct_destination_canonical", "high"), ("canonical_self_reference_regression", "old_canonical = source_url AND page_known AND (page_canonical IS NULL OR page_canonical <> destination_url)", "canonical", "review_canonical_conflict", "medium"),
    ("canonical_conflicts_with_redirect", "page_canonical <> destination_url", "canonical", "review_canonical_conflict", "high"), ("canonical_regression", "page_canonical <> destination_url", "metadata", "review_canonical_conflict", "high"),
    ("destination_noindex_regression", "page_known AND old_indexable AND NOT page_indexable", "indexability", "review_indexability_regression", "high"), ("destination_robots_block_regression", "old_robots AND page_robots = false", "indexability", "review_robots_block", "high"),
    ("legacy_url_still_indexable", "observed_indexable", "indexability", "review_indexability_regression", "high"), ("duplicate_source_and_destination_indexable", "observed_indexable AND page_known AND page_indexable", "indexability", "review_indexability_regression", "high"),
)
#: Code, cardinality of a mapping, action, confidence. Fixed values.
MAPPING_CODES = (
    ("mapping_unmapped", "unmapped", "map_unmatched_source_url", "indeterminate"),
    ("mapping_ambiguous", "ambiguous", "verify_manual_mapping", "low"),
    ("mapping_ambiguous", "one_to_many", "verify_manual_mapping", "low"),
    ("mapping_one_to_many", "one_to_many", "review_one_to_many_mapping", "low"),
    ("mapping_conflicting_explicit", "one_to_many", "resolve_mapping_conflict", "low"),
    ("redirect_one_to_many_review", "one_to_many", "review_one_to_many_mapping", "low"),
    ("content_split_review", "one_to_many", "review_one_to_many_mapping", "low"),
    ("mapping_many_to_one", "many_to_one", "review_many_to_one_mapping", "medium"),
    ("mapping_destination_collision", "many_to_one", "resolve_mapping_conflict", "medium"),
)
ERROR_CODES = (
    "redirect_loop",
    "redirect_to_error",
    "redirect_map_loop",
    "destination_404",
    "destination_410",
    "destination_5xx",
    "content_missing",
    "canonical_points_to_error",
    "internal_link_to_broken_destination",
    "broken_url_in_sitemap",
    "image_broken_after_migration",
    "structured_data_invalid_after_migration",
)
INFO_CODES = ("content_likely_preserved", "structured_data_format_changed")
#: Sitewide codes and the findings that they count. Fixed values.
SITEWIDE = {
    "sitewide_legacy_host_references": ("internal_link_to_legacy_url", "image_legacy_host_reference", "legacy_url_in_destination_sitemap"), "sitewide_staging_host_references": ("internal_link_to_staging_host", "image_staging_host_reference"),
    "sitewide_redirect_dependency": ("internal_link_to_redirect", "image_redirect_dependency"), "sitewide_redirect_chain_pattern": ("redirect_chain",), "sitewide_temporary_redirect_pattern": ("redirect_temporary",),
    "sitewide_noindex_regression": ("destination_noindex_regression",), "sitewide_canonical_host_mismatch": ("canonical_points_to_wrong_host",), "sitewide_metadata_loss": ("title_missing_after_migration", "meta_description_missing_after_migration"),
    "sitewide_sitemap_regression": ("destination_url_missing_from_sitemap", "legacy_url_in_destination_sitemap"), "sitewide_structured_data_loss": ("structured_data_removed",),
    "sitewide_image_host_regression": ("image_legacy_host_reference", "image_staging_host_reference"), "sitewide_unmapped_source_urls": ("mapping_unmapped",),
    "sitewide_destination_errors": ("destination_404", "destination_410", "destination_other_4xx", "destination_5xx"),
}
#: The signals of a page's content signature and score. Fixed values.
SIGNALS = ("title_key", "description_key", "category", "canonical_url", "indexable")
MATERIAL_CHANGE, SITEWIDE_RATIO, SMALL_INVENTORY = 0.35, 0.2, 10
STAGING_LABELS = ("staging", "stage", "dev", "development", "test", "preview")


def severity_of(code: str) -> str:
    return "error" if code in ERROR_CODES else "info" if code in INFO_CODES else "warning"


def origin_of(url: str) -> Column:
    return F.regexp_extract(url, "^([a-z]+://[^/?#]+)", 1)


def inventory_states(rows: DataFrame, origin: str) -> DataFrame:
    """seq, state, normalized, proposed of an inventory (seq, raw, proposed): the first row of a URL stays valid, later ones are duplicates, and
    all rows of a URL with different destinations are in conflict."""
    own = rows.withColumn("u", normalize_url("raw")).select("seq", "raw", "proposed", F.col("u.normalized").alias("normalized"), F.col("u.origin").alias("origin"), F.col("u.error_code").alias("error_code"))
    per = own.where("normalized is not null").groupBy("normalized").agg(F.min("seq").alias("first"), F.countDistinct(F.coalesce("proposed", F.lit(""))).alias("ways"))
    joined = own.join(per, "normalized", "left")
    state = F.when(F.col("error_code").isNotNull(), "invalid").when(F.col("origin") != origin, "out_of_scope").when(F.col("ways") > 1, "conflict").when(F.col("seq") > F.col("first"), "duplicate").otherwise("valid")
    return joined.select("seq", state.alias("state"), "normalized", "proposed")


def planned_graph(planned: DataFrame) -> DataFrame:
    """source_url, diagnostic (redirect_map_loop, redirect_map_chain or null) by following planned destinations, a join a step.

    Steps double: after n rounds a pointer has followed 2**n destinations, so long chains take few joins. Each round is
    written. A pointer that has followed more destinations than there are sources goes around.
    """
    step = written(planned.groupBy("source_url").agg(F.max("destination_url").alias("to")).withColumn("hops", F.lit(1).cast("long")), "planned")
    sources, followed = step.count(), 1
    while followed <= sources:
        far = step.select(F.col("source_url").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"))
        moved = step.join(far, "to", "left")
        step = written(moved.select("source_url", F.coalesce("next", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("next").isNotNull().alias("moved")), "planned")
        if step.where("moved").isEmpty():
            break
        step, followed = step.drop("moved"), 2 * followed
    return step.select("source_url", F.when(F.col("hops") > sources, "redirect_map_loop").when(F.col("hops") > 1, "redirect_map_chain").alias("diagnostic"))


def with_signals(pages: DataFrame) -> DataFrame:
    """pages with title_key and description_key, under which texts count as equal."""
    return pages.withColumns({"title_key": nfkc_casefold("title"), "description_key": nfkc_casefold("description")})


def content_matches(old: DataFrame, new: DataFrame) -> DataFrame:
    """source_url, destination of old pages (source_url, url and the columns of SIGNALS) whose signature exactly one address of the new pages has.

    Signatures are equal where all five signals are, null with null. Addresses are counted in the same aggregation, so a
    signature that many pages share stays one row.
    """
    at = F.coalesce("final_url", "url")
    # The least and the largest address tell one from several without a set of them.
    one = with_signals(new).groupBy(*SIGNALS).agg(F.min(at).alias("destination"), F.max(at).alias("other")).where("destination = other").drop("other")
    named = one.select("destination", *(F.col(s).alias(f"new_{s}") for s in SIGNALS))
    same = [F.col(s).eqNullSafe(F.col(f"new_{s}")) for s in SIGNALS]
    return with_signals(old).join(named, same).select("source_url", "destination")


def mappings(sources: DataFrame, planned: DataFrame, old_pages: DataFrame, new_pages: DataFrame, source_origin: str, destination_origin: str) -> DataFrame:
    """source_url, destination_url, method, confidence, state, cardinality (one_to_many: several explicit destinations).

    sources: source_url, proposed. planned: source_url, destination_url. pages: url, final_url, canonical_url, title,
    description, category, indexable. Candidates of all methods are unions of equi-joins; a source with one explicit destination, or whose best
    method is decisive, or whose candidates agree is mapped; otherwise it is ambiguous.
    """
    places = {m: i for i, (m, _) in enumerate(METHODS)}

    def candidate(df: DataFrame, method: str) -> DataFrame:
        return df.select("source_url", F.col("destination").alias("destination_url"), F.lit(places[method]).alias("place")).where("destination_url is not null")

    new_urls = new_pages.select(F.explode(F.array_compact(F.array("url", "final_url"))).alias("destination")).distinct()
    paths = new_urls.withColumn("path", F.regexp_extract("destination", r"^[a-z]+://[^/]+(/[^?#]*)", 1)).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("destination").alias("destination")).where("n = 1")
    own_path = sources.withColumn("path", F.regexp_extract("source_url", r"^[a-z]+://[^/]+(/[^?#]*)", 1))
    old = sources.select("source_url").join(old_pages, F.col("source_url") == F.col("url"))
    substituted = F.concat(F.lit(destination_origin), F.expr(f"substring(source_url, {len(source_origin) + 1})"))
    parts = [
        candidate(planned.join(sources.select("source_url"), "source_url", "left_semi").withColumnRenamed("destination_url", "destination").distinct(), "explicit_redirect_map"),
        candidate(sources.withColumn("destination", F.col("proposed")), "explicit_proposed_destination"),
        candidate(old.where("final_url <> source_url").withColumn("destination", F.col("final_url")), "observed_redirect"),
        candidate(sources.join(new_urls, F.col("source_url") == F.col("destination")), "exact_normalized_url"),
        candidate(sources.where(F.startswith("source_url", F.lit(source_origin))).withColumn("destination", substituted), "configured_origin_substitution"),
        candidate(own_path.join(paths, "path"), "path_match"),
        candidate(old.join(new_urls.select(F.col("destination").alias("canonical_url")), "canonical_url", "left_semi").withColumn("destination", F.col("canonical_url")), "canonical_hint"),
        candidate(content_matches(old, new_pages), "content_similarity_hint"),
    ]
    every = reduce(DataFrame.unionByName, parts).distinct()
    best = every.groupBy("source_url").agg(
        F.min_by(F.struct("place", "destination_url"), F.struct("place", "destination_url")).alias("b"), F.countDistinct("destination_url").alias("competing"), F.count_if(F.col("place") == 0).alias("explicit")
    )
    out = sources.select("source_url").join(best, "source_url", "left")
    torn = (F.col("explicit") > 1) | ((F.col("competing") > 1) & (F.col("b.place") >= len(DECISIVE)))
    name = F.element_at(F.array(*(F.lit(m) for m, _ in METHODS)), F.col("b.place") + 1)
    trust = F.element_at(F.array(*(F.lit(c) for _, c in METHODS)), F.col("b.place") + 1)
    out = out.select(
        "source_url", F.when(~torn, F.col("b.destination_url")).alias("destination_url"), F.when(F.col("b").isNull(), "unmapped").when(torn, "manual_review_candidate").otherwise(name).alias("method"),
        F.when(F.col("b").isNull(), "indeterminate").when(torn, "low").otherwise(trust).alias("confidence"), F.when(F.col("b").isNull(), "unmapped").when(torn, "ambiguous").otherwise("mapped").alias("state"),
        F.coalesce(F.col("explicit") > 1, F.lit(False)).alias("split"),
    )
    shared = out.where("destination_url is not null").groupBy("destination_url").agg(F.count(F.lit(1)).alias("n"))
    joined = out.join(shared, "destination_url", "left")
    kind = F.when(F.col("split"), "one_to_many").when(F.col("state") == "ambiguous", "ambiguous").when(F.col("state") == "unmapped", "unmapped").when(F.col("n") > 1, "many_to_one").otherwise("one_to_one")
    return joined.select("source_url", "destination_url", "method", "confidence", "state", kind.alias("cardinality"))


def mapping_findings(mapped: DataFrame) -> DataFrame:
    """source_url, destination_url, code, category, severity, action, confidence of mappings that aren't one to one."""
    rows = [(code, cardinality, "mapping", severity_of(code), action, trust) for code, cardinality, action, trust in MAPPING_CODES]
    kinds = mapped.sparkSession.createDataFrame(rows, "code string, cardinality string, category string, severity string, action string, confidence string")
    return mapped.select("source_url", "destination_url", "cardinality").join(F.broadcast(kinds), "cardinality").drop("cardinality")


def findings(mapped: DataFrame, planned: DataFrame, old_pages: DataFrame, new_pages: DataFrame, source_origin: str, destination_origin: str) -> DataFrame:
    """source_url, destination_url, code, category, severity, action, confidence of every mapping with a destination.

    planned: also expected_status. pages: page_id, url, final_url, canonical_url, title, description, http_status,
    redirect_count, redirect_loop, category, language, robots_allowed, indexable.
    """
    once = planned.groupBy("source_url").agg(F.count(F.lit(1)).alias("n"), F.min("expected_status").alias("expected_status")).where("n = 1").select("source_url", "expected_status", F.lit(True).alias("planned_"))
    # A page answers under the URL asked for and under the one it ended at; the later row stands.
    pages = new_pages.select("*", F.explode(F.array_distinct(F.array_compact(F.array("url", "final_url")))).alias("key"))
    pages = pages.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("page_id")))).where("place = 1")
    seen = pages.select(
        F.col("key").alias("source_url"), F.lit(True).alias("observed_"), F.col("final_url").alias("observed_final"), F.col("http_status").alias("observed_status"), F.col("redirect_count").alias("observed_hops"), F.col("redirect_loop").alias("observed_loop"),
        F.col("indexable").alias("observed_indexable"),
    )
    at = pages.select(
        F.col("key").alias("destination_url"), F.lit(True).alias("page_known_"), F.col("http_status").alias("page_status"), F.col("title").alias("page_title"), F.col("description").alias("page_description"), F.col("canonical_url").alias("page_canonical"), F.col("category").alias("page_category"),
        F.col("language").alias("page_language"), F.col("robots_allowed").alias("page_robots"), F.col("indexable").alias("page_indexable"), F.col("redirect_count").alias("page_hops"),
    )
    named = pages.select(F.col("key").alias("page_canonical"), F.col("http_status").alias("c_status"), F.col("redirect_count").alias("c_hops"))
    before = old_pages.select(
        F.col("url").alias("source_url"), F.lit(True).alias("old_known_"), F.col("title").alias("old_title"), F.col("description").alias("old_description"), F.col("canonical_url").alias("old_canonical"), F.col("category").alias("old_category"), F.col("language").alias("old_language"),
        F.col("robots_allowed").alias("old_robots"), F.col("indexable").alias("old_indexable"),
    )
    own = mapped.where("destination_url is not null").drop("confidence").join(once, "source_url", "left").join(seen, "source_url", "left").join(at, "destination_url", "left").join(before, "source_url", "left").join(named, "page_canonical", "left")
    own = own.withColumns({n: F.coalesce(f"{n}_", F.lit(False)) for n in ("planned", "observed", "page_known", "old_known")})

    def changed(kind: str) -> Column:
        old, new = F.col(f"old_{kind}"), F.col(f"page_{kind}")
        both = old.isNotNull() & new.isNotNull() & (old != new)
        return both & (sequence_ratio(F.when(both, old), F.when(both, new)) < 1 - MATERIAL_CHANGE)

    own = own.withColumns({
        "source_origin": F.lit(source_origin), "destination_origin": F.lit(destination_origin), "target_origin": origin_of("destination_url"), "canonical_origin": origin_of("page_canonical"),
        "canonical_same": F.col("old_canonical").eqNullSafe(F.col("page_canonical")), "title_changed": changed("title"),
        "description_changed": changed("description") & (F.col("old_description") != "") & (F.col("page_description") != ""),
    })
    fields = lambda code, category, action, trust: F.struct(*(F.lit(v).alias(n) for n, v in (("code", code), ("category", category), ("severity", severity_of(code)), ("action", action), ("confidence", trust))))
    hit = F.array_compact(F.array(*(F.when(F.expr(c), fields(code, k, a, t)) for code, c, k, a, t in FINDINGS)))
    return own.select("source_url", "destination_url", F.explode(hit).alias("f")).select("source_url", "destination_url", "f.*")


def link_findings(links: DataFrame, pages: DataFrame, source_origin: str, destination_origin: str) -> DataFrame:
    """page_id, target, code: links of the new site that lead to old, moved, broken, staging or foreign addresses. links: page_id, target."""
    status = pages.select(F.col("url").alias("target"), "http_status", "redirect_count")
    own = links.join(status, "target", "left").withColumn("origin", origin_of("target"))
    tests = (
        ("internal_link_to_legacy_url", F.col("origin") == source_origin), ("internal_link_to_redirect", F.col("redirect_count") > 0), ("internal_link_to_broken_destination", F.col("http_status") >= 400),
        ("internal_link_to_staging_host", staging("target")), ("internal_link_host_mismatch", ~F.col("origin").isin(source_origin, destination_origin)),
    )
    return own.select("page_id", "target", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in tests)))).alias("code"))


def unlinked_targets(old_links: DataFrame, mapped: DataFrame, new_links: DataFrame) -> DataFrame:
    """source_url, destination_url: pages that the old site linked to and the new one doesn't (an anti join)."""
    wanted = old_links.select(F.col("target").alias("source_url")).distinct().join(mapped.select("source_url", "destination_url"), "source_url").where("destination_url is not null")
    return wanted.join(new_links.select(F.col("target").alias("destination_url")).distinct(), "destination_url", "left_anti").select("source_url", "destination_url")


def sitemap_findings(entries: DataFrame, mapped: DataFrame, pages: DataFrame, source_origin: str, destination_origin: str) -> DataFrame:
    """url, code of the new sitemap (entries: url) and of mapped destinations that it lacks."""
    own = entries.join(pages.select("url", "http_status", "redirect_count", "indexable", "canonical_url"), "url", "left").withColumn("origin", origin_of("url"))
    tests = (
        ("legacy_url_in_destination_sitemap", F.col("origin") == source_origin), ("redirecting_url_in_sitemap", F.col("redirect_count") > 0), ("broken_url_in_sitemap", F.col("http_status") >= 400), ("nonindexable_url_in_sitemap", ~F.col("indexable")),
        ("canonical_conflict_in_sitemap", F.col("canonical_url") != F.col("url")), ("sitemap_host_mismatch", ~F.col("origin").isin(source_origin, destination_origin)),
    )
    found = own.select("url", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in tests)))).alias("code"))
    absent = mapped.where("destination_url is not null").select(F.col("destination_url").alias("url")).distinct().join(entries.select("url"), "url", "left_anti")
    return found.unionByName(absent.select("url", F.lit("destination_url_missing_from_sitemap").alias("code")))


def staging(url: str) -> Column:
    """Whether a label of the host of an address names a staging site."""
    return F.arrays_overlap(F.split(F.regexp_extract(url, "://([^:/?#]+)", 1), "[.]"), F.array(*map(F.lit, STAGING_LABELS)))


def image_references(images: DataFrame, source_origin: str) -> DataFrame:
    """page_url, resolved, code: images of the new site (page_url, resolved, http_status, redirected) at old, staging, broken or moved addresses."""
    tests = (
        ("image_legacy_host_reference", F.startswith("resolved", F.lit(source_origin))), ("image_staging_host_reference", staging("resolved")), ("image_broken_after_migration", F.col("http_status") >= 400),
        ("image_redirect_dependency", F.col("redirected")),
    )
    return images.select("page_url", "resolved", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in tests)))).alias("code"))


def image_findings(mapped: DataFrame, old_images: DataFrame, new_images: DataFrame) -> DataFrame:
    """source_url, src, code: images (page_url, src, alt, width, height, loading) of old pages that the new page lacks or shows otherwise.

    src is the image's identity, the same on both sites; of several uses on a new page the least values count.
    """
    traits = ("alt", "width", "height", "loading")
    was = mapped.where("destination_url is not null").select("source_url", "destination_url").join(old_images.select(F.col("page_url").alias("source_url"), "src", *(F.col(c).alias(f"old_{c}") for c in traits)), "source_url")
    now = new_images.groupBy(F.col("page_url").alias("destination_url"), "src").agg(*(F.min(c).alias(c) for c in traits), F.lit(True).alias("here"))
    own = was.join(now, ["destination_url", "src"], "left")
    differs = lambda c: ~F.col(f"old_{c}").eqNullSafe(F.col(c))
    bare = F.col("old_alt").isNotNull() & F.col("alt").isNull()
    codes = F.array(
        F.when(bare, F.lit("image_alt_missing_after_migration")).when(differs("alt"), F.lit("image_alt_materially_changed")),
        F.when(differs("width") | differs("height"), F.lit("image_dimension_regression")),
        F.when(differs("loading"), F.lit("image_loading_regression")),
    )
    found = F.when(F.col("here").isNull(), F.array(F.lit("image_missing_after_migration"))).otherwise(F.array_compact(codes))
    return own.select("source_url", "src", F.explode(found).alias("code"))


def structured_findings(mapped: DataFrame, old_blocks: DataFrame, new_blocks: DataFrame) -> DataFrame:
    """source_url, code: structured data (page_url, type, format, error) that is gone, of other types, formats or invalid."""
    listed = lambda df, c: df.groupBy(F.col("page_url").alias(c)).agg(F.array_sort(F.collect_set("type")).alias("types"), F.array_sort(F.collect_set("format")).alias("formats"), F.count_if(F.col("error").isNotNull()).alias("bad"))
    was = listed(old_blocks, "source_url").select("source_url", F.col("types").alias("old_types"), F.col("formats").alias("old_formats"))
    own = mapped.where("destination_url is not null").select("source_url", "destination_url").join(was, "source_url").join(listed(new_blocks, "destination_url"), "destination_url", "left")
    tests = (
        ("structured_data_removed", F.col("types").isNull()), ("structured_data_type_changed", F.size(F.array_except("old_types", "types")) > 0), ("structured_data_format_changed", (F.size(F.array_except("old_types", "types")) == 0) & (F.col("old_formats") != F.col("formats"))),
        ("structured_data_invalid_after_migration", F.col("bad") > 0),
    )
    return own.select("source_url", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in tests)))).alias("code"))


def recommendations(found: DataFrame) -> DataFrame:
    """action, destination_url, sources, worst, least_confidence, id: findings by action and destination."""
    rank = "CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END"
    trust = "CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
    own = found.withColumns({"rank": F.expr(rank), "trust": F.expr(trust)}).groupBy("action", "destination_url").agg(F.countDistinct("source_url").alias("sources"), F.max_by("severity", "rank").alias("worst"), F.min_by("confidence", "trust").alias("least_confidence"))
    return own.select("action", "destination_url", "sources", "worst", "least_confidence", stable_id("action", "destination_url", separator=31).alias("recommendation_id"))


def sitewide(found: DataFrame, mapped: DataFrame, ratio: float = SITEWIDE_RATIO) -> DataFrame:
    """metric, numerator, denominator, ratio, state of the sitewide patterns over findings (code)."""
    groups = found.sparkSession.createDataFrame([(g, c) for g, codes in SITEWIDE.items() for c in codes], "metric string, code string")
    counts = F.broadcast(groups).join(found.groupBy("code").agg(F.count(F.lit(1)).alias("n")), "code", "left").groupBy("metric").agg(F.sum(F.coalesce("n", F.lit(0))).alias("numerator"))
    own = counts.crossJoin(F.broadcast(mapped.agg(F.count(F.lit(1)).alias("denominator"))))  # one row
    limit = F.greatest(F.lit(2), F.floor(F.col("denominator") * ratio + 0.999999))
    state = F.when(F.col("denominator") < SMALL_INVENTORY, "small_inventory").when(F.col("numerator") >= limit, "threshold_reached").otherwise("below_threshold")
    return own.select("metric", "numerator", "denominator", F.when(F.col("denominator") > 0, F.format_string("%.6f", F.col("numerator") / F.col("denominator"))).otherwise("0.000000").alias("ratio"), state.alias("state"))


def sitewide_findings(metrics: DataFrame) -> DataFrame:
    """code, occurrences, affected: patterns that reach their threshold, from the rows of `sitewide`."""
    return metrics.where("state = 'threshold_reached'").select(F.col("metric").alias("code"), F.col("numerator").alias("occurrences"), F.least("numerator", "denominator").alias("affected"))


def freshness(completed: Column, now: Column, days: int = 30) -> Column:
    """current, stale, or unknown without a time; now is given, never the clock."""
    return F.when(completed.isNull(), "unknown").when(now - completed > F.expr(f"interval {days} days"), "stale").otherwise("current")
