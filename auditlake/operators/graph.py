"""Internal-link graph: page eligibility, edges, breadth-first reach, page metrics, anchors, opportunities."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.shared import written

#: Thresholds. Fixed values.
MAX_PATH, HUB_DESTINATIONS, AUTHORITY_REFERRERS, MAX_DEPTH, MAX_OUTLINKS, LOW_INLINKS, DOMINANT_SHARE, SITEWIDE_PAGES, SITEWIDE_RATIO = 64, 10, 5, 4, 100, 2, 0.8, 5, 0.5
#: Anchors that say nothing of their target. Fixed values.
GENERIC_ANCHORS = ("click here", "read more", "learn more", "more", "here", "this page")

#: SQL of a page's eligibility; known_canonical: the canonical names another page of the crawl. Fixed values.
ELIGIBILITY_SQL = """CASE WHEN redirect_count > 0 THEN 'redirect_source' WHEN known_canonical AND NOT canonical_conflicting THEN 'canonical_duplicate'
 WHEN fetch_failed OR http_status IS NULL THEN 'unverified' WHEN http_status NOT BETWEEN 200 AND 299 THEN 'excluded_broken' WHEN category <> 'html' OR NOT parsed_as_html THEN 'excluded_non_html'
 WHEN NOT robots_allowed OR meta_noindex OR header_noindex THEN 'excluded_noindex' ELSE 'eligible' END"""
ORPHAN_SQL = """CASE WHEN eligibility = 'unverified' THEN 'unverified' WHEN eligibility <> 'eligible' THEN 'excluded' WHEN distance = 0 THEN 'seed_page'
 WHEN referrers = 0 AND in_sitemap THEN 'sitemap_only' WHEN referrers = 0 THEN 'true_orphan' WHEN direct_in = 0 AND redirect_in > 0 THEN 'redirect_only'
 WHEN nofollow_in = inbound THEN 'nofollow_only' ELSE 'not_orphan' END"""
STATE_SQL = f"""CASE WHEN eligibility = 'redirect_source' THEN 'redirect_source' WHEN eligibility = 'canonical_duplicate' THEN 'canonical_duplicate' WHEN eligibility = 'unverified' THEN 'unverified_page'
 WHEN eligibility <> 'eligible' THEN 'excluded_page' WHEN orphan_state IN ('true_orphan', 'sitemap_only') THEN 'orphan_candidate' WHEN distance > {MAX_DEPTH} THEN 'deep_page'
 WHEN referrers < {LOW_INLINKS} THEN 'low_inlink_count' WHEN outbound > {MAX_OUTLINKS} THEN 'high_outlink_count' WHEN hub THEN 'hub_candidate' WHEN authority THEN 'authority_candidate' ELSE 'reachable' END"""
ANCHOR_STATE_SQL = f"""CASE WHEN target_redirected THEN 'redirecting_target' WHEN target_status >= 400 THEN 'broken_target' WHEN anchor = '' THEN 'empty'
 WHEN anchor IN ({", ".join(f"'{a}'" for a in GENERIC_ANCHORS)}) THEN 'generic' WHEN anchor LIKE 'http://%' OR anchor LIKE 'https://%' OR anchor LIKE 'www.%' THEN 'url'
 WHEN share > {DOMINANT_SHARE} AND total >= 3 THEN 'concentrated' WHEN target_anchors > 1 THEN 'multiple_to_target' WHEN anchor_targets > 1 THEN 'duplicate_to_targets' ELSE 'healthy' END"""


def nodes(pages: DataFrame) -> DataFrame:
    """pages with eligibility."""
    known = pages.select(F.col("identity").alias("k")).distinct()
    own = pages.join(known, (F.col("canonical_identity") == F.col("k")) & (F.col("canonical_identity") != F.col("identity")), "left")
    return own.withColumn("known_canonical", F.col("k").isNotNull()).drop("k").withColumn("eligibility", F.expr(ELIGIBILITY_SQL))


def edges(links: DataFrame, pages: DataFrame) -> DataFrame:
    """source, target, adjusted, edge_state, occurrences, nofollows, anchors, sitewide. links: source, target, anchor, nofollow.

    adjusted is where the link leads after the target's redirect or canonical. pages are nodes.
    """
    pairs = links.groupBy("source", "target").agg(F.count(F.lit(1)).alias("occurrences"), F.count_if("nofollow").alias("nofollows"), F.array_join(F.slice(F.array_sort(F.collect_set("anchor")), 1, 50), "|").alias("anchors"))
    eligible = pages.agg(F.count_if(F.col("eligibility") == "eligible").alias("eligible"))
    wide = pairs.groupBy("target").agg(F.count(F.lit(1)).alias("sources")).crossJoin(F.broadcast(eligible))  # one row
    wide = wide.select("target", ((F.col("eligible") >= SITEWIDE_PAGES) & (F.col("sources") / F.col("eligible") >= SITEWIDE_RATIO)).alias("sitewide"))
    at = pages.select(F.col("identity").alias("target"), "redirect_count", "final_identity", "canonical_identity", "eligibility")
    joined = pairs.join(wide, "target").join(at, "target", "left")
    state = F.when(F.col("eligibility") == "canonical_duplicate", "canonical_adjusted").when(F.col("redirect_count") > 0, "redirect_adjusted").otherwise("direct")
    adjusted = F.when(F.col("redirect_count") > 0, F.coalesce("final_identity", "target")).when(F.col("eligibility") == "canonical_duplicate", F.coalesce("canonical_identity", "target")).otherwise(F.col("target"))
    return joined.select("source", "target", adjusted.alias("adjusted"), state.alias("edge_state"), "occurrences", "nofollows", "anchors", "sitewide")


def _write(df: DataFrame) -> DataFrame:
    """A level of the search."""
    return written(df, "level")


def reachability(all_edges: DataFrame, pages: DataFrame, seeds: DataFrame, follow_all: bool = False) -> DataFrame:
    """identity, distance, predecessor, path, redirect_dependent of every page reached from seeds (column identity).

    One join for each level. Pages are taken in the order in which a queue would: a page's place follows its
    predecessor's place and then its own identity, and the first to reach a page is its predecessor. follow_all also
    takes nofollow links and pages that aren't eligible.
    """
    own = all_edges if follow_all else all_edges.where("nofollows < occurrences")
    own = own.groupBy("source", "adjusted").agg(F.min(F.col("edge_state") != "direct").alias("moved"))
    allowed = pages if follow_all else pages.where("eligibility = 'eligible'")
    own = _write(own.join(allowed.select(F.col("identity").alias("adjusted")), "adjusted", "left_semi"))
    level = seeds.select("identity", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("predecessor"), F.array("identity").alias("path"), F.lit(False).alias("redirect_dependent"), F.array("identity").alias("place"))
    seen = level = _write(level)
    # The search that follows all links ends where nothing is new.
    for depth in count(1) if follow_all else range(1, MAX_PATH + 1):
        near = level.join(own, level["identity"] == own["source"]).select(F.col("adjusted").alias("identity"), F.col("identity").alias("p"), "path", "redirect_dependent", "moved", "place")
        near = near.join(seen.select("identity"), "identity", "left_anti")
        first = near.groupBy("identity").agg(F.min_by(F.struct("p", "path", "redirect_dependent", "moved", "place"), "place").alias("f"))
        # A place is the path itself: paths of one length compare by their pages in the order of the queue.
        level = _write(first.select(
            "identity", F.lit(depth).alias("distance"), F.col("f.p").alias("predecessor"), F.concat("f.path", F.array("identity")).alias("path"), (F.col("f.redirect_dependent") | F.col("f.moved")).alias("redirect_dependent"),
            F.concat("f.place", F.array("identity")).alias("place"),
        ))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen.drop("place")


def anchors(links: DataFrame, pages: DataFrame) -> DataFrame:
    """target, anchor, occurrences, source_pages, share, anchor_state. links: source, target, anchor (normalised)."""
    per = links.groupBy("target", "anchor").agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct("source").alias("source_pages"))
    totals = per.groupBy("target").agg(F.sum("occurrences").alias("total"), F.count(F.lit(1)).alias("target_anchors"))
    spread = per.groupBy("anchor").agg(F.count(F.lit(1)).alias("anchor_targets"))
    at = pages.select(F.col("identity").alias("target"), (F.col("redirect_count") > 0).alias("target_redirected"), F.col("http_status").alias("target_status"))
    joined = per.join(totals, "target").join(spread, "anchor").join(at, "target", "left").withColumn("share", F.col("occurrences") / F.col("total"))
    return joined.select("target", "anchor", "occurrences", "source_pages", "share", F.expr(ANCHOR_STATE_SQL).alias("anchor_state"))


def dominant_anchors(links: DataFrame) -> DataFrame:
    """target, unique_anchors, dominant, dominant_count: ties go to the anchor that was seen first. links: also seq."""
    per = links.groupBy("target", "anchor").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    return per.groupBy("target").agg(F.count(F.lit(1)).alias("unique_anchors"), F.max_by("anchor", F.struct("n", -F.col("first"))).alias("dominant"), F.max("n").alias("dominant_count"))


def page_metrics(all_edges: DataFrame, pages: DataFrame, reach: DataFrame) -> DataFrame:
    """A row for each page: in and out counters, orphan state, hub and authority flags, primary state."""
    count = F.count_if(F.col("eligibility") == "eligible").alias("eligible_pages")
    status = pages.select(F.col("identity").alias("target"), F.col("http_status").alias("target_status"))
    inbound = all_edges.groupBy(F.col("adjusted").alias("identity")).agg(
        F.sum("occurrences").alias("inbound"), F.countDistinct("source").alias("referrers"), F.sum(F.when(F.col("edge_state") == "direct", F.col("occurrences")).otherwise(0)).alias("direct_in"),
        F.sum(F.when(F.col("edge_state") == "redirect_adjusted", F.col("occurrences")).otherwise(0)).alias("redirect_in"), F.sum("nofollows").alias("nofollow_in"),
        F.sum(F.when(F.col("sitewide"), F.col("occurrences")).otherwise(0)).alias("sitewide_in"), F.countDistinct(F.when(~F.col("sitewide") & (F.col("nofollows") < F.col("occurrences")), F.col("source"))).alias("own_referrers"),
    )
    outbound = all_edges.join(status, "target", "left").groupBy(F.col("source").alias("identity")).agg(
        F.sum("occurrences").alias("outbound"), F.count(F.lit(1)).alias("destinations"), F.sum(F.when(F.col("edge_state") != "direct", F.col("occurrences")).otherwise(0)).alias("moved_out"),
        F.sum(F.when(F.col("target_status") >= 400, F.col("occurrences")).otherwise(0)).alias("broken_out"),
    )
    own = pages.select("identity", "page_id", "eligibility", "in_sitemap").join(inbound, "identity", "left").join(outbound, "identity", "left").join(reach.select("identity", "distance"), "identity", "left")
    zero = [c for c in (*inbound.columns, *outbound.columns) if c != "identity"]
    own = own.fillna(0, zero).crossJoin(F.broadcast(pages.agg(count)))  # one row
    enough = F.col("eligible_pages") >= SITEWIDE_PAGES
    hub = enough & (F.col("destinations") >= HUB_DESTINATIONS) & (F.col("outbound") <= MAX_OUTLINKS) & (F.col("broken_out") == 0) & (F.col("moved_out") == 0)
    own = own.withColumns({"hub": hub, "authority": enough & (F.col("own_referrers") >= AUTHORITY_REFERRERS), "orphan_state": F.expr(ORPHAN_SQL)}).withColumn("primary_state", F.expr(STATE_SQL))
    return own.select("page_id", "eligibility", "inbound", "referrers", "direct_in", "redirect_in", "nofollow_in", "sitewide_in", "outbound", "destinations", "broken_out", "distance", "hub", "authority", "orphan_state", "primary_state")


def opportunities(metrics: DataFrame, found_anchors: DataFrame, all_edges: DataFrame, pages: DataFrame) -> DataFrame:
    """kind, page_id or target, source: what to link, strengthen, reduce, promote, rename, replace or remove."""
    best = metrics.where("hub").agg(F.min_by("page_id", F.struct(F.coalesce("distance", F.lit(999)), "page_id")).alias("best_hub"))
    orphans = metrics.where("primary_state = 'orphan_candidate'").crossJoin(F.broadcast(best))  # one row
    take = lambda df, kind, subject, source: df.select(F.lit(kind).alias("kind"), F.col(subject).cast("long").alias("page_id"), source.cast("long").alias("source_page"))
    none = F.lit(None)
    at = pages.select(F.col("identity"), "page_id", "http_status", "redirect_count")
    targets = all_edges.join(at.withColumnRenamed("identity", "target"), "target").join(at.select(F.col("identity").alias("source"), F.col("page_id").alias("from_page")), "source")
    named = found_anchors.where("anchor_state in ('empty', 'generic', 'url')").join(at.withColumnRenamed("identity", "target"), "target").select("page_id").distinct()
    return (
        take(orphans, "link_orphan", "page_id", F.col("best_hub")).unionByName(take(metrics.where("primary_state in ('low_inlink_count', 'deep_page')"), "strengthen_page", "page_id", none))
        .unionByName(take(metrics.where("primary_state = 'high_outlink_count'"), "reduce_outlinks", "page_id", none)).unionByName(take(metrics.where("authority"), "promote_authority", "page_id", none))
        .unionByName(take(named, "improve_anchor", "page_id", none)).unionByName(take(targets.where("redirect_count > 0"), "replace_redirecting_link", "page_id", F.col("from_page")))
        .unionByName(take(targets.where("http_status >= 400"), "replace_broken_link", "page_id", F.col("from_page")))
    )


def findings(metrics: DataFrame, all_edges: DataFrame, pages: DataFrame) -> DataFrame:
    """kind, page_id, code, severity: pages whose state isn't healthy, then links that don't lead straight to their page."""
    severity = F.expr("CASE WHEN primary_state = 'orphan_candidate' THEN 'high' WHEN primary_state = 'canonical_duplicate' THEN 'low' WHEN primary_state IN ('excluded_page', 'hub_candidate', 'authority_candidate', 'reachable') THEN 'info' ELSE 'medium' END")
    own = metrics.select(F.lit("page").alias("kind"), "page_id", F.col("primary_state").alias("code"), severity.alias("severity")).where("severity <> 'info'")
    at = pages.select(F.col("identity").alias("source"), "page_id")
    moved = all_edges.where("edge_state <> 'direct'").join(at, "source").select(F.lit("edge").alias("kind"), "page_id", F.col("edge_state").alias("code"), F.lit("medium").alias("severity"))
    return own.unionByName(moved)
