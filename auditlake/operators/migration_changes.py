"""What changed between the crawls before and after a migration: pages, links, structured data."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.functions.text import sequence_ratio
from auditlake.operators.migration import MATERIAL_CHANGE, SIGNALS, with_signals

def score(left: str, right: str) -> Column:
    """Share of equal values among the signals that both pages have; 0 without any."""
    both = [F.col(f"{left}{s}").isNotNull() & F.col(f"{right}{s}").isNotNull() for s in SIGNALS]
    known = sum((b.cast("int") for b in both), F.lit(0))
    same = sum((F.coalesce(F.col(f"{left}{s}") == F.col(f"{right}{s}"), F.lit(False)).cast("int") for s in SIGNALS), F.lit(0))
    return F.when(known > 0, same / known).otherwise(F.lit(0.0))


def _text_state(kind: str, ratio: float) -> Column:
    """preserved, changed, changed_materially, missing or added."""
    old, new = F.col(f"old_{kind}"), F.col(f"new_{kind}")
    had, has = F.coalesce(old, F.lit("")) != "", F.coalesce(new, F.lit("")) != ""
    differs = ~F.col(f"old_{kind}_key").eqNullSafe(F.col(f"new_{kind}_key"))
    far = sequence_ratio(F.when(differs, old), F.when(differs, new)) < 1 - ratio
    return F.when(had & ~has, "missing").when(~had & has, "added").when(~differs, "preserved").when(far, "changed_materially").otherwise("changed")


def page_comparisons(mapped: DataFrame, old_pages: DataFrame, new_pages: DataFrame, ratio: float = MATERIAL_CHANGE) -> DataFrame:
    """source_url, destination_url, status_state, metadata_state, content_state, canonical_state, indexability_state, similarity (six digits), codes of each mapped page.

    Old pages are found under url, new ones under url or final_url, once for each address. pages: url, final_url, http_status,
    title, description, category, canonical_url, indexable, meta_robots, x_robots, language. Without a new page everything is
    missing or not_available; without an old one nothing can be compared.
    """
    names = ("http_status", "title", "title_key", "description", "description_key", "category", "canonical_url", "indexable", "meta_robots", "x_robots", "language")
    before = with_signals(old_pages).select(F.col("url").alias("source_url"), F.lit(True).alias("old_here"), *(F.col(n).alias(f"old_{n}") for n in names))
    after = with_signals(new_pages).withColumn("key", F.explode(F.array_distinct(F.array_compact(F.array("url", "final_url")))))
    # A page answers under two addresses; the later page of an address stands.
    after = after.groupBy(F.col("key").alias("destination_url")).agg(F.max_by(F.struct(*names), "page_id").alias("p")).select("destination_url", F.lit(True).alias("new_here"), *(F.col(f"p.{n}").alias(f"new_{n}") for n in names))
    own = mapped.where("destination_url IS NOT NULL").select("source_url", "destination_url").join(before, "source_url", "left").join(after, "destination_url", "left")
    old_here, new_here = F.coalesce("old_here", F.lit(False)), F.coalesce("new_here", F.lit(False))
    own = own.withColumns({"old_here": old_here, "new_here": new_here, "score": score("old_", "new_"), "title_state": _text_state("title", ratio), "description_state": _text_state("description", ratio)})
    both = F.col("old_here") & F.col("new_here")
    same = lambda c: F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    kept = F.col("score") >= 1 - ratio

    def state(test: Column, without_new: str = "not_available", without_old: str = "not_available") -> Column:
        return F.when(~F.col("new_here"), without_new).when(~F.col("old_here"), without_old).when(test, "preserved").otherwise("changed")

    codes = F.array_compact(F.array(
        F.when(~F.col("new_here"), "content_missing"),
        F.when(F.col("new_here") & ~F.col("old_here"), "source_metadata_unavailable"), F.when(F.col("new_here") & ~F.col("old_here"), "content_similarity_indeterminate"),
        F.when(both & (F.col("title_state") == "missing"), "title_missing_after_migration"), F.when(both & (F.col("title_state") == "changed_materially"), "title_materially_changed"),
        F.when(both & (F.col("description_state") == "missing"), "meta_description_missing_after_migration"), F.when(both & (F.col("description_state") == "changed_materially"), "meta_description_materially_changed"),
        F.when(both & ~same("canonical_url"), "canonical_target_changed"), F.when(both & (~same("meta_robots") | ~same("x_robots")), "robots_regression"), F.when(both & ~same("indexable"), "indexability_regression"),
        F.when(both & ~same("category"), "content_type_changed"), F.when(both & (F.col("old_language") != F.col("new_language")), "language_changed"),
        F.when(both & kept, "content_likely_preserved"), F.when(both & ~kept, "content_materially_changed"), F.when(both & ~kept, "content_similarity_low"),
    ))
    return own.select(
        "source_url", "destination_url", state(same("http_status"), "missing", "confirmed").alias("status_state"), state((F.col("title_state") == "preserved") & (F.col("description_state") == "preserved")).alias("metadata_state"),
        state(kept, "missing", "indeterminate").alias("content_state"), state(same("canonical_url")).alias("canonical_state"), state(same("indexable")).alias("indexability_state"),
        F.when(both, F.format_string("%.6f", F.col("score"))).alias("similarity"), F.array_join(codes, ",").alias("codes"),
    )


# -- links


def link_changes(mapped: DataFrame, old_links: DataFrame, new_links: DataFrame) -> DataFrame:
    """code, source_url, destination_url, occurrences, pages: what the link graphs before and after tell of each other.

    links: page_url, target. Reported are links of the new site to an address that maps nowhere, targets of the old site that
    the new one links to no more, mapped destinations without a link, and how much the new site depends on redirects (one row).
    """
    new_targets = new_links.where("target IS NOT NULL").groupBy("target").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("page_url").alias("pages"))
    at = mapped.select(F.col("source_url").alias("target"), "destination_url", "state")
    old_addresses = new_targets.join(at, "target")
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    unmapped = old_addresses.where("state = 'unmapped'").select(F.lit("source_link_target_unmapped").alias("code"), F.col("target").alias("source_url"), none.alias("destination_url"), "occurrences", "pages")
    gone = old_links.where("target IS NOT NULL").groupBy("target").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("page_url").alias("pages")).join(new_targets.select("target"), "target", "left_anti")
    gone = gone.join(at, "target", "left").select(F.lit("navigation_target_regression").alias("code"), F.col("target").alias("source_url"), "destination_url", "occurrences", "pages")
    alone = mapped.where("destination_url IS NOT NULL").join(new_targets.select(F.col("target").alias("destination_url")), "destination_url", "left_anti")
    alone = alone.select(F.lit("destination_orphan_candidate").alias("code"), "source_url", "destination_url", zero.alias("occurrences"), zero.alias("pages"))
    # Pages are counted over all such links at once, from the pairs.
    hit = new_links.join(mapped.select(F.col("source_url").alias("target")), "target", "left_semi").groupBy("page_url").agg(F.count(F.lit(1)).alias("n"))
    sitewide = hit.agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("pages")).where("pages > 0").select(F.lit("redirect_dependency_sitewide").alias("code"), none.alias("source_url"), none.alias("destination_url"), "occurrences", "pages")
    return unmapped.unionByName(gone).unionByName(alone).unionByName(sitewide)


def edge_differences(mapped: DataFrame, old_links: DataFrame, new_links: DataFrame) -> DataFrame:
    """page_url, target, change (kept, lost, gained), old_links, new_links of every edge, the old ones after their ends were mapped.

    An end that maps nowhere stays as it is. Edges are summed before they meet, so a target of every page is no hot row.
    """
    at = mapped.where("destination_url IS NOT NULL").select(F.col("source_url").alias("was"), F.col("destination_url").alias("now"))
    counted = lambda df: df.where("target IS NOT NULL").groupBy("page_url", "target").agg(F.count(F.lit(1)).alias("n"))
    old = counted(old_links)
    for end in ("page_url", "target"):
        old = old.join(at.select(F.col("was").alias(end), F.col("now").alias(f"new_{end}")), end, "left").withColumn(end, F.coalesce(f"new_{end}", end)).drop(f"new_{end}")
    old = old.groupBy("page_url", "target").agg(F.sum("n").alias("old_links"))
    both = old.join(counted(new_links).withColumnRenamed("n", "new_links"), ["page_url", "target"], "full_outer").fillna(0, ["old_links", "new_links"])
    change = F.when(F.col("new_links") == 0, "lost").when(F.col("old_links") == 0, "gained").otherwise("kept")
    return both.select("page_url", "target", change.alias("change"), "old_links", "new_links")


# -- structured data


def _values(blocks: DataFrame, page: str) -> DataFrame:
    """page, kind (type, id, format), value: once each."""
    each = lambda kind, values: blocks.select(F.col("page_url").alias(page), F.lit(kind).alias("kind"), F.explode(values).alias("value"))
    return each("type", F.col("types")).unionByName(each("id", F.col("identifiers"))).unionByName(each("format", F.array("format"))).where("value IS NOT NULL").distinct()


def structured_changes(mapped: DataFrame, old_blocks: DataFrame, new_blocks: DataFrame, new_pages: DataFrame) -> DataFrame:
    """code, source_url, destination_url, block_id, detail: how the structured data of mapped pages differ.

    blocks: page_url, block_id, format, error (null: parsed), types, identifiers (arrays). Values of the pages before and after
    meet in a full outer join by page, kind and value; what is on one side only is counted. A page whose destination has no
    blocks lost them. detail: values that are gone, shared or new, sorted.
    """
    at = mapped.select("source_url", "destination_url")
    old_pages = old_blocks.select(F.col("page_url").alias("source_url")).distinct().join(at, "source_url", "left")
    has = new_blocks.select(F.col("page_url").alias("destination_url")).distinct().withColumn("here", F.lit(True))
    pairs = old_pages.join(has, "destination_url", "left")
    removed = pairs.where("here IS NULL").select(F.lit("structured_data_removed").alias("code"), "source_url", "destination_url", F.lit(None).cast("string").alias("block_id"), F.lit(None).cast("string").alias("detail"))
    pairs = pairs.where("here").select("source_url", "destination_url")
    old = pairs.join(_values(old_blocks, "source_url"), "source_url").withColumn("old", F.lit(True))
    new = pairs.join(_values(new_blocks, "destination_url"), "destination_url").withColumn("new", F.lit(True))
    met = old.join(new, ["source_url", "destination_url", "kind", "value"], "full_outer")
    side = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("value")))), ",")
    sets = met.groupBy("source_url", "destination_url", "kind").agg(side(F.col("new").isNull()).alias("gone"), side(F.col("old").isNull()).alias("added"), side(F.col("old") & F.col("new")).alias("shared"), F.count_if(F.col("new").isNull() | F.col("old").isNull()).alias("differ"), F.count_if(F.col("old") & F.col("new")).alias("common"))
    wide = sets.groupBy("source_url", "destination_url").agg(*(F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}") for k in ("type", "id", "format") for c in ("gone", "added", "shared", "differ", "common")))
    moved = F.coalesce(F.col("type_differ"), F.lit(0)) > 0
    said = lambda when, code, detail: F.when(when, F.struct(F.lit(code).alias("code"), detail.alias("detail")))
    both = lambda k: F.concat(F.lit("gone="), F.coalesce(f"{k}_gone", F.lit("")), F.lit(" new="), F.coalesce(f"{k}_added", F.lit("")))
    hits = F.array_compact(F.array(
        said(moved, "structured_data_type_changed", both("type")), said(moved, "structured_data_profile_regression", F.concat(F.lit("gone="), F.coalesce("type_gone", F.lit("")))), said(F.coalesce("id_differ", F.lit(0)) > 0, "structured_data_entity_id_changed", both("id")),
        said(moved & (F.coalesce("id_common", F.lit(0)) > 0), "structured_data_identity_conflict", F.concat(F.lit("shared="), F.coalesce("id_shared", F.lit("")))), said(F.coalesce("format_differ", F.lit(0)) > 0, "structured_data_format_changed", both("format")),
    ))
    changed = wide.select("source_url", "destination_url", F.explode(hits).alias("h")).select(F.col("h.code").alias("code"), "source_url", "destination_url", F.lit(None).cast("string").alias("block_id"), F.col("h.detail").alias("detail"))
    bad = new_blocks.where("error IS NOT NULL").select(F.lit("structured_data_invalid_after_migration").alias("code"), F.lit(None).cast("string").alias("source_url"), F.col("page_url").alias("destination_url"), "block_id", F.col("error").alias("detail"))
    hidden = new_pages.where("NOT indexable").select(F.explode(F.array_distinct(F.array_compact(F.array("url", "final_url")))).alias("page_url")).distinct()
    unseen = new_blocks.join(hidden, "page_url", "left_semi").select(F.lit("structured_data_nonindexable_destination").alias("code"), F.lit(None).cast("string").alias("source_url"), F.col("page_url").alias("destination_url"), "block_id", F.lit(None).cast("string").alias("detail"))
    return removed.unionByName(changed).unionByName(bad).unionByName(unseen)


def flat(value: object, path: str = "") -> dict[str, str]:
    """Paths and scalar values of nested JSON; list items by their place."""
    if isinstance(value, dict):
        return {k: v for name, x in value.items() for k, v in flat(x, f"{path}.{name}" if path else str(name)).items()}
    if isinstance(value, list):
        return {k: v for i, x in enumerate(value) for k, v in flat(x, f"{path}[{i}]").items()}
    return {path: value if isinstance(value, str) else json.dumps(value)}


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def flattened(text: pd.Series) -> pd.Series:
    """The property paths of a JSON object; empty where it isn't one."""

    def one(t: str | None) -> dict[str, str]:
        try:
            value = json.loads(t) if t else None
        except (ValueError, RecursionError):
            value = None
        return flat(value) if isinstance(value, dict) else {}

    return text.map(one)


def entity_differences(mapped: DataFrame, old_entities: DataFrame, new_entities: DataFrame) -> DataFrame:
    """source_url, destination_url, entity, path, change (added, removed, changed), old_value, new_value of mapped pages' entities.

    entities: page_url, entity (its key in the page: an identifier, or type and place), json (its properties, nested). Properties
    become rows by path and meet in a full outer join; equal ones drop out. An entity that one page lacks has all its paths
    added or removed. Of a repeated entity and path the least value counts.
    """
    pairs = mapped.where("destination_url IS NOT NULL").select("source_url", "destination_url")

    def rows(entities: DataFrame, page: str, value: str) -> DataFrame:
        own = entities.select(F.col("page_url").alias(page), "entity", F.explode(flattened("json")).alias("path", "v"))
        return pairs.join(own, page).groupBy("source_url", "destination_url", "entity", "path").agg(F.min("v").alias(value))

    met = rows(old_entities, "source_url", "old_value").join(rows(new_entities, "destination_url", "new_value"), ["source_url", "destination_url", "entity", "path"], "full_outer")
    change = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").otherwise("changed")
    return met.where(~F.col("old_value").eqNullSafe(F.col("new_value"))).select("source_url", "destination_url", "entity", "path", change.alias("change"), "old_value", "new_value")
