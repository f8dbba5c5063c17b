"""What is wrong with the inputs of a migration check, and whether its evidence suffices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.urls import resolve_url
from auditlake.operators.migration import planned_graph

MAX_FIELD = 4096
STATUSES = (301, 302, 307, 308)
#: Diagnostics of a redirect map that are findings. Fixed values.
REDIRECT_FINDINGS = ("redirect_map_duplicate_source", "redirect_map_conflicting_destination", "redirect_map_loop", "redirect_map_chain", "redirect_map_invalid_url", "redirect_destination_collision")
#: Reason, the state that it leads to, and its condition on a row of facts, in the order of the report. Fixed values.
READINESS = (
    ("configuration_snapshot_invalid", "invalid_configuration", "NOT configuration_valid"),
    ("destination_run_missing", "missing_evidence", "NOT destination_known"),
    ("destination_run_nonterminal", "missing_evidence", "destination_known AND NOT destination_terminal"),
    ("destination_page_evidence_missing", "missing_evidence", "destination_known AND destination_terminal AND destination_pages = 0"),
    ("destination_page_evidence_expired", "expired", "destination_known AND destination_terminal AND destination_pages > 0 AND evidence_expired"),
    ("destination_page_evidence_version_unsupported", "incompatible", "destination_known AND destination_terminal AND destination_pages > 0 AND NOT evidence_expired AND foreign_versions > 0"),
    ("source_inventory_missing", "missing_evidence", "sources = 0"),
    ("source_inventory_contains_invalid_rows", "ready_with_warnings", "sources > 0 AND bad_sources > 0"),
    ("redirect_map_contains_invalid_or_conflicting_rows", "ready_with_warnings", "bad_redirects > 0"),
    ("source_comparison_evidence_missing", "ready_with_warnings", "source_run_named AND NOT source_run_usable"),
    ("internal_link_evidence_missing", "ready_with_warnings", "compare_internal_links AND links = 0"),
    ("sitemap_evidence_missing", "ready_with_warnings", "compare_sitemaps AND sitemaps = 0"),
    ("image_evidence_missing", "ready_with_warnings", "compare_images AND images = 0"),
    ("structured_data_evidence_missing", "ready_with_warnings", "compare_structured_data AND structured_data = 0"),
)
#: States from the strongest to the weakest; a missing inventory outweighs what is wrong with the destination. Fixed values.
STATES = ("invalid_configuration", "missing_evidence", "expired", "incompatible", "ready_with_warnings")
#: State and the code that reports it. Fixed values.
READINESS_CODES = {
    "missing_evidence": "readiness_missing_evidence",
    "incompatible": "readiness_incompatible_evidence",
    "expired": "readiness_expired_evidence",
    "invalid_configuration": "readiness_invalid_configuration",
}


def too_long(columns: Sequence[str]) -> Column:
    return F.greatest(F.lit(0), *(F.coalesce(F.length(F.col(c)), F.lit(0)) for c in columns)) > MAX_FIELD


def address(column: str, origin: str) -> Column:
    """The normalised address, resolved against the origin."""
    return resolve_url(F.col(column), F.lit(origin))


def inventory(rows: DataFrame, source_origin: str, destination_origin: str, fields: Sequence[str] = ("raw", "proposed")) -> DataFrame:
    """seq, raw, normalized, proposed (normalised), state, diagnostics of each row (seq, raw, proposed).

    The first row of an address stands. A later one is a duplicate, or in conflict if it proposes another destination than the
    first; then the first is in conflict too. An invalid address or a field above MAX_FIELD is invalid, another origin out of
    scope; these states hold against duplicate and conflict, the diagnostics add up. fields: the columns whose lengths count.
    """
    own = rows.withColumns({"u": address("raw", source_origin), "d": address("proposed", destination_origin), "long": too_long(fields)})
    own = own.select("seq", "raw", F.col("u.normalized").alias("normalized"), F.col("u.origin").alias("origin"), F.col("u.error_code").alias("error"), F.when(F.col("proposed") != "", F.col("d.normalized")).alias("proposed"), "long")
    # Rows without an address have a key of their own, so they are no hot group.
    own = own.withColumn("key", F.coalesce("normalized", F.concat(F.lit(":"), F.col("seq").cast("string"))))
    known = F.col("normalized").isNotNull()
    own = own.join(own.where(known).groupBy("key").agg(F.min_by(F.struct("seq", "proposed"), "seq").alias("first")), "key", "left")
    later = known & (F.col("seq") > F.col("first.seq"))
    own = own.withColumn("torn", later & ~F.col("proposed").eqNullSafe(F.col("first.proposed")))
    own = own.join(own.where("torn").select("key").distinct().withColumn("split", F.lit(True)), "key", "left")
    own = own.withColumn("split", known & ~later & F.coalesce("split", F.lit(False)))
    foreign = known & (F.col("origin") != source_origin)
    state = (
        F.when(foreign, "out_of_scope").when(F.col("long") | F.col("error").isNotNull(), "invalid")
        .when(F.col("torn") | F.col("split"), "conflict").when(later, "duplicate").otherwise("valid")
    )
    diagnostics = F.array_compact(F.array(
        F.when(F.col("long"), "inventory_field_too_long"), F.when(F.col("error") == "unsupported_scheme", "inventory_unsupported_scheme").when(F.col("error").isNotNull(), "inventory_invalid_url"),
        F.when(foreign, "inventory_out_of_scope"), F.when(F.col("torn") | F.col("split"), "inventory_conflicting_destination"), F.when(later, "inventory_duplicate_source"),
    ))
    return own.select("seq", "raw", "normalized", "proposed", state.alias("state"), diagnostics.alias("diagnostics"))


def redirect_map(rows: DataFrame, source_origin: str, destination_origin: str, fields: Sequence[str] = ("raw_source", "raw_destination")) -> DataFrame:
    """seq, raw_source, raw_destination, source, destination, expected_status, state, diagnostics of each row (seq, raw_source, raw_destination, status text).

    A row without two addresses is invalid; a later row of a source is a duplicate if it leads where the first does, else in
    conflict. A destination of several sources collides in all rows up to the last that brings a new source. Loops and chains
    are told from the valid rows, for each row of a source that has one.
    """
    none_if_empty = lambda c, a: F.when(F.col(c) != "", a["normalized"])
    own = rows.withColumns({"u": address("raw_source", source_origin), "v": address("raw_destination", destination_origin), "long": too_long(fields)})
    own = own.select("seq", "raw_source", "raw_destination", none_if_empty("raw_source", F.col("u")).alias("source"), none_if_empty("raw_destination", F.col("v")).alias("destination"), "long", F.when(F.col("status").rlike("^[0-9]+$"), F.col("status").cast("int")).alias("expected_status"))
    both = F.col("source").isNotNull() & F.col("destination").isNotNull()
    # Half rows have keys of their own, so they are no hot group.
    alone = F.concat(F.lit(":"), F.col("seq").cast("string"))
    own = own.withColumns({"from": F.when(both, F.col("source")).otherwise(alone), "to": F.when(both, F.col("destination")).otherwise(alone)})
    pairs = own.where(both).groupBy("from", "to").agg(F.min("seq").alias("seq"))
    first = pairs.groupBy("from").agg(F.min_by(F.struct("seq", F.col("to").alias("destination")), "seq").alias("first"))
    shared = pairs.groupBy("to").agg(F.count(F.lit(1)).alias("sources"), F.max("seq").alias("last"))
    own = own.join(first, "from", "left").join(shared, "to", "left")
    again = both & (F.col("seq") > F.col("first.seq"))
    same = F.col("destination") == F.col("first.destination")
    odd = F.col("expected_status").isNotNull() & ~F.col("expected_status").isin(*STATUSES)
    state = F.when(F.col("long") | ~both | odd, "invalid").when(again & same, "duplicate").when(again, "conflict").otherwise("valid")
    collides = both & (F.col("sources") > 1) & (F.col("seq") <= F.col("last"))
    own = own.withColumn("state", state)
    valid = own.where("state = 'valid'").select(F.col("source").alias("source_url"), F.col("destination").alias("destination_url"))
    graph = planned_graph(valid).where("diagnostic IS NOT NULL").select(F.col("source_url").alias("source"), "diagnostic")
    own = own.join(graph, "source", "left")
    diagnostics = F.array_sort(F.array_compact(F.array(
        F.when(F.col("long") | ~both, "redirect_map_invalid_url"), F.when(again & same, "redirect_map_duplicate_source"), F.when(again & ~same, "redirect_map_conflicting_destination"), F.when(collides, "redirect_destination_collision"),
        F.when(odd, "redirect_map_unsupported_status"), F.when(F.col("expected_status").isNull(), "redirect_map_status_missing"), F.col("diagnostic"),
    )))
    return own.select("seq", "raw_source", "raw_destination", "source", "destination", "expected_status", "state", diagnostics.alias("diagnostics"))


def input_findings(sources: DataFrame, redirects: DataFrame) -> DataFrame:
    """input, seq, source_url, destination_url, code of what inventory() and redirect_map() told."""
    one = sources.select(F.lit("inventory").alias("input"), "seq", F.coalesce("normalized", "raw").alias("source_url"), F.lit(None).cast("string").alias("destination_url"), F.explode("diagnostics").alias("code"))
    two = redirects.select(F.lit("redirect_map").alias("input"), "seq", F.coalesce("source", "raw_source").alias("source_url"), F.coalesce("destination", "raw_destination").alias("destination_url"), F.explode("diagnostics").alias("code"))
    return one.unionByName(two.where(F.col("code").isin(*REDIRECT_FINDINGS)))


def readiness(facts: DataFrame) -> DataFrame:
    """facts with state, reasons (in the order of READINESS) and code (null where nothing blocks): a row for each project.

    facts: configuration_valid, destination_known, destination_terminal, evidence_expired, source_run_named, source_run_usable
    and compare_* (boolean); destination_pages, foreign_versions, sources, bad_sources, bad_redirects, links, sitemaps, images and
    structured_data (counts). Nulls count as false and 0.
    """
    flags = {c: F.coalesce(F.col(c), F.lit(False) if t == "boolean" else F.lit(0)) for c, t in facts.dtypes if t in ("boolean", "bigint", "int")}
    own = facts.withColumns(flags)
    own = own.withColumn("hits", F.array_compact(F.array(*(F.when(F.expr(when), F.struct(F.lit(reason).alias("reason"), F.lit(state).alias("state"))) for reason, state, when in READINESS))))
    states = F.transform("hits", lambda h: h["state"])
    cascade = F.lit("ready")
    for s in reversed(STATES):
        cascade = F.when(F.array_contains(states, s), s).otherwise(cascade)
    own = own.withColumns({"state": cascade, "reasons": F.transform("hits", lambda h: h["reason"])})
    code = F.element_at(F.create_map(*(F.lit(x) for kv in READINESS_CODES.items() for x in kv)), F.col("state"))
    return own.withColumn("code", code).drop("hits")
