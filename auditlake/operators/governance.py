"""URL governance: layered rules, matches, precedence, overrides, decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.functions.urls import governed_url, TRACKING_PARAMETERS, governed_parts

RULE_SCHEMA = "rule_id string, match_type string, match_value string, case_sensitive boolean, action string, priority int, source string, overrides array<string>"
#: Ranks of sources and match types. Fixed values.
SOURCE_RANK_SQL = "CASE source WHEN 'global' THEN 0 WHEN 'preset' THEN 1 WHEN 'site_profile' THEN 2 ELSE 3 END"
SPECIFICITY_SQL = "CASE match_type WHEN 'exact_url' THEN 6 WHEN 'exact_path' THEN 5 WHEN 'query_parameter_equals' THEN 4 WHEN 'query_parameter_exists' THEN 3 WHEN 'path_contains' THEN 1 ELSE 2 END"
LAYER_SQL = """CASE action WHEN 'strip_query_parameter' THEN 'normalization' WHEN 'exclude_from_discovery' THEN 'discovery' WHEN 'exclude_from_metadata_scoring' THEN 'metadata'
 WHEN 'exclude_from_sitemap' THEN 'sitemap' ELSE 'review' END"""
#: The preset of a WordPress site: rule, match type, value, action, enabled. Fixed values.
WORDPRESS = (
    ("wordpress.admin", "path_starts_with", "/wp-admin/", "exclude_from_discovery", True), ("wordpress.login", "exact_path", "/wp-login.php", "exclude_from_discovery", True), ("wordpress.xmlrpc", "exact_path", "/xmlrpc.php", "exclude_from_discovery", True),
    ("wordpress.cdn_cgi", "path_starts_with", "/cdn-cgi/", "exclude_from_discovery", True), ("wordpress.wp_json", "path_starts_with", "/wp-json/", "exclude_from_discovery", False), ("wordpress.feeds", "path_starts_with", "/feed/", "exclude_from_discovery", False),
    ("wordpress.search", "path_starts_with", "/search/", "exclude_from_discovery", False), ("wordpress.attachments", "path_starts_with", "/attachment/", "exclude_from_discovery", False), ("wordpress.comment_reply", "path_starts_with", "/comment-reply/", "exclude_from_discovery", False),
    ("wordpress.tag.metadata", "path_starts_with", "/tag/", "exclude_from_metadata_scoring", True), ("wordpress.tag.sitemap", "path_starts_with", "/tag/", "exclude_from_sitemap", True), ("wordpress.author.metadata", "path_starts_with", "/author/", "exclude_from_metadata_scoring", True),
    ("wordpress.author.sitemap", "path_starts_with", "/author/", "exclude_from_sitemap", True), ("wordpress.date.metadata", "path_starts_with", "/date/", "exclude_from_metadata_scoring", True), ("wordpress.date.sitemap", "path_starts_with", "/date/", "exclude_from_sitemap", True),
    ("wordpress.pagination.sitemap_review", "query_parameter_exists", "page", "mark_for_review", True),
)


def preset_rules(disabled_too: bool = False) -> list[tuple]:
    return [(i, kind, value, True, action, 100, "preset", []) for i, kind, value, action, enabled in WORDPRESS if enabled or disabled_too]


def effective(layers: list[list[tuple]]) -> list[tuple]:
    """Rules of layers from the general to the particular; a later rule of the same id stands for the earlier."""
    return list({r[0]: r for layer in layers for r in layer}.values())


def stripped_parameters(exceptions: tuple[str, ...] = ()) -> tuple[str, ...]:
    return tuple(p for p in TRACKING_PARAMETERS if p not in exceptions)


def matches(urls: DataFrame, rules: list[tuple]) -> DataFrame:
    """url_id with a row for each rule that matches. urls: url_id, g (governed struct). rules: tuples of RULE_SCHEMA.

    Rules are at most some hundreds and become one array expression in the scan: no join of all with all.
    """
    pairs = F.coalesce(F.col("g.pairs"), F.array().cast("array<struct<name:string,value:string>>"))
    found = []
    for rule_id, kind, value, exact_case, action, priority, source, overrides in rules:
        fold = (lambda c: c) if exact_case else F.lower
        left = value if exact_case else value.lower()
        path = fold(F.col("g.path"))
        if kind == "exact_url":
            expected = governed_parts(value)["syntax"]
            hit = F.lit(False) if expected is None else fold(F.col("g.syntax")) == fold(F.lit(expected))
        elif kind == "exact_path":
            hit = path == left
        elif kind == "path_starts_with":
            hit = path.startswith(left)
        elif kind == "path_contains":
            hit = path.contains(left)
        elif kind == "path_ends_with":
            hit = path.endswith(left)
        elif kind == "query_parameter_exists":
            hit = F.array_contains(F.transform(pairs, name_of(exact_case)), left)
        else:
            hit = F.array_contains(F.transform(pairs, pair_of(exact_case)), left)
        row = F.struct(F.lit(rule_id).alias("rule_id"), F.lit(kind).alias("match_type"), F.lit(action).alias("action"), F.lit(priority).alias("priority"), F.lit(source).alias("source"), F.array(*map(F.lit, overrides)).cast("array<string>").alias("overrides"))
        found.append(F.when(hit, row))
    own = urls.where("g.error_code is null").select("url_id", F.explode(F.array_compact(F.array(*found))).alias("r")).select("url_id", "r.*")
    return own.withColumns({"layer": F.expr(LAYER_SQL), "source_rank": F.expr(SOURCE_RANK_SQL), "specificity": F.expr(SPECIFICITY_SQL)})


def name_of(exact_case: bool):
    return (lambda p: p["name"]) if exact_case else (lambda p: F.lower(p["name"]))


def pair_of(exact_case: bool):
    joined = lambda p: F.concat(p["name"], F.lit("="), p["value"])
    return joined if exact_case else (lambda p: F.lower(joined(p)))


def decisions(found: DataFrame) -> DataFrame:
    """url_id, layer, outcome, primary_rule, contributing, conflict: per layer the first rule by source, specificity, priority, id.

    Rules that another matching rule of the URL overrides take no part.
    """
    gone = found.select("url_id", F.explode("overrides").alias("rule_id")).distinct()
    active = found.join(gone, ["url_id", "rule_id"], "left_anti")
    order = Window.partitionBy("url_id", "layer").orderBy(F.desc("source_rank"), F.desc("specificity"), F.desc("priority"), "rule_id")
    ranked = active.withColumn("place", F.row_number().over(order))
    return ranked.groupBy("url_id", "layer").agg(
        F.min_by("action", "place").alias("outcome"), F.min_by("rule_id", "place").alias("primary_rule"), F.count(F.lit(1)).alias("contributing"), (F.countDistinct("action") > 1).alias("conflict")
    )


def inventory(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """key, source, url: URLs of several sources (each with key, url, seq); the first source that has a key wins."""
    parts = [df.select("key", "url", "seq", F.lit(i).alias("rank"), F.lit(name).alias("source")) for i, (name, df) in enumerate(sources)]
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("key").agg(F.min_by(F.struct("source", "url"), F.struct("rank", "seq")).alias("f")).select("key", "f.source", "f.url")


def exclusion_matches(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """url_id, place, rule_type, value of every configured exclusion that matches, in order. urls: url_id, u (normalised struct).

    Here a path prefix ends at a segment, other than in governance rules.
    """
    pairs = F.split(F.coalesce("u.query", F.lit("")), "&")
    names = F.transform(pairs, lambda p: F.split_part(p, F.lit("="), F.lit(1)))
    path = F.col("u.path")
    tests = {
        "exact_url": lambda v: F.col("u.normalized") == v, "exact_path": lambda v: path == v, "path_prefix": lambda v: path.startswith("/") if v == "/" else (path == v.rstrip("/")) | path.startswith(v.rstrip("/") + "/"), "path_contains": lambda v: path.contains(v),
        "path_suffix": lambda v: path.endswith(v), "query_parameter": lambda v: F.array_contains(names, v), "query_parameter_equals": lambda v: F.array_contains(pairs, v),
    }
    hits = F.array(*(F.when(tests[kind](value), F.struct(F.lit(i).alias("place"), F.lit(kind).alias("rule_type"), F.lit(value).alias("value"))) for i, (kind, value) in enumerate(rules)))
    return urls.where("u.error_code is null").select("url_id", F.explode(F.array_compact(hits)).alias("r")).select("url_id", "r.*")


def variants(pages: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """url_id (a struct of page_id and kind), page_id, kind, url: every observed URL of a page; kinds: name -> column."""
    listed = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(c).alias("url"))) for k, c in kinds.items())))
    own = pages.select("page_id", F.explode(listed).alias("v")).select("page_id", "v.kind", "v.url")
    return own.select(F.struct("page_id", "kind").alias("url_id"), "page_id", "kind", "url")


def variant_decisions(pages: DataFrame, kinds: dict[str, str], rules: list[tuple]) -> DataFrame:
    """page_id, kind and the decisions of every observed URL of every page."""
    found = decisions(matches(variants(pages, kinds).select("url_id", governed_url(F.col("url")).alias("g")), rules))
    return found.select("url_id.page_id", "url_id.kind", *(c for c in found.columns if c != "url_id"))


def tested(urls: DataFrame, rules: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """(matches, decisions) of a few URLs (column url) under rules that aren't in force yet; URLs that can't be read match nothing."""
    own = matches(urls.select(F.col("url").alias("url_id"), governed_url(F.col("url")).alias("g")), rules)
    return own, decisions(own)
