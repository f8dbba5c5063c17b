"""Structured data: findings on blocks, entities, properties and pages, profiles of entity types, and what to do about them.

A block is a row of `sources.html.blocks`. An entity is a type and an identifier of a block: a block has as many as it has
types or identifiers, whichever are more. Findings over the whole site are aggregates with partial sums: no group is gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entity types and the properties that they should have. Fixed values.
PROFILES = {
    "Organization": ("name", "url"),
    "LocalBusiness": ("name", "address"),
    "WebSite": ("name", "url"),
    "WebPage": ("name", "url"),
    "Article": ("headline", "author", "publisher", "datePublished"),
    "BlogPosting": ("headline", "author", "publisher", "datePublished"),
    "BreadcrumbList": ("itemListElement",),
    "Product": ("name", "offers"),
    "Offer": ("price", "priceCurrency"),
    "FAQPage": ("mainEntity",),
    "Event": ("name", "startDate", "location"),
    "Person": ("name",),
    "Hotel": ("name", "address"),
    "LodgingBusiness": ("name", "address"),
    "Restaurant": ("name", "address"),
    "Service": ("name",),
}
#: Types that share the profile of LocalBusiness. Fixed values.
LOCAL = ("ProfessionalService", "MedicalBusiness", "Physician", "Dentist")
#: Properties that should have one value. Fixed values.
SINGLE = (
    "name", "url", "logo", "telephone", "address", "headline", "publisher", "datePublished", "startDate", "price", "priceCurrency",
)
#: Types that need no review as unknown ones. Fixed values.
RECOGNIZED = (
    "Organization LocalBusiness ProfessionalService MedicalBusiness Physician Dentist Hotel LodgingBusiness Restaurant Product Offer "
    "Service WebSite WebPage AboutPage ContactPage CollectionPage Article BlogPosting NewsArticle FAQPage QAPage HowTo BreadcrumbList "
    "ItemList Person Event Place PostalAddress AggregateRating Review ImageObject VideoObject SearchAction SiteNavigationElement"
).split()
#: Code, category, severity, confidence, whether a person should look. Fixed values.
FINDINGS = (
    ("json_ld_invalid_json", "parse", "warning", "high", False),
    ("json_ld_empty_block", "parse", "warning", "high", False),
    ("json_ld_scalar_root", "parse", "warning", "high", False),
    ("json_ld_missing_context", "parse", "warning", "medium", False),
    ("json_ld_unrecognized_context", "parse", "info", "medium", True),
    ("json_ld_missing_type", "parse", "warning", "medium", False),
    ("json_ld_invalid_type", "entity", "warning", "medium", False),
    ("json_ld_duplicate_entity_id", "entity", "warning", "medium", False),
    ("json_ld_duplicate_block", "duplicate", "warning", "medium", False),
    ("json_ld_truncated", "parse", "warning", "high", False),
    ("json_ld_unsupported_script_type", "parse", "warning", "medium", True),
    ("microdata_missing_itemtype", "parse", "warning", "medium", False),
    ("microdata_empty_itemscope", "parse", "warning", "medium", False),
    ("microdata_unresolved_itemref", "parse", "warning", "medium", False),
    ("microdata_property_outside_scope", "parse", "warning", "high", False),
    ("microdata_invalid_itemid", "parse", "warning", "high", False),
    ("rdfa_missing_vocabulary_context", "parse", "warning", "medium", True),
    ("rdfa_property_without_subject", "parse", "info", "medium", True),
    ("rdfa_invalid_prefix_mapping", "parse", "warning", "high", False),
    ("rdfa_unsupported_pattern", "parse", "info", "medium", True),
    ("entity_missing_identifier", "entity", "info", "medium", True),
    ("entity_conflicting_types", "consistency", "warning", "medium", True),
    ("entity_duplicate_on_page", "duplicate", "warning", "medium", True),
    ("entity_inconsistent_across_pages", "consistency", "warning", "medium", True),
    ("property_missing_value", "property", "warning", "high", False),
    ("property_empty_value", "property", "warning", "high", False),
    ("property_duplicate_value", "property", "info", "medium", False),
    ("property_url_invalid", "property", "warning", "high", False),
    ("property_reference_unresolved", "property", "warning", "medium", False),
    ("page_multiple_primary_entities", "page", "info", "medium", True),
    ("page_structured_data_on_non_html_content", "page", "warning", "high", False),
    ("page_structured_data_on_error_status", "page", "warning", "high", False),
    ("page_structured_data_on_nonindexable_page", "page", "warning", "medium", True),
    ("sitewide_schema_inconsistency", "consistency", "warning", "medium", True),
)
#: What is to be done about a finding. Fixed values.
ACTIONS = (
    ("json_ld_invalid_json", "fix_invalid_json_ld"),
    ("json_ld_scalar_root", "fix_invalid_json_ld"),
    ("json_ld_empty_block", "remove_empty_structured_data_block"),
    ("json_ld_missing_context", "add_missing_context"),
    ("json_ld_unrecognized_context", "review_external_context"),
    ("json_ld_unsupported_script_type", "review_external_context"),
    ("json_ld_missing_type", "add_missing_type"),
    ("json_ld_invalid_type", "review_unknown_type"),
    ("json_ld_duplicate_entity_id", "resolve_duplicate_entity_id"),
    ("json_ld_duplicate_block", "consolidate_duplicate_entity"),
    ("entity_conflicting_types", "resolve_conflicting_entity_types"),
    ("entity_inconsistent_across_pages", "resolve_inconsistent_entity_values"),
    ("property_empty_value", "fix_empty_property"),
    ("property_url_invalid", "fix_invalid_property_url"),
    ("property_reference_unresolved", "resolve_unresolved_reference"),
    ("page_multiple_primary_entities", "review_multiple_primary_entities"),
    ("page_structured_data_on_nonindexable_page", "review_nonindexable_page_schema"),
    ("page_structured_data_on_error_status", "review_error_page_schema"),
    ("sitewide_schema_inconsistency", "review_sitewide_schema_inconsistency"),
    ("json_ld_truncated", "review_truncated_evidence"),
    ("microdata_empty_itemscope", "remove_empty_structured_data_block"),
)
#: Pages with structured data from which different sets of types over the site are a finding.
SITEWIDE_PAGES = 3

#: Code and condition on a block, whose columns are those of `sources.html.blocks`.
BLOCK_RULES = (
    ("json_ld_invalid_json", "error = 'invalid_json'"),
    ("json_ld_scalar_root", "root = 'scalar'"),
    ("json_ld_empty_block", "root = 'empty'"),
    ("json_ld_truncated", "truncated"),
    ("json_ld_missing_context", "format = 'json_ld' AND size(contexts) = 0"),
    ("json_ld_unrecognized_context", "format = 'json_ld' AND exists(contexts, c -> lower(c) NOT LIKE '%schema.org%')"),
    ("json_ld_unsupported_script_type", "format = 'json_ld' AND lower(trim(split_part(coalesce(script_type, ''), ';', 1))) <> 'application/ld+json'"),
    ("json_ld_missing_type", "format = 'json_ld' AND size(types) = 0 AND coalesce(error, '') <> 'invalid_json'"),
    ("microdata_missing_itemtype", "format = 'microdata' AND size(types) = 0"),
    ("microdata_empty_itemscope", "format = 'microdata' AND size(properties) = 0"),
    ("microdata_unresolved_itemref", "format = 'microdata' AND exists(diagnostics, x -> startswith(x, 'microdata_unresolved_itemref:'))"),
    ("microdata_property_outside_scope", "array_contains(diagnostics, 'microdata_property_outside_scope')"),
    ("microdata_invalid_itemid", "array_contains(diagnostics, 'microdata_invalid_itemid')"),
    ("rdfa_missing_vocabulary_context", "format = 'rdfa' AND size(contexts) = 0"),
    ("rdfa_property_without_subject", "format = 'rdfa' AND size(properties) > 0 AND size(ids) = 0"),
    ("rdfa_invalid_prefix_mapping", "array_contains(diagnostics, 'rdfa_invalid_prefix_mapping')"),
    ("rdfa_unsupported_pattern", "array_contains(diagnostics, 'rdfa_unsupported_pattern')"),
)
#: Code and condition on a block of a page with these facts.
PAGE_RULES = (
    ("page_structured_data_on_error_status", "http_status >= 400"),
    (
        "page_structured_data_on_non_html_content",
        "lower(split_part(content_type, ';', 1)) NOT IN ('', 'text/html', 'application/xhtml+xml')",
    ),
    ("page_structured_data_on_nonindexable_page", "indexability_state = 'non_indexable'"),
)
#: Code and condition on a property of an entity: property (its name), values, ids and diagnostics of its block.
PROPERTY_RULES = (
    ("property_empty_value", "forall(values, v -> trim(v) = '')"),
    ("property_missing_value", "array_contains(diagnostics, concat('property_missing_value:', property))"),
    ("property_duplicate_value", "size(array_distinct(values)) < size(values)"),
)
#: Properties that hold addresses. Fixed values.
ADDRESSES = ("url", "sameas", "image", "logo")
KEYS = ("page_id", "index", "entity")


def short_type(value: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(value, "[/#]"), -1), "^schema:", "")


def _hits(rules: tuple) -> Column:
    return F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(code)) for code, rule in rules)))


def _found(df: DataFrame, page: str | None = "page_id", index: str | None = "index", entity: str | None = None, subject: str | None = None) -> DataFrame:
    """page_id, index, entity, code, subject of a frame with codes, null where a finding has none of these."""
    one = lambda c, kind: F.lit(None).cast(kind) if c is None else F.col(c).cast(kind)
    return df.select(one(page, "long").alias("page_id"), one(index, "int").alias("index"), one(entity, "int").alias("entity"), "code", one(subject, "string").alias("subject"))


def entities(blocks: DataFrame) -> DataFrame:
    """blocks with entity (its number in the block), entity_type and identifier; the last type or identifier serves for those that lack one."""
    count = F.greatest(F.size("types"), F.size("ids"), F.lit(1))
    own = blocks.withColumn("entity", F.explode(F.sequence(F.lit(0), count - 1)))
    at = lambda c: F.try_element_at(c, F.least(F.col("entity") + 1, F.greatest(F.size(c), F.lit(1))))
    return own.withColumns({"entity_type": at("types"), "identifier": at("ids")})


def block_findings(blocks: DataFrame) -> DataFrame:
    """page_id, index, entity (null), code, subject (null) of what is wrong with a block's own syntax."""
    return _found(blocks.select("page_id", "index", F.explode(_hits(BLOCK_RULES)).alias("code")))


def page_findings(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """The same of blocks on pages that shouldn't have any; pages: page_id, http_status, content_type, indexability_state."""
    own = blocks.select("page_id", "index").join(pages, "page_id")
    return _found(own.select("page_id", "index", F.explode(_hits(PAGE_RULES)).alias("code")))


def entity_findings(blocks: DataFrame) -> DataFrame:
    """page_id, index, entity, code, subject (a property or what a reference names) of entities and their properties."""
    own = entities(blocks)
    code = F.array(F.when(F.col("identifier").isNull(), F.lit("entity_missing_identifier")), F.when((F.col("entity_type") != "") & malformed_type(F.col("entity_type")), F.lit("json_ld_invalid_type")))
    kinds = _found(own.select(*KEYS, F.explode(F.array_compact(code)).alias("code")), entity="entity")
    held = own.select(*KEYS, "diagnostics", F.explode("properties").alias("property", "values"))
    states = _found(held.select(*KEYS, "property", F.explode(_hits(PROPERTY_RULES)).alias("code")), entity="entity", subject="property")
    values = held.where(F.lower("property").isin(*ADDRESSES)).select(*KEYS, "property", F.explode("values").alias("value"))
    wrong = values.where("value not in ('', '[reference]', '[structured]') and not value rlike '^(?i:https?):'").withColumn("code", F.lit("property_url_invalid"))
    lost = own.select(*KEYS, F.explode(F.array_except("references", "ids")).alias("to")).withColumn("code", F.lit("property_reference_unresolved"))
    return kinds.unionByName(states).unionByName(_found(wrong, entity="entity", subject="property")).unionByName(_found(lost, entity="entity", subject="to"))


def consistency_findings(blocks: DataFrame) -> DataFrame:
    """The same of blocks that repeat, of identifiers used in different ways, of pages with several entities, and of the site.

    A finding on a group stands at its first block, one on the whole site at none.
    """
    first = F.min(F.struct("page_id", "index")).alias("first")
    copies = blocks.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), first, F.max(F.col("format") == "json_ld").alias("json")).where("n > 1")
    copied = _found(copies.select("first.page_id", F.expr("if(json, 'json_ld_duplicate_block', 'entity_duplicate_on_page')").alias("code"), "fingerprint"), index=None, subject="fingerprint")
    own = entities(blocks)
    shown = F.xxhash64(F.to_json(F.array_sort(F.map_entries("properties"))))
    named = own.where("identifier is not null").select(*KEYS, "identifier", "entity_type", shown.alias("shown"))
    families = {f"family{i}": F.min(F.col("entity_type").isin(*f)) for i, f in enumerate(FAMILIES)}
    # Rows of one identifier on one page come together first, so that an identifier of every page isn't one task's work.
    by_page = named.groupBy("identifier", "page_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("index", "entity")).alias("at"), F.min("shown").alias("low"), F.max("shown").alias("high"),
        F.min("entity_type").alias("first_type"), F.max("entity_type").alias("last_type"), *(c.alias(k) for k, c in families.items()),
    )
    used = by_page.groupBy("identifier").agg(
        F.min(F.struct("page_id", "at")).alias("at"), F.max("n").alias("most"), F.min(F.when(F.col("n") > 1, F.struct("page_id", "at"))).alias("twice"), F.min("page_id").alias("p"), F.max("page_id").alias("q"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("first_type").alias("t"), F.max("last_type").alias("u"), *(F.min(k).alias(k) for k in families),
    )
    together = reduce(lambda a, b: a | b, (F.coalesce(F.col(k), F.lit(False)) for k in families))
    codes = F.array(
        F.when(F.col("most") > 1, F.lit("json_ld_duplicate_entity_id")),
        F.when((F.col("low") != F.col("high")) & (F.col("p") != F.col("q")), F.lit("entity_inconsistent_across_pages")),
        F.when((F.col("t") != F.col("u")) & ~together, F.lit("entity_conflicting_types")),
    )
    differing = used.select("at.page_id", "at.at.index", "at.at.entity", "identifier", F.explode(F.array_compact(codes)).alias("code"))
    several = own.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("code", F.lit("page_multiple_primary_entities"))
    kinds = blocks.groupBy("page_id").agg(*(f(F.array_join(F.array_sort(F.array_distinct("types")), "\n")).alias(n) for n, f in (("low", F.min), ("high", F.max))))
    site = kinds.agg(F.count(F.lit(1)).alias("pages"), F.min("low").alias("low"), F.max("high").alias("high")).where(f"pages >= {SITEWIDE_PAGES} and low <> high")
    site = site.withColumn("code", F.lit("sitewide_schema_inconsistency"))
    return (
        copied.unionByName(_found(differing, entity="entity", subject="identifier"))
        .unionByName(_found(several, index=None))
        .unionByName(_found(site, page=None, index=None))
    )


def findings(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, index, entity, code, subject, category, severity, confidence, review: all findings on structured data.

    blocks: rows of `sources.html.blocks`, read several times, so best a written table.
    """
    every = block_findings(blocks).unionByName(page_findings(blocks, pages)).unionByName(entity_findings(blocks)).unionByName(consistency_findings(blocks))
    kinds = blocks.sparkSession.createDataFrame(FINDINGS, "code string, category string, severity string, confidence string, review boolean")
    return every.join(F.broadcast(kinds), "code").select("page_id", "index", "entity", "code", "subject", "category", "severity", "confidence", "review")


def profile_state(name: Column, values: Column) -> Column:
    """missing, empty, indeterminate, conflicting, invalid or present."""
    shown = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    some = lambda test: F.exists(shown, lambda v: ~test(v))
    wrong = (
        (name.isin("url", "logo") & some(lambda v: v.rlike(r"^(?i:https?)://[^/?#]")))
        | ((name == "price") & some(lambda v: v.try_cast("double").isNotNull()))
        | ((name == "priceCurrency") & some(lambda v: v.rlike(r"^\p{L}{3}$")))
        | (name.isin("datePublished", "startDate") & some(lambda v: v.rlike(r"^(?s).{4}-.{2}-.{2}")))
    )
    return (
        F.when(values.isNull(), "missing")
        .when(F.size(shown) == 0, "empty")
        .when(F.array_contains(shown, "[structured]"), "indeterminate")
        .when(name.isin(*SINGLE) & (F.size(F.array_distinct(shown)) > 1), "conflicting")
        .when(wrong, "invalid")
        .otherwise("present")
    )


def profile_observations(blocks: DataFrame) -> DataFrame:
    """page_id, index, entity, profile, property, state of the properties that an entity's type should have."""
    rows = [(t, t, p) for t, ps in PROFILES.items() for p in ps] + [(t, "LocalBusiness", p) for t in LOCAL for p in PROFILES["LocalBusiness"]]
    wanted = blocks.sparkSession.createDataFrame(rows, "kind string, profile string, property string")
    own = entities(blocks).select(*KEYS, "properties", short_type(F.col("entity_type")).alias("kind"))
    state = profile_state(F.col("property"), F.try_element_at("properties", F.col("property")))
    return own.join(F.broadcast(wanted), "kind").select(*KEYS, "profile", "property", state.alias("state"))


def duplicates(blocks: DataFrame) -> DataFrame:
    """fingerprint, copies, pages, kind: the same block more than once on a page or over pages."""
    own = blocks.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("page_id").alias("pages")).where("copies > 1")
    return own.select("fingerprint", "copies", "pages", F.when(F.col("pages") > 1, "cross_page_duplicate").otherwise("on_page_duplicate").alias("kind"))


def entity_consistency(blocks: DataFrame) -> DataFrame:
    """identifier, pages, occurrences, variants, type_sets: entities that one identifier names in different ways."""
    own = blocks.where("size(ids) > 0").select("page_id", F.explode("ids").alias("identifier"), "fingerprint", F.array_join(F.array_sort(F.array_distinct("types")), ",").alias("t"))
    return own.groupBy("identifier").agg(F.countDistinct("page_id").alias("pages"), F.count(F.lit(1)).alias("occurrences"), F.countDistinct("fingerprint").alias("variants"), F.countDistinct("t").alias("type_sets"))


def recommendations(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, index, entity, action, reason (a code or profile.property), scope, priority, confidence: one row for each reason.

    found: the rows of `findings` of these blocks.
    """
    session = blocks.sparkSession
    row = lambda df, action, reason, scope, priority, confidence: df.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("index").cast("int").alias("index"), F.col("entity").cast("int").alias("entity"),
        *(c.alias(n) for c, n in ((action, "action"), (reason, "reason"), (scope, "scope"), (priority, "priority"), (confidence, "confidence"))),
    )
    known = F.broadcast(session.createDataFrame(ACTIONS, "code string, action string"))
    of_findings = row(found.join(known, "code"), F.col("action"), F.col("code"), F.expr("if(page_id is null, 'site', 'page')"), F.lit("medium"), F.col("confidence"))
    seen = profile_observations(blocks).where("state <> 'present'")
    gap = F.col("state").isin("missing", "empty", "invalid", "conflicting")
    actions = F.array_compact(F.array(
        F.when(gap, F.lit("add_missing_required_profile_property")),
        F.when(F.col("profile").isin("Article", "BlogPosting") & (F.col("property") == "publisher"), F.lit("review_article_publisher")),
        F.when(F.col("profile").isin("Product", "Offer") & F.col("property").isin("offers", "price", "priceCurrency"), F.lit("review_product_offer_relationship")),
        F.when(F.col("profile") == "BreadcrumbList", F.lit("review_breadcrumb_structure")),
    ))
    sure = F.expr("if(action = 'add_missing_required_profile_property' and state in ('missing', 'empty'), 'high', 'medium')")
    of_profiles = row(seen.withColumn("action", F.explode(actions)), F.col("action"), F.concat_ws(".", "profile", "property"), F.lit("entity"), F.lit("medium"), sure)
    mixed = blocks.groupBy("page_id").agg(F.min("format").alias("x"), F.max("format").alias("y")).where("x <> y").select("page_id", F.lit(None).alias("index"), F.lit(None).alias("entity"))
    of_pages = row(mixed, F.lit("review_schema_format_mix"), F.lit("formats"), F.lit("page"), F.lit("low"), F.lit("low"))
    own = entities(blocks).where("entity_type is not null").select(*KEYS, "entity_type", "identifier", short_type(F.col("entity_type")).alias("kind"))
    types = F.array_compact(F.array(
        F.when(F.col("kind") == "LocalBusiness", F.lit("review_local_business_subtype")),
        F.when(~F.col("kind").isin(*RECOGNIZED) & ~malformed_type(F.col("entity_type")), F.lit("review_unknown_type")),
        F.when((F.col("kind") == "Organization") & F.col("identifier").isNull(), F.lit("review_organization_identity")),
    ))
    weight = F.expr("if(action = 'review_organization_identity', 'medium', 'low')")
    of_types = row(own.withColumn("action", F.explode(types)), F.col("action"), F.col("entity_type"), F.lit("entity"), weight, weight)
    apart = found.where("code = 'entity_inconsistent_across_pages'").select(*KEYS, "code")
    unsure = apart.join(own.where("kind = 'Organization'").select(*KEYS), list(KEYS), "left_semi")
    of_names = row(unsure, F.lit("review_organization_identity"), F.col("code"), F.lit("site"), F.lit("medium"), F.lit("medium"))
    return of_findings.unionByName(of_profiles).unionByName(of_pages).unionByName(of_types).unionByName(of_names).distinct()


def page_counts(blocks: DataFrame) -> DataFrame:
    """page_id, blocks, entities (different blocks) of each page with structured data."""
    return blocks.groupBy("page_id").agg(F.count(F.lit(1)).alias("blocks"), F.countDistinct("fingerprint").alias("entities"))


def type_sets(blocks: DataFrame) -> DataFrame:
    """type_set, pages: which sets of types pages have; more than one set of a template is an inconsistency."""
    own = blocks.select("page_id", F.explode("types").alias("t")).groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("type_set"))
    return own.groupBy("type_set").agg(F.count(F.lit(1)).alias("pages"))


#: Types that may stand together on one entity. Fixed values.
FAMILIES = (
    ("LocalBusiness", "ProfessionalService", "MedicalBusiness", "Physician", "Dentist", "Hotel", "LodgingBusiness", "Restaurant"),
    ("Article", "BlogPosting", "NewsArticle"),
    ("WebPage", "AboutPage", "ContactPage", "CollectionPage"),
)


def malformed_type(value: Column) -> Column:
    """Empty, with white space, a keyword, or an address that isn't an http one with a host."""
    address = value.contains("://") & ~value.rlike(r"^(?i:https?)://[^/?#]")
    return (value == "") | value.rlike(r"\s") | value.startswith("@") | address
