"""Image audit: alternative texts, dimensions, loading, severity, recommendations, duplicate groups, page summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Alternative texts that say nothing. Fixed values.
GENERIC_ALTS = ("image", "photo", "picture", "graphic", "icon", "logo", "banner", "thumbnail", "click here", "read more", "learn more")
#: What looks like a file's name, and like an address. Fixed values.
FILENAME = r"^(?:img[_-]?\d+|dsc\d+|photo[_-]?\d+|image(?:[_-]\d+)+|[\w-]+(?:final|copy|v\d+)[\w-]*|[^/\\]+\.(?:jpe?g|png|gif|webp|svg|avif))$"
URLISH = r"^(?:https?://|www\.|/|[A-Za-z]:\\|[^\s]+\.[a-z]{2,}(?:/|$))"
#: Characters of a collapsed alternative text that are looked at.
ALT_CHARACTERS = 1024
#: SQL of the states; `shown` is the text with white space collapsed, `name_like` and `url_like` are tests of it. Fixed values.
ALT_SQL = f"""CASE WHEN alt IS NULL THEN 'missing' WHEN alt <> '' AND shown = '' THEN 'whitespace' WHEN alt = '' AND linked THEN 'link_empty' WHEN alt = '' AND decorative THEN 'decorative' WHEN alt = '' THEN 'empty'
 WHEN length(shown) > 200 THEN 'overlong' WHEN lower(shown) IN ({", ".join(f"'{a}'" for a in GENERIC_ALTS)}) THEN 'generic' WHEN name_like THEN 'filename' WHEN url_like THEN 'url' ELSE 'present' END"""
DIMENSION_SQL = """CASE WHEN width IS NULL AND height IS NULL THEN 'both_missing' WHEN width IS NULL THEN 'width_missing' WHEN height IS NULL THEN 'height_missing' WHEN width_px IS NULL THEN 'invalid_width' WHEN height_px IS NULL THEN 'invalid_height'
 WHEN width_px = 0 OR height_px = 0 THEN 'zero' WHEN width_px < 0 OR height_px < 0 THEN 'review' ELSE 'present' END"""
LOADING_SQL = """CASE WHEN lower(trim(coalesce(loading, ''))) IN ('lazy', 'eager') THEN lower(trim(loading)) WHEN trim(coalesce(loading, '')) <> '' THEN 'invalid' WHEN lower(trim(coalesce(decoding, ''))) = 'async' THEN 'decoding_async'
 WHEN lower(trim(coalesce(priority, ''))) = 'high' THEN 'fetchpriority_high' ELSE 'missing' END"""
RESOURCE_SQL = """CASE WHEN src LIKE 'data:%' THEN 'data' WHEN lower(src) LIKE '%placeholder%' THEN 'placeholder' WHEN NOT internal THEN 'external' WHEN resource_status >= 400 THEN 'broken' WHEN resource_status >= 300 THEN 'redirecting'
 WHEN resource_status IS NULL THEN 'unverified' ELSE 'working' END"""
#: Condition, severity, reason; the first that holds counts. Fixed values.
SEVERITIES = (
    ("resource = 'broken' AND reuse >= 5", "critical", "broken_internal_image"),
    ("resource = 'broken'", "high", "broken_internal_image"),
    ("resource = 'redirecting'", "medium", "redirecting_image_source"),
    ("resource = 'placeholder'", "medium", "placeholder_image"),
    ("resource = 'external'", "info", "external_image_review"),
    ("alt_state IN ('missing', 'link_empty') AND linked", "high", "missing_alt_linked"),
    ("alt_state IN ('missing', 'link_empty') AND reuse > 1", "high", "missing_alt"),
    ("alt_state IN ('missing', 'link_empty')", "medium", "missing_alt"),
    ("alt_state = 'generic'", "medium", "generic"),
    ("alt_state = 'filename'", "medium", "filename"),
    ("alt_state = 'url'", "medium", "url"),
    ("alt_state IN ('empty', 'whitespace')", "low", "empty_alt_review"),
    ("alt_state = 'overlong'", "low", "overlong_alt_review"),
    ("dimension_state <> 'present' AND reuse >= 5", "medium", "missing_or_invalid_dimensions"),
    ("dimension_state <> 'present'", "low", "missing_or_invalid_dimensions"),
    ("loading_state IN ('invalid', 'missing')", "low", "loading_attribute_review"),
    ("true", "info", "valid_image_occurrence"),
)
ACTION_SQL = """CASE reason WHEN 'broken_internal_image' THEN 'fix_url' WHEN 'redirecting_image_source' THEN 'update_destination' WHEN 'placeholder_image' THEN 'replace_placeholder' WHEN 'external_image_review' THEN 'review'
 WHEN 'missing_alt' THEN 'add_alt' WHEN 'missing_alt_linked' THEN 'add_alt' WHEN 'generic' THEN 'replace_alt' WHEN 'filename' THEN 'replace_alt' WHEN 'url' THEN 'replace_alt' WHEN 'overlong_alt_review' THEN 'replace_alt'
 WHEN 'empty_alt_review' THEN 'confirm_decorative' WHEN 'missing_or_invalid_dimensions' THEN 'add_dimensions' WHEN 'loading_attribute_review' THEN 'review_loading' ELSE 'no_action' END"""


def first_of(place: int) -> str:
    """SQL of the severity (1) or reason (2) of the first condition that holds."""
    return "CASE " + " ".join(f"WHEN {x[0]} THEN '{x[place]}'" for x in SEVERITIES) + " END"


def occurrences(images: DataFrame) -> DataFrame:
    """images (page_id, index, src, alt, width, height, loading, decoding, priority, linked, decorative, internal, resource_status) with all states, reuse, severity, reason, action."""
    reuse = images.groupBy("src").agg(F.countDistinct("page_id").alias("reuse"))
    shown = F.substring(F.trim(F.regexp_replace("alt", r"(?U)\s+", " ")), 1, ALT_CHARACTERS)
    own = images.join(reuse, "src").withColumn("shown", shown).withColumns({
        "name_like": F.col("shown").rlike(f"(?iU){FILENAME}"), "url_like": F.col("shown").rlike(f"(?iU){URLISH}"),
        "width_px": F.expr("try_cast(trim(width) AS int)"), "height_px": F.expr("try_cast(trim(height) AS int)"),
    })
    own = own.withColumns({"alt_state": F.expr(ALT_SQL), "dimension_state": F.expr(DIMENSION_SQL), "loading_state": F.expr(LOADING_SQL), "resource": F.expr(RESOURCE_SQL)})
    own = own.withColumns({"severity": F.expr(first_of(1)), "reason": F.expr(first_of(2))})
    return own.select("page_id", "index", "src", "alt_state", "dimension_state", "loading_state", "resource", "reuse", "severity", "reason", F.expr(ACTION_SQL).alias("action"))


def duplicate_groups(images: DataFrame) -> DataFrame:
    """kind, value, distinct_count, occurrences: one alternative text for many images, one image with many texts."""
    shown = images.where("alt is not null and trim(alt) <> ''").withColumn("alt", F.lower(F.trim("alt")))
    per = shown.groupBy("alt", "src").agg(F.count(F.lit(1)).alias("n"))
    side = lambda kind, by: per.groupBy(by).agg(F.count(F.lit(1)).alias("distinct_count"), F.sum("n").alias("occurrences")).where("distinct_count > 1").select(F.lit(kind).alias("kind"), F.col(by).alias("value"), "distinct_count", "occurrences")
    return side("same_alt_many_images", "alt").unionByName(side("same_image_many_alts", "src"))


def page_summaries(found: DataFrame) -> DataFrame:
    """page_id, images, missing_alts, broken, unsized of each page with images."""
    return found.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("images"), F.count_if(F.col("alt_state") == "missing").alias("missing_alts"), F.count_if(F.col("resource") == "broken").alias("broken"), F.count_if(F.col("dimension_state") != "present").alias("unsized")
    )


def loading_distribution(found: DataFrame) -> DataFrame:
    """loading_state, occurrences."""
    return found.groupBy("loading_state").agg(F.count(F.lit(1)).alias("occurrences"))


def findings(found: DataFrame) -> DataFrame:
    """page_id, index, src, reason, severity, finding_type of the occurrences whose severity isn't info."""
    kind = F.when(F.contains("reason", F.lit("alt")), "alt").when(F.contains("reason", F.lit("dimension")), "dimension").when(F.contains("reason", F.lit("loading")), "loading").otherwise("resource")
    return found.where("severity <> 'info'").select("page_id", "index", "src", "reason", "severity", kind.alias("finding_type"))


def recommendations(found: DataFrame) -> DataFrame:
    """src, action, pages: what to do about an image, once for all pages that show it."""
    return found.where("action <> 'no_action'").groupBy("src", "action").agg(F.countDistinct("page_id").alias("pages"))


def with_pages(images: DataFrame, pages: DataFrame, *columns: str) -> DataFrame:
    """images (page_identity) with columns of the page requested under it, else of the first whose redirects end there."""
    from auditlake.operators.links import page_index

    return images.join(page_index(pages, *columns).withColumnRenamed("key", "page_identity"), "page_identity", "left")
