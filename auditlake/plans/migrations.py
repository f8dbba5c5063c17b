"""Queries over a migration's inputs and over what changed between its two crawls.

The inputs are formulas of page_id, as in the other migration queries; the comparison SQL states the expected rows by hand from
the same remainders, or by joins of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import migration_changes, migration_inputs
from auditlake.plans.queries import DUCK_MIGRATION, MAPPED, NEW, OLD, _migration
from auditlake.plans.registry import query


def _pages(spark: SparkSession, d: str, text: str) -> DataFrame:
    return spark.sql(text.replace("FROM PAGES", "FROM {pages}"), pages=spark.read.parquet(f"{d}/pages.parquet").select("page_id"))


def _duck(text: str) -> str:
    return text.replace("FROM PAGES", "FROM pages").replace("AS STRING", "AS VARCHAR")


# -- inputs

INVENTORY = f"""SELECT page_id AS seq, CASE page_id % 9 WHEN 1 THEN concat('/p/', page_id) WHEN 2 THEN 'ftp://old.example/x' WHEN 3 THEN concat('https://else.example/p/', page_id) WHEN 4 THEN concat('HTTPS://OLD.example:443/p/', page_id - 4) WHEN 5 THEN 'https://old.example:bad/'
    WHEN 6 THEN concat('{OLD}/p/', page_id - 6) ELSE concat('{OLD}/p/', page_id) END AS raw, CASE WHEN page_id % 9 IN (0, 4) AND page_id % 2 = 0 THEN NULL WHEN page_id % 9 = 4 THEN concat('{NEW}/q/', page_id - 4) WHEN page_id % 9 = 6 THEN concat('{NEW}/z/', page_id) ELSE concat('{NEW}/q/', page_id) END AS proposed,
    CASE WHEN page_id % 25 = 24 THEN repeat('x', 4097) END AS note FROM PAGES"""
REDIRECTS = f"""SELECT page_id AS seq, CASE page_id % 10 WHEN 1 THEN concat('/r/', page_id - 1) WHEN 2 THEN concat('{OLD}/r/', page_id - 2) WHEN 8 THEN 'no host' ELSE concat('{OLD}/r/', page_id) END AS raw_source,
    CASE page_id % 10 WHEN 1 THEN concat('{NEW}/r/', page_id - 1) WHEN 2 THEN concat('{NEW}/else/', page_id) WHEN 3 THEN concat('/r/', page_id - 3) WHEN 4 THEN concat('{OLD}/r/', page_id + 1) WHEN 6 THEN concat('{OLD}/r/', page_id + 1) WHEN 7 THEN concat('{OLD}/r/', page_id - 1) ELSE concat('{NEW}/r/', page_id) END AS raw_destination,
    CASE WHEN page_id % 7 = 6 THEN '' WHEN page_id % 10 = 9 THEN '404' ELSE '301' END AS status FROM PAGES"""
#: Whether the row at a distance is there.
THERE = "EXISTS (SELECT 1 FROM pages p WHERE p.page_id = i.page_id + ({}))"


@query(f"""WITH own AS (SELECT page_id, page_id % 9 AS r, page_id % 10 AS t, page_id % 25 = 24 AS long, {THERE.format(-4)} AS four, {THERE.format(-6)} AS six, {THERE.format(6)} AS torn_by, {THERE.format(-1)} AS b1, {THERE.format(-2)} AS b2, {THERE.format(-3)} AS b3, {THERE.format(1)} AS n1, {THERE.format(2)} AS n2, {THERE.format(3)} AS n3 FROM pages i),
  address AS (SELECT *, CASE r WHEN 1 THEN '{OLD}/p/' || page_id WHEN 2 THEN 'ftp://old.example/x' WHEN 3 THEN 'https://else.example/p/' || page_id WHEN 4 THEN '{OLD}/p/' || (page_id - 4) WHEN 5 THEN 'https://old.example:bad/' WHEN 6 THEN '{OLD}/p/' || (page_id - 6) ELSE '{OLD}/p/' || page_id END AS a,
    CASE t WHEN 1 THEN '{OLD}/r/' || (page_id - 1) WHEN 2 THEN '{OLD}/r/' || (page_id - 2) WHEN 8 THEN 'no host' ELSE '{OLD}/r/' || page_id END AS s,
    CASE t WHEN 1 THEN '{NEW}/r/' || (page_id - 1) WHEN 2 THEN '{NEW}/else/' || page_id WHEN 3 THEN '{NEW}/r/' || (page_id - 3) WHEN 4 THEN '{OLD}/r/' || (page_id + 1) WHEN 6 THEN '{OLD}/r/' || (page_id + 1) WHEN 7 THEN '{OLD}/r/' || (page_id - 1) ELSE '{NEW}/r/' || page_id END AS e FROM own)
  SELECT 'inventory' AS input, page_id AS seq, a AS source_url, CAST(NULL AS VARCHAR) AS destination_url, 'inventory_field_too_long' AS code FROM address WHERE long
  UNION ALL SELECT 'inventory', page_id, a, NULL, CASE r WHEN 2 THEN 'inventory_unsupported_scheme' ELSE 'inventory_invalid_url' END FROM address WHERE r IN (2, 5)
  UNION ALL SELECT 'inventory', page_id, a, NULL, 'inventory_out_of_scope' FROM address WHERE r = 3
  UNION ALL SELECT 'inventory', page_id, a, NULL, 'inventory_duplicate_source' FROM address WHERE (r = 4 AND four) OR (r = 6 AND (six OR {THERE.replace("i.page_id", "address.page_id").format(-2)}))
  UNION ALL SELECT 'inventory', page_id, a, NULL, 'inventory_conflicting_destination' FROM address WHERE (r = 6 AND (six OR {THERE.replace("i.page_id", "address.page_id").format(-2)})) OR (r = 0 AND torn_by) OR (r = 4 AND NOT four AND {THERE.replace("i.page_id", "address.page_id").format(2)})
  UNION ALL SELECT 'redirect_map', page_id, s, e, 'redirect_map_invalid_url' FROM address WHERE t = 8
  UNION ALL SELECT 'redirect_map', page_id, s, e, 'redirect_map_duplicate_source' FROM address WHERE t = 1 AND b1
  UNION ALL SELECT 'redirect_map', page_id, s, e, 'redirect_map_conflicting_destination' FROM address WHERE t = 2 AND (b2 OR b1)
  UNION ALL SELECT 'redirect_map', page_id, s, e, 'redirect_destination_collision' FROM address WHERE (t = 0 AND n3) OR (t = 1 AND n2) OR (t = 3 AND (b3 OR b2))
  UNION ALL SELECT 'redirect_map', page_id, s, e, 'redirect_map_loop' FROM address WHERE (t = 6 AND n1) OR (t = 7 AND b1)
  UNION ALL SELECT 'redirect_map', page_id, s, e, 'redirect_map_chain' FROM address WHERE t = 4 AND n1""")
def migration_input_findings(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong in a source inventory and a redirect map."""
    sources = migration_inputs.inventory(_pages(spark, d, INVENTORY), OLD, NEW, ("raw", "proposed", "note"))
    return migration_inputs.input_findings(sources, migration_inputs.redirect_map(_pages(spark, d, REDIRECTS), OLD, NEW))


#: A project for each 8 pages, whose facts are counted from them.
FACTS = """SELECT project, project % 7 <> 6 AS configuration_valid, project % 11 <> 10 AS destination_known, project % 13 <> 12 AS destination_terminal, count_if(page_id % 16 < 12) AS destination_pages, project % 9 = 4 AS evidence_expired, count_if(page_id % 40 = 5) AS foreign_versions,
    count_if(page_id % 24 > 7) AS sources, count_if(page_id % 56 = 9) AS bad_sources, count_if(page_id % 64 = 20) AS bad_redirects, project % 3 = 0 AS source_run_named, project % 2 = 0 AS source_run_usable, true AS compare_internal_links, true AS compare_sitemaps, project % 4 <> 1 AS compare_images, true AS compare_structured_data,
    count_if(page_id % 48 <> 3) AS links, count_if(page_id % 80 > 7) AS sitemaps, count_if(page_id % 32 > 7) AS images, count_if(page_id % 72 > 7) AS structured_data FROM (SELECT page_id, CAST(floor(page_id / 8) AS BIGINT) AS project FROM PAGES) numbered GROUP BY project"""


@query(f"""WITH facts AS ({_duck(FACTS)}), judged AS (
    SELECT project, [x FOR x IN [CASE WHEN NOT configuration_valid THEN 'configuration_snapshot_invalid' END,
      CASE WHEN NOT destination_known THEN 'destination_run_missing' WHEN NOT destination_terminal THEN 'destination_run_nonterminal' WHEN destination_pages = 0 THEN 'destination_page_evidence_missing' WHEN evidence_expired THEN 'destination_page_evidence_expired' WHEN foreign_versions > 0 THEN 'destination_page_evidence_version_unsupported' END,
      CASE WHEN sources = 0 THEN 'source_inventory_missing' WHEN bad_sources > 0 THEN 'source_inventory_contains_invalid_rows' END, CASE WHEN bad_redirects > 0 THEN 'redirect_map_contains_invalid_or_conflicting_rows' END, CASE WHEN source_run_named AND NOT source_run_usable THEN 'source_comparison_evidence_missing' END,
      CASE WHEN links = 0 THEN 'internal_link_evidence_missing' END, CASE WHEN sitemaps = 0 THEN 'sitemap_evidence_missing' END, CASE WHEN compare_images AND images = 0 THEN 'image_evidence_missing' END, CASE WHEN structured_data = 0 THEN 'structured_data_evidence_missing' END] IF x IS NOT NULL] AS r FROM facts)
  SELECT project, CASE WHEN list_contains(r, 'configuration_snapshot_invalid') THEN 'invalid_configuration' WHEN list_has_any(r, ['source_inventory_missing', 'destination_run_missing', 'destination_run_nonterminal', 'destination_page_evidence_missing']) THEN 'missing_evidence'
    WHEN list_contains(r, 'destination_page_evidence_expired') THEN 'expired' WHEN list_contains(r, 'destination_page_evidence_version_unsupported') THEN 'incompatible' WHEN len(r) > 0 THEN 'ready_with_warnings' ELSE 'ready' END AS state, array_to_string(r, ',') AS reasons,
    CASE state WHEN 'invalid_configuration' THEN 'readiness_invalid_configuration' WHEN 'missing_evidence' THEN 'readiness_missing_evidence' WHEN 'expired' THEN 'readiness_expired_evidence' WHEN 'incompatible' THEN 'readiness_incompatible_evidence' END AS code FROM judged""")
def migration_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Whether each project's evidence suffices, and why not."""
    found = migration_inputs.readiness(_pages(spark, d, FACTS))
    return found.select("project", "state", F.array_join("reasons", ",").alias("reasons"), "code")


# -- pages

ROBOTS = ", CASE WHEN page_id % 8 = {} THEN 'noarchive' END AS meta_robots, CASE WHEN page_id % 26 = {} THEN 'noindex' END AS x_robots"


@query(f"""WITH {DUCK_MIGRATION}, {MAPPED}, o AS (SELECT *{ROBOTS.format(3, 5)} FROM old_pages), n AS (SELECT * FROM (SELECT DISTINCT ON (key) * FROM (SELECT *{ROBOTS.format(4, 5)}, unnest(list_distinct([x FOR x IN [url, final_url] IF x IS NOT NULL])) AS key FROM new_pages) ORDER BY key, page_id DESC)),
  own AS (SELECT m.source_url, m.destination_url, o.url IS NOT NULL AS a, n.key IS NOT NULL AS b, o.http_status = n.http_status AS same_status, o.canonical_url IS NOT DISTINCT FROM n.canonical_url AS same_canonical, o.indexable = n.indexable AS same_index, o.category = n.category AS same_category,
    o.meta_robots IS NOT DISTINCT FROM n.meta_robots AND o.x_robots IS NOT DISTINCT FROM n.x_robots AS same_robots, o.language <> n.language AS other_language,
    -- The titles and descriptions of the formulas: equal, one of them missing, or 'zqx', which has nothing in common with the old text.
    o.title AS ot, n.title AS nt, coalesce(o.description, '') AS os, coalesce(n.description, '') AS ns, o.description AS od, n.description AS nd, o.canonical_url AS oc, n.canonical_url AS nc
    FROM mapped m LEFT JOIN o ON o.url = m.source_url LEFT JOIN n ON n.key = m.destination_url WHERE m.destination_url IS NOT NULL),
  said AS (SELECT *, CASE WHEN nt IS NULL THEN 'missing' WHEN ot = nt THEN 'preserved' WHEN nt LIKE 'zqx%' THEN 'far' ELSE 'near' END AS t, CASE WHEN os <> '' AND ns = '' THEN 'missing' WHEN os = '' AND ns <> '' THEN 'added' WHEN od IS NOT DISTINCT FROM nd THEN 'preserved' WHEN ns = 'zqx' THEN 'far' ELSE 'near' END AS s,
    (coalesce(ot = nt, false)::INT + coalesce(od = nd, false)::INT + same_category::INT + coalesce(oc = nc, false)::INT + same_index::INT) AS hits, ((nt IS NOT NULL)::INT + (od IS NOT NULL AND nd IS NOT NULL)::INT + 1 + (oc IS NOT NULL AND nc IS NOT NULL)::INT + 1) AS known FROM own)
  SELECT source_url, destination_url, CASE WHEN NOT b THEN 'missing' WHEN NOT a THEN 'confirmed' WHEN same_status THEN 'preserved' ELSE 'changed' END AS status_state, CASE WHEN NOT a OR NOT b THEN 'not_available' WHEN t = 'preserved' AND s = 'preserved' THEN 'preserved' ELSE 'changed' END AS metadata_state,
    CASE WHEN NOT b THEN 'missing' WHEN NOT a THEN 'indeterminate' WHEN hits / known >= 0.65 THEN 'preserved' ELSE 'changed' END AS content_state, CASE WHEN NOT a OR NOT b THEN 'not_available' WHEN same_canonical THEN 'preserved' ELSE 'changed' END AS canonical_state,
    CASE WHEN NOT a OR NOT b THEN 'not_available' WHEN same_index THEN 'preserved' ELSE 'changed' END AS indexability_state, CASE WHEN a AND b THEN printf('%.6f', hits / known) END AS similarity,
    CASE WHEN NOT b THEN 'content_missing' WHEN NOT a THEN 'source_metadata_unavailable,content_similarity_indeterminate' ELSE array_to_string([x FOR x IN [CASE t WHEN 'missing' THEN 'title_missing_after_migration' WHEN 'far' THEN 'title_materially_changed' END, CASE s WHEN 'missing' THEN 'meta_description_missing_after_migration' WHEN 'far' THEN 'meta_description_materially_changed' END,
      CASE WHEN NOT same_canonical THEN 'canonical_target_changed' END, CASE WHEN NOT same_robots THEN 'robots_regression' END, CASE WHEN NOT same_index THEN 'indexability_regression' END, CASE WHEN NOT same_category THEN 'content_type_changed' END, CASE WHEN other_language THEN 'language_changed' END,
      CASE WHEN hits / known >= 0.65 THEN 'content_likely_preserved' ELSE 'content_materially_changed,content_similarity_low' END] IF x IS NOT NULL], ',') END AS codes FROM said""")
def migration_page_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """How each mapped page differs from the page that it replaces, with the content score."""
    own = _migration(spark, d)
    robots = lambda df, a, b: df.selectExpr("*", *ROBOTS.format(a, b)[2:].split(", ", 1))
    return migration_changes.page_comparisons(own["mapped"], robots(own["old_pages"], 3, 5), robots(own["new_pages"], 4, 5))


# -- links

LINKS = {
    "before": f"SELECT concat('{OLD}/p/', page_id) AS page_url, concat('{OLD}/p/', CAST(floor(page_id / 2) AS BIGINT)) AS target FROM PAGES UNION ALL SELECT concat('{OLD}/p/', page_id), concat('{OLD}/p/', page_id + 1) FROM PAGES WHERE page_id % 3 <> 1 UNION ALL SELECT concat('{OLD}/p/', page_id), '{OLD}/p/2' FROM PAGES",
    "after": f"SELECT concat('{NEW}/p/', page_id) AS page_url, concat('{NEW}/p/', CAST(floor(page_id / 2) AS BIGINT)) AS target FROM PAGES WHERE page_id % 5 <> 4 UNION ALL SELECT concat('{NEW}/p/', page_id), concat('{OLD}/p/', page_id + 1) FROM PAGES WHERE page_id % 3 = 2 UNION ALL SELECT concat('{NEW}/p/', page_id), '{NEW}/p/2' FROM PAGES UNION ALL SELECT concat('{NEW}/p/', page_id), NULL FROM PAGES WHERE page_id % 6 = 1 UNION ALL SELECT concat('{NEW}/p/', page_id), concat('https://none.example/p/', page_id - 1) FROM PAGES WHERE page_id % 7 = 3",
}
#: Some sources map nowhere: they are no page of the old origin.
EXTRA_MAPPED = "SELECT source_url, destination_url, state FROM {mapped} UNION ALL SELECT concat('https://none.example/p/', page_id) AS source_url, CAST(NULL AS STRING) AS destination_url, 'unmapped' AS state FROM PAGES WHERE page_id % 7 = 2"
DUCK_LINKS = f"{DUCK_MIGRATION}, {MAPPED}, before AS ({_duck(LINKS['before'])}), after AS ({_duck(LINKS['after'])}), every AS ({_duck(EXTRA_MAPPED).format(mapped='mapped')})"


def _links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    mapped = _migration(spark, d)["mapped"]
    every = spark.sql(EXTRA_MAPPED.replace("FROM PAGES", "FROM {pages}"), mapped=mapped, pages=spark.read.parquet(f"{d}/pages.parquet").select("page_id"))
    return every, _pages(spark, d, LINKS["before"]), _pages(spark, d, LINKS["after"])


@query(f"""WITH {DUCK_LINKS}
  SELECT 'source_link_target_unmapped' AS code, source_url, CAST(NULL AS VARCHAR) AS destination_url, count(*) AS occurrences, count(DISTINCT page_url) AS pages FROM after JOIN every ON target = source_url WHERE state = 'unmapped' GROUP BY source_url
  UNION ALL SELECT 'navigation_target_regression', target, any_value(destination_url), count(*), count(DISTINCT page_url) FROM before LEFT JOIN every ON target = source_url WHERE target NOT IN (SELECT target FROM after WHERE target IS NOT NULL) GROUP BY target
  UNION ALL SELECT 'destination_orphan_candidate', source_url, destination_url, 0, 0 FROM every WHERE destination_url IS NOT NULL AND destination_url NOT IN (SELECT target FROM after WHERE target IS NOT NULL)
  UNION ALL SELECT 'redirect_dependency_sitewide', NULL, NULL, count(*), count(DISTINCT page_url) FROM after WHERE target IN (SELECT source_url FROM every) HAVING count(*) > 0""")
def migration_link_changes(spark: SparkSession, d: str) -> DataFrame:
    """What the link graphs before and after the migration tell of each other."""
    return migration_changes.link_changes(*_links(spark, d))


@query(f"""WITH {DUCK_LINKS}, to_new AS (SELECT source_url, destination_url FROM every WHERE destination_url IS NOT NULL),
  was AS (SELECT coalesce(p.destination_url, page_url) AS page_url, coalesce(t.destination_url, target) AS target, count(*) AS n FROM before LEFT JOIN to_new p ON p.source_url = page_url LEFT JOIN to_new t ON t.source_url = target GROUP BY 1, 2),
  now AS (SELECT page_url, target, count(*) AS n FROM after WHERE target IS NOT NULL GROUP BY 1, 2)
  SELECT coalesce(was.page_url, now.page_url) AS page_url, coalesce(was.target, now.target) AS target, CASE WHEN now.n IS NULL THEN 'lost' WHEN was.n IS NULL THEN 'gained' ELSE 'kept' END AS change, coalesce(was.n, 0) AS old_links, coalesce(now.n, 0) AS new_links
  FROM was FULL JOIN now ON was.page_url = now.page_url AND was.target = now.target""")
def migration_edge_differences(spark: SparkSession, d: str) -> DataFrame:
    """Every link before and after, the old ones seen through the mapping."""
    return migration_changes.edge_differences(*_links(spark, d))


# -- structured data

#: Braces of JSON stand as « and » until the dialect is known.
BLOCKS = {
    "before": f"""SELECT concat('{OLD}/p/', page_id) AS page_url, concat('a', page_id) AS block_id, 'json_ld' AS format, CAST(NULL AS STRING) AS error, CASE WHEN page_id % 4 = 0 THEN array('Product', 'Thing') ELSE array('Article') END AS types, array(concat('#', page_id)) AS identifiers, concat('«"name": "n', page_id, '", "offers": «"price": ', page_id % 3, ', "list": [1, true]»»') AS json FROM PAGES WHERE page_id % 2 = 0""",
    "after": f"""SELECT concat('{NEW}/p/', page_id) AS page_url, concat('b', page_id) AS block_id, CASE WHEN page_id % 5 = 2 THEN 'rdfa' ELSE 'json_ld' END AS format, CASE WHEN page_id % 16 = 2 THEN 'invalid_json' END AS error, CASE WHEN page_id % 8 = 4 THEN array('Product') WHEN page_id % 4 = 0 THEN array('Thing', 'Product') ELSE array('Article') END AS types, CASE WHEN page_id % 10 = 8 THEN array('#new') ELSE array(concat('#', page_id)) END AS identifiers, CASE WHEN page_id % 12 = 10 THEN 'not json' ELSE concat('«"name": "n', page_id, CASE WHEN page_id % 14 = 4 THEN ' two' ELSE '' END, '", "offers": «"price": ', page_id % 3, '», "brand": null»') END AS json FROM PAGES WHERE page_id % 6 <> 0""",
}
def _duck_blocks(k: str) -> str:
    text = _duck(BLOCKS[k]).replace("array(", "list_value(").replace("«", "{").replace("»", "}")
    return f"SELECT *, CAST(regexp_extract(page_url, '[0-9]+$') AS BIGINT) AS i FROM ({text})"


def _blocks(spark: SparkSession, d: str, k: str) -> DataFrame:
    return _pages(spark, d, BLOCKS[k].replace("«", "{{").replace("»", "}}"))


DUCK_BLOCKS = f"{DUCK_MIGRATION}, {MAPPED}, olds AS ({_duck_blocks('before')}), news AS ({_duck_blocks('after')})"


@query(f"""WITH {DUCK_BLOCKS}, pairs AS (SELECT o.page_url AS source_url, m.destination_url, n.page_url IS NOT NULL AS here, list_sort(o.types) AS ot, list_sort(n.types) AS nt, o.identifiers[1] AS oi, n.identifiers[1] AS ni, n.format AS nf FROM olds o LEFT JOIN mapped m ON m.source_url = o.page_url LEFT JOIN news n ON n.page_url = m.destination_url)
  SELECT 'structured_data_removed' AS code, source_url, destination_url, CAST(NULL AS VARCHAR) AS block_id, CAST(NULL AS VARCHAR) AS detail FROM pairs WHERE NOT here
  UNION ALL SELECT 'structured_data_type_changed', source_url, destination_url, NULL, 'gone=' || array_to_string([x FOR x IN ot IF NOT list_contains(nt, x)], ',') || ' new=' || array_to_string([x FOR x IN nt IF NOT list_contains(ot, x)], ',') FROM pairs WHERE here AND ot <> nt
  UNION ALL SELECT 'structured_data_profile_regression', source_url, destination_url, NULL, 'gone=' || array_to_string([x FOR x IN ot IF NOT list_contains(nt, x)], ',') FROM pairs WHERE here AND ot <> nt
  UNION ALL SELECT 'structured_data_entity_id_changed', source_url, destination_url, NULL, 'gone=' || oi || ' new=' || ni FROM pairs WHERE here AND oi <> ni
  UNION ALL SELECT 'structured_data_identity_conflict', source_url, destination_url, NULL, 'shared=' || oi FROM pairs WHERE here AND oi = ni AND ot <> nt
  UNION ALL SELECT 'structured_data_format_changed', source_url, destination_url, NULL, 'gone=json_ld new=' || nf FROM pairs WHERE here AND nf <> 'json_ld'
  UNION ALL SELECT 'structured_data_invalid_after_migration', NULL, page_url, block_id, error FROM news WHERE error IS NOT NULL
  UNION ALL SELECT 'structured_data_nonindexable_destination', NULL, page_url, block_id, NULL FROM news WHERE page_url IN (SELECT url FROM new_pages WHERE NOT indexable UNION SELECT final_url FROM new_pages WHERE NOT indexable AND final_url IS NOT NULL)""")
def migration_structured_changes(spark: SparkSession, d: str) -> DataFrame:
    """How types, identifiers and formats of structured data changed page by page."""
    own = _migration(spark, d)
    return migration_changes.structured_changes(own["mapped"], _blocks(spark, d, "before"), _blocks(spark, d, "after"), own["new_pages"])


@query(f"""WITH {DUCK_BLOCKS}, told(side, page_url, entity, path, v) AS (
    SELECT 'o', page_url, identifiers[1], 'name', 'n' || i FROM olds UNION ALL SELECT 'o', page_url, identifiers[1], 'offers.price', CAST(i % 3 AS VARCHAR) FROM olds UNION ALL SELECT 'o', page_url, identifiers[1], 'offers.list[0]', '1' FROM olds UNION ALL SELECT 'o', page_url, identifiers[1], 'offers.list[1]', 'true' FROM olds
    UNION ALL SELECT 'n', page_url, identifiers[1], 'name', 'n' || i || CASE WHEN i % 14 = 4 THEN ' two' ELSE '' END FROM news WHERE json <> 'not json' UNION ALL SELECT 'n', page_url, identifiers[1], 'offers.price', CAST(i % 3 AS VARCHAR) FROM news WHERE json <> 'not json' UNION ALL SELECT 'n', page_url, identifiers[1], 'brand', 'null' FROM news WHERE json <> 'not json'),
  pairs AS (SELECT source_url, destination_url FROM mapped WHERE destination_url IS NOT NULL), a AS (SELECT p.*, entity, path, v FROM pairs p JOIN told t ON side = 'o' AND page_url = source_url), b AS (SELECT p.*, entity, path, v FROM pairs p JOIN told t ON side = 'n' AND page_url = destination_url)
  SELECT coalesce(a.source_url, b.source_url) AS source_url, coalesce(a.destination_url, b.destination_url) AS destination_url, coalesce(a.entity, b.entity) AS entity, coalesce(a.path, b.path) AS path, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS change, a.v AS old_value, b.v AS new_value
  FROM a FULL JOIN b ON a.source_url = b.source_url AND a.destination_url = b.destination_url AND a.entity = b.entity AND a.path = b.path WHERE a.v IS DISTINCT FROM b.v""")
def migration_entity_differences(spark: SparkSession, d: str) -> DataFrame:
    """Which properties of which entity were added, removed or changed."""
    entities = lambda k: _blocks(spark, d, k).select("page_url", F.element_at("identifiers", 1).alias("entity"), "json")
    return migration_changes.entity_differences(_migration(spark, d)["mapped"], entities("before"), entities("after"))
