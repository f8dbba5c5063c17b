"""Sitemap indexes followed from their roots under budgets, for any number of sites at once.

A site's documents are read in the order of a queue: roots first, then the children of each index in the order in which the
indexes were read. That is level by level, so a level is one join. Inside a level running totals in queue order decide what is
still read: documents, bytes, and addresses found so far. The first document at which a budget is used up ends its site.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.operators.sitemap_members import Sitemaps
from auditlake.shared import shared_dir, written

#: Budgets of a site where its roots name none. Fixed values.
LIMITS = {"max_documents": 100, "max_depth": 3, "max_bytes": 50_000_000, "max_urls": 250_000}
#: A child's place is its index's number times this, plus its place in the index.
PLACES = 1 << 20


@dataclass
class Tree:
    """documents: site, number (reading order from 1), url, parent, depth, state (fetched, failed, skipped), alias.
    findings: site, code, document (null: none), subject. sites: site, state, partial, documents, urls, bytes."""

    documents: DataFrame
    findings: DataFrame
    sites: DataFrame


class _Grown:
    """A table that each level adds to: plans read it as one, however many levels there are."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.schema = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", None

    def add(self, rows: DataFrame) -> None:
        self.schema = self.schema or rows.schema
        rows.write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def _level(queue: DataFrame, state: DataFrame, seen: DataFrame | None, facts: DataFrame, depth: int) -> DataFrame:
    """The documents of one level up to the one that ends their site, with the running totals that decide it.

    before: why a document isn't read any more. after: why the site ends with it.
    """
    rows = queue.join(state.where("NOT stopped"), "site").where(F.lit(depth) <= F.col("max_depth"))
    if seen is not None:
        rows = rows.join(seen.select("site", "url"), ["site", "url"], "left_anti")
    rows = rows.groupBy("site", "url", *LIMITS, "read", "bytes", "urls").agg(F.min_by("parent", "place").alias("parent"), F.min("place").alias("place"))
    # No more than the document limit and the one that meets it.
    first = F.row_number().over(Window.partitionBy("site").orderBy("place"))
    rows = rows.withColumn("rank", first).where(F.col("rank") <= F.greatest(F.col("max_documents") - F.col("read"), F.lit(0)) + 1)
    rows = rows.join(facts, ["site", "url"], "left").fillna(False, ["fetched", "parsed", "is_index"]).fillna(0, ["size", "entries"])
    if seen is None:
        rows = rows.withColumn("known", F.lit(None).cast("boolean"))
    else:
        finals = seen.where("NOT alias AND final_url IS NOT NULL").select("site", "final_url").distinct().withColumn("known", F.lit(True))
        rows = rows.join(finals, ["site", "final_url"], "left")
    upto = Window.partitionBy("site").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    again = F.row_number().over(Window.partitionBy("site", "final_url").orderBy("rank")) > 1
    rows = rows.withColumn("used", F.col("bytes") + F.sum("size").over(upto))
    rows = rows.withColumn("alias", F.col("final_url").isNotNull() & (F.coalesce("known", F.lit(False)) | again))
    rows = rows.withColumn("good", ~F.col("alias") & F.col("fetched") & (F.col("used") <= F.col("max_bytes")))
    rows = rows.withColumn("known_urls", F.col("urls") + F.sum(F.when(F.col("good"), F.col("entries")).otherwise(0)).over(upto))
    before = F.when(F.col("rank") > F.col("max_documents") - F.col("read"), "sitemap_document_limit_exceeded").when(F.col("used") - F.col("size") >= F.col("max_bytes"), "response_too_large")
    after = F.when(~F.col("alias") & (F.col("used") >= F.col("max_bytes")), "response_too_large").when(F.col("good") & (F.col("known_urls") > F.col("max_urls")), "total_url_limit_exceeded")
    rows = rows.withColumn("before", before).withColumn("after", F.when(F.col("before").isNull(), after))
    stop = F.min(F.when(F.coalesce("before", "after").isNotNull(), F.col("rank"))).over(Window.partitionBy("site"))
    rows = rows.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col("rank") <= F.col("stop")))
    return rows.select("site", "url", "parent", (F.col("read") + F.col("rank")).alias("number"), F.lit(depth).alias("depth"), "final_url", "alias", "good", "parsed", "is_index", "size", "entries", "before", "after")


def expand(found: Sitemaps, roots: DataFrame) -> Tree:
    """What the budgets let be read from the roots.

    found: sitemaps() over the documents at hand; a document that isn't there is a failed fetch. roots: site, url, place (a
    root's place in the queue, once a site), max_documents, max_depth, max_bytes, max_urls (null or absent: LIMITS).
    The rules, in queue order: an address that was read is passed over; beyond max_documents, and with no bytes left, the site
    ends; below max_depth a child is reported and not read; a document longer than the bytes left fails; one that redirects to a
    document already read is skipped; a document that uses the bytes up, or takes the valid addresses above max_urls, ends the
    site and its children aren't queued; a child that was read by then is a loop. A site's candidates of a level, which the limits
    bound, are sorted in one task; sites are many.
    """
    spark = roots.sparkSession
    given = [F.coalesce(F.col(c) if c in roots.columns else F.lit(None), F.lit(v)).cast("long").alias(c) for c, v in LIMITS.items()]
    start = written(roots.select("site", "url", F.col("place").cast("long").alias("place"), *given), "roots")
    limits = start.groupBy("site").agg(*(F.max(c).alias(c) for c in LIMITS))
    facts = found.documents.select("site", "url", "final_url", "fetched", F.col("bytes").alias("size"), "entries", F.col("parse_state").isin("parsed", "parsed_with_warnings").alias("parsed"), (F.col("root") == "sitemapindex").alias("is_index"))
    kids = found.members.where("child AND valid AND NOT duplicate").select("site", F.col("url").alias("parent"), F.col("normalized").alias("url"), "sequence")
    levels, children = _Grown(spark, "levels"), _Grown(spark, "children")
    read, spent = F.col("before").isNull(), F.coalesce(F.col("after") == "response_too_large", F.lit(False))

    def state() -> DataFrame:
        """Per site: its limits, and documents, bytes and addresses so far."""
        if levels.schema is None:
            return limits.withColumns({"read": F.lit(0).cast("long"), "bytes": F.lit(0).cast("long"), "urls": F.lit(0).cast("long"), "stopped": F.lit(False)})
        sums = levels.rows().groupBy("site").agg(
            F.count_if(read).alias("read"), F.sum(F.when(read, F.col("size")).otherwise(0)).alias("bytes"), F.sum(F.when(read & F.col("good") & ~spent, F.col("entries")).otherwise(0)).alias("urls"),
            F.max(F.coalesce("before", "after").isNotNull()).alias("stopped"),
        )
        return limits.join(sums, "site", "left").fillna(0, ["read", "bytes", "urls"]).fillna(False, ["stopped"])

    queue = start.select("site", "url", F.lit(None).cast("string").alias("parent"), "place")
    for depth in count():
        seen = None if levels.schema is None else levels.rows().where(read)
        levels.add(_level(queue, state(), seen, facts, depth))
        now = levels.rows().where(read)
        indexes = now.where((F.col("depth") == depth) & F.col("good") & F.col("is_index") & F.col("after").isNull()).select("site", F.col("url").alias("parent"), F.col("number").alias("at"))
        named = indexes.join(kids, ["site", "parent"]).join(now.select("site", "url", F.col("number").alias("was")), ["site", "url"], "left")
        children.add(named.select("site", "parent", "url", F.coalesce(F.col("was") <= F.col("at"), F.lit(False)).alias("loop"), (F.col("at") * PLACES + F.col("sequence")).alias("place"), F.lit(depth + 1).alias("depth")))
        queue = children.rows().where((F.col("depth") == depth + 1) & ~F.col("loop")).select("site", "url", "parent", "place")
        if queue.isEmpty():
            break
    return _told(found, levels.rows(), children.rows(), written(state(), "sites"))


def _told(found: Sitemaps, levels: DataFrame, children: DataFrame, state: DataFrame) -> Tree:
    """The tree's tables, once all levels are there."""
    done = levels.where("before IS NULL")
    code = lambda when, name, document, subject: F.when(when, F.struct(F.lit(name).alias("code") if isinstance(name, str) else name.alias("code"), F.col(document).alias("document"), F.col(subject).alias("subject")))
    failed = F.when(F.col("parent").isNull(), "fetch_failed").otherwise("child_fetch_failed")
    read = F.col("before").isNull()
    hits = F.array_compact(F.array(
        code(~read, F.col("before"), "parent", "url"), code(read & F.col("alias"), "redirect_alias_duplicate", "url", "final_url"), code(read & ~F.col("alias") & ~F.col("good"), failed, "url", "url"), code(F.col("after").isNotNull(), F.col("after"), "url", "url"),
    ))
    from_levels = levels.select("site", F.explode(hits).alias("h")).select("site", "h.*")
    loops = children.where("loop").select("site", F.lit("sitemap_index_loop").alias("code"), F.col("parent").alias("document"), F.col("url").alias("subject"))
    # What a site that didn't end was left with below its depth: one report of the document limit, or else one for each child.
    deep = children.where("NOT loop").join(state.where("NOT stopped").select("site", "max_depth", "max_documents", "read"), "site").where("depth > max_depth").join(done.select("site", "url"), ["site", "url"], "left_anti")
    each = deep.where("read < max_documents").select("site", F.lit("maximum_depth_exceeded").alias("code"), F.col("parent").alias("document"), F.col("url").alias("subject"))
    once = deep.where("read >= max_documents").groupBy("site").agg(F.min_by(F.struct(F.col("parent").alias("document"), F.col("url").alias("subject")), "place").alias("f")).select("site", F.lit("sitemap_document_limit_exceeded").alias("code"), "f.*")
    findings = written(from_levels.unionByName(loops).unionByName(each).unionByName(once), "tree-findings")
    documents = done.select("site", "number", "url", "parent", "depth", F.when(F.col("alias"), "skipped").when(F.col("good"), "fetched").otherwise("failed").alias("state"), "alias")
    partial = findings.groupBy("site").agg(F.max(~F.col("code").isin("fetch_failed", "sitemap_index_loop")).alias("partial"), F.lit(True).alias("warned"))
    told = found.findings.select("site", "url").distinct().join(documents.where("state = 'fetched'").select("site", "url"), ["site", "url"]).select("site").distinct().withColumn("told", F.lit(True))
    root = (F.col("depth") == 0) & F.col("good") & F.col("parsed") & ~F.coalesce(F.col("after") == "response_too_large", F.lit(False))
    rooted = done.groupBy("site").agg(F.max(root).alias("rooted"))
    sites = state.join(partial, "site", "left").join(told, "site", "left").join(rooted, "site", "left").fillna(False, ["partial", "warned", "told", "rooted"])
    outcome = F.when(~F.col("rooted"), "failed").when(F.col("partial"), "partially_completed").when(F.col("warned") | F.col("told"), "completed_with_warnings").otherwise("completed")
    return Tree(documents, findings, sites.select("site", outcome.alias("state"), "partial", F.col("read").alias("documents"), "urls", "bytes"))
