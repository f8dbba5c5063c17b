"""Crawl replay: which pages can be parsed, which links a crawl admits level by level, and its counters.

The input is already fetched; a replay answers which of the pages a crawl with given limits would have reached.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from auditlake.operators.graph import _write

#: Why a response isn't parsed, in order; media: the media type in lower case. Fixed values.
PREFLIGHT_SQL = """CASE WHEN fetch_failed THEN 'fetch_failed' WHEN body_truncated THEN 'response_truncated' WHEN body IS NULL THEN 'missing_body' WHEN status IS NULL OR status NOT BETWEEN 200 AND 299 THEN 'http_error_response'
 WHEN octet_length(body) = 0 THEN 'empty_body' WHEN media IN ('text/html', 'application/xhtml+xml') THEN NULL
 WHEN media IN ('', 'application/octet-stream') AND lower(decode(substring(body, 1, 1024), 'ISO-8859-1')) RLIKE '<(!doctype html|html|head|body|title)' THEN NULL ELSE 'non_html_content' END"""
#: Byte order marks and their encodings. Fixed values.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
META_CHARSET = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_:-]+)", re.IGNORECASE)


def preflight(responses: DataFrame) -> DataFrame:
    """responses (body binary, status, content_type, fetch_failed, body_truncated) with skip_reason, null where a page is parsed."""
    media = F.lower(F.trim(F.split_part(F.coalesce("content_type", F.lit("")), F.lit(";"), F.lit(1))))
    return responses.withColumn("media", media).withColumn("skip_reason", F.expr(PREFLIGHT_SQL)).drop("media")


def decode_body(body: bytes | None, content_type: str | None) -> tuple[str | None, str | None]:
    """Text and encoding of a body: by header, mark, meta element, else Windows-1252; undecodable bytes are replaced."""
    if body is None:
        return None, None
    named = re.search(r"charset\s*=\s*[\"']?([\w:.-]+)", content_type or "", re.IGNORECASE)
    mark = next(((m, e) for m, e in MARKS if body.startswith(m)), None)
    meta = META_CHARSET.search(body[:4096])
    for name in (named and named[1], mark and mark[1], meta and meta[1].decode("ascii", "replace")):
        if name:
            try:
                return body[len(mark[0]) if mark else 0 :].decode(name), name.lower()
            except LookupError:
                continue
            except UnicodeDecodeError:
                return body.decode(name, "replace"), name.lower()
    return body.decode("cp1252", "replace"), "cp1252"


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("charset", T.StringType())]))
def decoded(body: pd.Series, content_type: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_body(b, c) for b, c in zip(body, content_type, strict=True)], columns=["text", "charset"])


@dataclass(frozen=True)
class Limits:
    max_urls: int = 5_000
    max_depth: int = 10
    allow_queries: bool = True


#: Named limits. Fixed values.
PROFILES = {"standard": Limits(5_000, 10), "deep": Limits(25_000, 25), "absolute": Limits(50_000, 50)}

#: Why a link isn't admitted, in order, before what the frontier says. Fixed values.
ADMISSION_SQL = """CASE WHEN link_type = 'invalid' AND href = '' THEN 'empty_href' WHEN link_type IN ('javascript', 'mailto', 'tel', 'data', 'unsupported') THEN 'unsupported_scheme' WHEN link_type = 'fragment' THEN 'fragment_only'
 WHEN resolved IS NULL THEN 'invalid_url' WHEN resolved = source_url THEN 'same_document' WHEN depth > {max_depth} THEN 'depth_exceeded' WHEN NOT in_scope THEN 'scope_denied' WHEN {no_queries} AND resolved LIKE '%?%' THEN 'query_url_disallowed' END"""


def replay(seeds: DataFrame, links: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(admitted: url, depth, place; decisions: source_url, link_sequence, resolved, depth, reason) of a crawl over links.

    seeds: url. links: source_url, link_sequence, href, resolved, link_type, in_scope. A level is a join of its pages
    with their links; a URL enters at its least depth and there in the order of its source and link. The limit of URLs
    counts in that order, seeds among them by URL. Only the running number of a level's new URLs is global, and it is bounded by the limit.
    """
    test = F.expr(ADMISSION_SQL.format(max_depth=limits.max_depth, no_queries="false" if limits.allow_queries else "true"))
    first = seeds.select("url").distinct().orderBy("url").limit(limits.max_urls)
    level = _write(first.select("url", F.lit(0).alias("depth"), (F.row_number().over(Window.orderBy("url")) - 1).cast("long").alias("place")))
    admitted, decided, held = level, None, level.count()
    for depth in range(1, limits.max_depth + 2):
        near = level.select(F.col("url").alias("source_url"), F.col("place").alias("source_place")).join(links, "source_url").withColumn("depth", F.lit(depth)).withColumn("reason", test)
        order = Window.partitionBy("resolved").orderBy("source_place", "link_sequence")
        near = near.join(admitted.select(F.col("url").alias("resolved"), F.lit(True).alias("known")), "resolved", "left")
        near = near.withColumn("reason", F.coalesce("reason", F.when(F.col("known"), "duplicate_url"))).withColumn("nth", F.when(F.col("reason").isNull(), F.row_number().over(order)))
        near = _write(near.withColumn("reason", F.when(F.col("nth") > 1, "duplicate_url").otherwise(F.col("reason"))).drop("nth", "known"))
        room = max(0, limits.max_urls - held)
        fresh = near.where("reason is null").orderBy("source_place", "link_sequence").limit(room)
        level = _write(fresh.select(F.col("resolved").alias("url"), "depth", (F.row_number().over(Window.orderBy("source_place", "link_sequence")) - 1 + held).cast("long").alias("place")))
        taken = level.select(F.col("url").alias("resolved"), F.lit(True).alias("in_"))
        out = near.join(taken, "resolved", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("in_"), "admitted").otherwise("url_limit_reached")))
        out = out.select("source_url", "link_sequence", "resolved", "depth", "reason")
        decided = out if decided is None else decided.unionByName(out)
        new = level.count()
        held += new
        admitted = admitted.unionByName(level)
        if not new:
            break
    return admitted, decided


def counters(decided: DataFrame) -> DataFrame:
    """reason, links."""
    return decided.groupBy("reason").agg(F.count(F.lit(1)).alias("links"))
