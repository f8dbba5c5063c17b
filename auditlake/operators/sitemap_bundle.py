"""New sitemaps as XML, split by entries and bytes, with an index."""

from __future__ import annotations

from dataclasses import dataclass
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.urls import normalize_url
from auditlake.operators.ordering import indexed
from auditlake.operators.segments import segmented
from auditlake.operators.sitemap import NAMESPACE
from auditlake.shared import written

#: Limits of the protocol. Fixed values.
MAX_ENTRIES, MAX_BYTES, MAX_CHARACTERS = 50_000, 52_428_800, 2_048
#: The text around entries. Fixed values.
OPENING = f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="{NAMESPACE}">\n'
CLOSING = "</urlset>\n"
INDEX_OPENING = f'<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="{NAMESPACE}">\n'
INDEX_CLOSING = "</sitemapindex>\n"
#: What XML 1.0 doesn't allow.
ILLEGAL = r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"
DOCUMENT = "number long, name string, entries long, bytes long, split_reason string, first_url string, xml string"


@dataclass
class Bundle:
    """documents: number (from 1), name, entries, bytes, split_reason (why it was begun; null for the first), first_url, xml.
    rejections: sequence, url, reason. index: name, entries, bytes, xml, warning: one row if there are several documents."""

    documents: DataFrame
    rejections: DataFrame
    index: DataFrame


def escaped(url: Column) -> Column:
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        url = F.replace(url, F.lit(plain), F.lit(name))
    return url


def entry_xml(url: Column) -> Column:
    return F.concat(F.lit("  <url>\n    <loc>"), escaped(url), F.lit("</loc>\n  </url>\n"))


def bundle(
    urls: DataFrame, base_url: str | None = None, most_entries: int = MAX_ENTRIES, most_bytes: int = MAX_BYTES, most_characters: int = MAX_CHARACTERS, most_indexed: int = MAX_ENTRIES, most_index_bytes: int = MAX_BYTES,
    prefix: str = "sitemap", single: str = "sitemap.xml", index_name: str = "sitemap-index.xml", range_rows: int = 1 << 17,
) -> Bundle:
    """Sitemap documents of urls (url, sequence: its order).

    A URL is written where it first stands; rejected are such as aren't the normalised address, are too long, hold characters that
    XML doesn't know, or don't fit into a document alone. A document takes entries in order while it has room for them. Without
    any entry there is one empty document. Tasks see a range of entries, or one document, whose size the limits bound.
    """
    u = F.col("u.error_code")
    reason = (
        F.when(F.coalesce("url", F.lit("")) == "", "invalid_url").when(F.col("url").rlike(ILLEGAL), "xml_illegal_character").when(F.length("url") > most_characters, "url_too_long")
        .when(u == "unsupported_scheme", "unsupported_scheme").when(u == "missing_hostname", "missing_host").when(u.isNotNull() | (F.col("u.normalized") != F.col("url")), "invalid_url")
    )
    own = written(urls.select("sequence", "url").withColumn("u", normalize_url("url")).select("sequence", "url", reason.alias("reason"), F.octet_length(entry_xml(F.col("url"))).cast("long").alias("bytes")), "entries")
    empty = len(OPENING + CLOSING)
    first = own.where("reason IS NULL").groupBy("url").agg(F.min("sequence").alias("sequence"), F.first("bytes").alias("bytes"))
    fits = F.col("bytes") + empty <= most_bytes
    alone = first.where(~fits).select("sequence", "url", F.lit("entry_exceeds_document_byte_limit").alias("reason"))
    rejections = own.where("reason IS NOT NULL").select("sequence", "url", "reason").unionByName(alone)
    placed = written(indexed(written(first.where(fits), "fitting"), ["sequence", "url"]), "placed")
    cut = segmented(placed, most_entries, most_bytes - empty, range_rows)

    def render(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("index")
        body = "".join(f"  <url>\n    <loc>{escape(x, {chr(34): '&quot;', chr(39): '&apos;'})}</loc>\n  </url>\n" for x in rows["url"])
        text = OPENING + body + CLOSING
        return pd.DataFrame({"number": [int(rows["segment"].iloc[0]) + 1], "name": [""], "entries": [len(rows)], "bytes": [len(text.encode())], "split_reason": [None], "first_url": [rows["url"].iloc[0]], "xml": [text]})

    made = written(cut.groupBy("segment").applyInPandas(render, DOCUMENT), "documents")
    spark, n = urls.sparkSession, made.count()
    if not n:
        made = spark.createDataFrame([(1, single, 0, empty, None, None, OPENING + CLOSING)], DOCUMENT)
    else:
        # A document was begun as the one before had no room: for another entry, or else for its bytes.
        full = made.select((F.col("number") + 1).alias("number"), F.when(F.col("entries") == most_entries, "entry_limit").otherwise("byte_limit").alias("why"))
        name = F.concat(F.lit(f"{prefix}-"), F.col("number").cast("string"), F.lit(".xml")) if n > 1 else F.lit(single)
        made = made.join(full, "number", "left").select("number", name.alias("name"), "entries", "bytes", F.col("why").alias("split_reason"), "first_url", "xml")
    return Bundle(made, rejections, _index(made, n, base_url, most_indexed, most_index_bytes, index_name))


def _index(documents: DataFrame, n: int, base_url: str | None, most: int, most_bytes: int, name: str) -> DataFrame:
    """The index of several documents; warning: why there is none. At most `most` names come together."""
    spark, schema = documents.sparkSession, "name string, entries long, bytes long, xml string, warning string"
    if n <= 1:
        return spark.createDataFrame([], schema)
    warning = "index_blocked_missing_base_url" if base_url is None else "index_blocked_entry_limit" if n > most else None
    if warning:
        return spark.createDataFrame([(name, None, None, None, warning)], schema)
    lines = F.array_sort(F.collect_list(F.struct("number", F.concat(F.lit("  <sitemap>\n    <loc>"), escaped(F.concat(F.lit(base_url), F.col("name"))), F.lit("</loc>\n  </sitemap>\n")).alias("line"))))
    text = F.concat(F.lit(INDEX_OPENING), F.array_join(F.transform(lines, lambda x: x["line"]), ""), F.lit(INDEX_CLOSING))
    made = documents.agg(F.count(F.lit(1)).alias("entries"), text.alias("xml")).withColumn("bytes", F.octet_length("xml").cast("long"))
    fits = F.col("bytes") <= most_bytes
    return made.select(F.lit(name).alias("name"), F.when(fits, F.col("entries")).alias("entries"), F.when(fits, F.col("bytes")).alias("bytes"), F.when(fits, F.col("xml")).alias("xml"), F.when(~fits, "index_blocked_byte_limit").alias("warning"))
