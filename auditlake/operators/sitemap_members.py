"""Existing sitemaps read member by member, and what is wrong with each.

A document is judged before it is parsed by column expressions. What is left goes through an incremental XML reader that
yields a row for each member; addresses, scope, duplicates and findings are columns, joins and windows over these rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.functions.urls import normalize_url, scope_reason
from auditlake.operators.sitemap import NAMESPACE
from auditlake.shared import written

#: Finding codes and their severity in a document. Fixed values. Nothing emits http_error: an answer outside 200-299 is a failed fetch.
SEVERITIES = {
    "invalid_xml": "error",
    "doctype_forbidden": "error",
    "entity_declaration_forbidden": "error",
    "invalid_namespace": "warning",
    "unsupported_root_element": "error",
    "missing_location": "error",
    "empty_location": "error",
    "invalid_location": "error",
    "unsupported_scheme": "error",
    "out_of_scope_location": "warning",
    "duplicate_location": "information",
    "unexpected_content_type": "warning",
    "response_too_large": "error",
    "url_count_limit_exceeded": "error",
    "child_count_limit_exceeded": "error",
    "total_url_limit_exceeded": "warning",
    "sitemap_document_limit_exceeded": "warning",
    "maximum_depth_exceeded": "warning",
    "child_fetch_failed": "warning",
    "sitemap_index_loop": "warning",
    "empty_url_set": "warning",
    "empty_sitemap_index": "warning",
    "gzip_not_supported": "error",
    "fetch_failed": "warning",
    "http_error": "warning",
    "redirect_alias_duplicate": "warning",
    "robots_sitemap_invalid": "warning",
}
#: Content types of XML. Fixed values.
XML_TYPES = ("application/xml", "text/xml", "application/sitemap+xml", "application/rss+xml")
GZIP_TYPES = ("application/gzip", "application/x-gzip")
MAX_RESPONSE_BYTES, MAX_MEMBERS, MAX_RAW = 5_000_000, 50_000, 4096
#: Root element (lower case) and the element of its members. Fixed values.
MEMBER_OF = {"urlset": "url", "sitemapindex": "sitemap"}

READ = "document long, error string, root string, namespace string, members long, sequence long, has_location boolean, raw string"


@dataclass
class Sitemaps:
    """documents: the given columns but body, with root, namespace, members, parse_state, entries and children (valid, first seen).
    members: site, url, sequence, raw, normalized, code, in_scope, valid, duplicate, child.
    findings: site, url, number (from 1 in a document), code, severity, sequence, detail."""

    documents: DataFrame
    members: DataFrame
    findings: DataFrame


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def read_members(raw: bytes, most: int) -> tuple[str, str | None, int, list[tuple[bool, str | None]]]:
    """root, namespace, number of members, and of the first `most` whether there is a location and its text.

    Raises ParseError for XML that isn't well-formed, and KeyError for a root that isn't a sitemap's. A member is dropped as
    soon as it is read, so a document's tree is never whole in memory.
    """
    path: list[ElementTree.Element] = []
    root, wanted, count, found = "", "", 0, []
    for event, e in ElementTree.iterparse(io.BytesIO(raw), ("start", "end")):
        if event == "start":
            path.append(e)
            if len(path) == 1:
                root, wanted = local(e.tag), MEMBER_OF.get(local(e.tag), "")
            continue
        path.pop()
        if len(path) == 1:
            if local(e.tag) == wanted:
                count += 1
                if count <= most:
                    place = next((x for x in e if local(x.tag) == "loc"), None)
                    found.append((place is not None, place.text if place is not None else None))
            path[0].clear()
        elif not path:
            name, _, own = e.tag[1:].partition("}") if e.tag.startswith("{") else ("", "", e.tag)
            namespace = name or None
    if not wanted:
        raise KeyError(root)
    return root, namespace, count, found


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def blocked(most_bytes: int) -> Column:
    """The code of a document that isn't parsed, else null. Columns: address, content_type, body."""
    body, media = F.col("body").cast("string"), media_type(F.col("content_type"))
    packed = F.lower(F.split_part("address", F.lit("?"), F.lit(1))).endswith(".gz") | media.isin(*GZIP_TYPES) | (F.substring(F.hex(F.substring(F.col("body").cast("binary"), 1, 2)), 1, 4) == "1F8B")
    html = F.lower(F.ltrim(F.substring(body, 1, 512))).rlike("^\\s*(<!doctype html|<html|<head|<body)")
    return (
        F.when(packed, "gzip_not_supported")
        .when(F.octet_length("body") > most_bytes, "response_too_large")
        .when(body.rlike("(?i)<!\\s*DOCTYPE"), "doctype_forbidden")
        .when(body.rlike("(?i)<!\\s*ENTITY"), "entity_declaration_forbidden")
        .when((media == "text/html") & html, "unexpected_content_type")
    )


def read(documents: DataFrame, most_entries: int, most_children: int) -> DataFrame:
    """READ: a row for each document (sequence null) and one for each of its first members. documents: document, body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a document's rows are a batch of their own
                number, body = b.column(0)[i].as_py(), b.column(1)[i].as_py() or b""
                error, root, namespace, count, found = None, None, None, None, []
                try:
                    root, namespace, count, found = read_members(body, max(most_entries, most_children))
                    found = found[: most_entries if root == "urlset" else most_children]
                except KeyError:
                    error = "unsupported_root_element"
                except (ElementTree.ParseError, ValueError, LookupError):
                    error = "invalid_xml"
                rows = len(found) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * rows, pa.int64()), pa.array([error] * rows, pa.string()), pa.array([root] * rows, pa.string()), pa.array([namespace] * rows, pa.string()), pa.array([count] * rows, pa.int64()),
                     pa.array([None, *range(len(found))], pa.int64()), pa.array([None, *(f[0] for f in found)], pa.bool_()), pa.array([None, *(f[1] for f in found)], pa.string())],
                    names=["document", "error", "root", "namespace", "members", "sequence", "has_location", "raw"],
                )

    return documents.select("document", F.col("body").cast("binary").alias("body")).mapInArrow(run, READ)


def sitemaps(documents: DataFrame, most_bytes: int = MAX_RESPONSE_BYTES, most_entries: int = MAX_MEMBERS, most_children: int = MAX_MEMBERS, mode: str = "exact_host") -> Sitemaps:
    """The documents of any number of sites, their members and findings.

    documents: site, url (once in a site), seed (the site's address, which sets the scope), final_url, status, content_type, body
    (string or binary). A document without a status of 200-299 or without a body is not read: parse_state not_applicable, and
    what it means is the tree's to say. Bodies are read once; members beyond the limits are counted, not returned. A location is
    a duplicate if an earlier valid member of its document has the same normalised address. Empty tables give empty ones.
    """
    own = written(documents.withColumns({"document": F.monotonically_increasing_id(), "address": F.coalesce("final_url", "url")}), "sitemap-documents")
    fetched = F.col("status").between(200, 299) & F.col("body").isNotNull()
    facts = own.withColumns({"fetched": F.coalesce(fetched, F.lit(False)), "bytes": F.coalesce(F.octet_length("body").cast("long"), F.lit(0).cast("long"))})
    facts = facts.withColumn("blocked", F.when(F.col("fetched"), blocked(most_bytes)))
    rows = written(read(facts.where("fetched AND blocked IS NULL"), most_entries, most_children), "sitemap-rows")
    whole = rows.where("sequence IS NULL").select("document", F.col("error"), "root", "namespace", "members")
    facts = written(facts.drop("body").join(whole, "document", "left").withColumn("code", F.coalesce("blocked", "error")), "sitemap-facts")

    seeds = facts.select("site", "document", "url", "root", normalize_url("seed").alias("seed"))
    named = rows.where("sequence IS NOT NULL").select("document", "sequence", "has_location", "raw", F.trim(F.regexp_replace("raw", "^\\s+|\\s+$", "")).alias("cleaned"))
    named = named.withColumn("u", normalize_url("cleaned")).join(seeds, "document")
    wrong = (
        F.when(~F.col("has_location"), "missing_location")
        .when(F.col("cleaned").isNull() | (F.col("cleaned") == ""), "empty_location")
        .when(F.col("u.error_code") == "unsupported_scheme", "unsupported_scheme")
        .when(F.col("u.error_code").isNotNull(), "invalid_location")
        .when(~scope_reason(F.col("u"), F.col("seed"), mode).startswith("allowed"), "out_of_scope_location")
    )
    named = named.withColumn("wrong", wrong)
    same = Window.partitionBy("document", "normalized", F.col("wrong").isNull())
    named = named.withColumn("normalized", F.when(F.coalesce("wrong", F.lit("")).isin("", "out_of_scope_location"), F.col("u.normalized"))).withColumn("first", F.when(F.col("wrong").isNull(), F.min("sequence").over(same)))
    raw = F.when(F.col("wrong").isin("missing_location", "empty_location"), F.col("raw")).otherwise(F.substring("cleaned", 1, MAX_RAW))
    members = written(named.select(
        "site", "url", "document", "sequence", raw.alias("raw"), "normalized", F.coalesce("wrong", F.when(F.col("sequence") > F.col("first"), "duplicate_location")).alias("code"),
        F.when(F.col("wrong").isNull(), True).when(F.col("wrong") == "out_of_scope_location", False).alias("in_scope"), F.col("wrong").isNull().alias("valid"),
        F.coalesce(F.col("sequence") > F.col("first"), F.lit(False)).alias("duplicate"), (F.col("root") == "sitemapindex").alias("child"), "first",
    ), "sitemap-members")

    kept = members.where("valid AND NOT duplicate").groupBy("document").agg(F.count_if(~F.col("child")).alias("entries"), F.count_if("child").alias("children"))
    media, limit = media_type(F.col("content_type")), F.when(F.col("root") == "urlset", most_entries).otherwise(most_children)
    odd_type = (F.coalesce(media, F.lit("")) != "") & ~media.isin(*XML_TYPES) & ~media.endswith("+xml")
    fine, none = F.col("code").isNull(), F.lit(None).cast("string")

    def said_if(phase: int, when: Column, code: Column | str, severity: str, detail: Column = none) -> Column:
        return F.when(when, F.struct(F.lit(phase).alias("phase"), (F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(severity).alias("severity"), detail.alias("detail")))

    said = F.array_compact(F.array(
        said_if(0, ~fine, F.col("code"), "error"),
        said_if(1, fine & odd_type, "unexpected_content_type", "warning", F.concat(F.lit("content_type="), F.substring(media, 1, 128))),
        said_if(2, fine & ~F.col("namespace").eqNullSafe(NAMESPACE), "invalid_namespace", "warning", F.concat(F.lit("namespace="), F.coalesce("namespace", F.lit("missing")))),
        said_if(3, fine & (F.col("members") > limit), F.when(F.col("root") == "urlset", "url_count_limit_exceeded").otherwise("child_count_limit_exceeded"), "error", F.concat(F.lit("observed="), F.col("members").cast("string"), F.lit(" limit="), limit.cast("string"))),
        said_if(5, fine & (F.col("members") == 0), F.when(F.col("root") == "urlset", "empty_url_set").otherwise("empty_sitemap_index"), "warning"),
    ))
    of_document = facts.where("fetched").select("site", "url", "document", F.explode(said).alias("f")).select("site", "url", "document", F.col("f.phase").alias("phase"), F.lit(None).cast("long").alias("sequence"), F.col("f.code").alias("code"), F.col("f.severity").alias("severity"), F.col("f.detail").alias("detail"))
    severity = F.element_at(F.create_map(*(F.lit(x) for pair in SEVERITIES.items() for x in pair)), F.col("code"))
    of_member = members.where("code IS NOT NULL").select("site", "url", "document", F.lit(4).alias("phase"), "sequence", "code", severity.alias("severity"), F.when(F.col("code") == "duplicate_location", F.concat(F.lit("first_sequence="), F.col("first").cast("string"))).alias("detail"))
    # A document's findings are bounded by the limits on its members.
    number = F.row_number().over(Window.partitionBy("document").orderBy("phase", "sequence"))
    findings = written(of_document.unionByName(of_member).withColumn("number", number), "sitemap-findings")
    some = findings.select("document").distinct().withColumn("found", F.lit(True))
    state = F.when(~F.col("fetched"), "not_applicable").when(F.col("code") == "gzip_not_supported", "unsupported").when(F.col("code").isNotNull(), "invalid").when(F.col("found"), "parsed_with_warnings").otherwise("parsed")
    done = facts.join(kept, "document", "left").join(some, "document", "left").withColumn("parse_state", state).fillna(0, ["entries", "children"])
    return Sitemaps(
        written(done.select("site", "url", "seed", "final_url", "status", "content_type", "fetched", "bytes", "root", "namespace", "members", "parse_state", "entries", "children"), "sitemap-states"),
        members.drop("document", "first"), findings.select("site", "url", "number", "code", "severity", "sequence", "detail"),
    )
