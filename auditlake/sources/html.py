"""HTML evidence: one pass of a streaming parser over each page, in Arrow batches.

The parser keeps a stack of open elements, so that microdata items have their owners; it doesn't build a document.
`parsed` adds a struct column to pages; `links`, `images` and `blocks` explode its arrays. The wide html column is
read once and dropped.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from auditlake.functions.text import nfkc_casefold, stable_id
from auditlake.functions.urls import UrlError, content_category, normal_parts, normalize_url, resolve_url

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Directives whose value may follow a colon. Fixed values.
PARAMETER_DIRECTIVES = frozenset(("max-snippet", "max-image-preview", "max-video-preview", "unavailable_after"))
MAX_BLOCKS, MAX_BLOCK_CHARACTERS, MAX_DEPTH, MAX_ITEMS = 1000, 65536, 32, 5000
#: RDFa prefix mappings, and an identifier of a microdata item.
PREFIXES = re.compile(r"\s*(?:[a-z][a-z0-9._-]*:\s+https?://[^/?#\s]\S*(?:\s+|$))+", re.ASCII | re.IGNORECASE)
IDENTIFIER = re.compile(r"#\S+|https?://[^/?#\s].*|urn:[^?#].*", re.IGNORECASE)
PLACEHOLDER_ATTRIBUTES = ("data-src", "data-lazy-src", "data-original")

text = T.StringType()
LINK = T.StructType([T.StructField(n, t) for n, t in (("index", T.IntegerType()), ("element", text), ("href", text), ("anchor", text), ("rel", T.ArrayType(text)), ("nofollow", T.BooleanType()), ("resolved", text), ("error", text))])
IMAGE = T.StructType([T.StructField(n, t) for n, t in (("index", T.IntegerType()), ("src", text), ("srcset", T.ArrayType(text)), ("lazy", text), ("alt", text), ("width", text), ("height", text), ("loading", text), ("decoding", text), ("priority", text), ("linked", T.BooleanType()), ("decorative", T.BooleanType()))])
BLOCK = T.StructType([T.StructField(n, t) for n, t in (("index", T.IntegerType()), ("format", text), ("types", T.ArrayType(text)), ("ids", T.ArrayType(text)), ("properties", T.MapType(text, T.ArrayType(text))), ("fingerprint", text), ("error", text), ("truncated", T.BooleanType()), ("contexts", T.ArrayType(text)), ("references", T.ArrayType(text)), ("diagnostics", T.ArrayType(text)), ("script_type", text), ("root", text))])
EVIDENCE = T.StructType(
    [T.StructField(n, T.ArrayType(text)) for n in ("titles", "descriptions", "canonicals", "robots")]
    + [T.StructField("base", text), T.StructField("lang", text), T.StructField("recovered", T.BooleanType())]
    + [T.StructField("links", T.ArrayType(LINK)), T.StructField("images", T.ArrayType(IMAGE)), T.StructField("blocks", T.ArrayType(BLOCK))]
)


def squeezed(value: str) -> str:
    return " ".join(value.split())


def directives(value: str) -> list[str]:
    """Directives of a robots value: between commas, and between spaces but for those with a parameter."""
    out: list[str] = []
    for part in value.lower().split(","):
        part = squeezed(part)
        name = part.split(":", 1)[0].strip()
        out += [part] if name in PARAMETER_DIRECTIVES else part.split()
    return out


class Reader(HTMLParser):
    """Collects a page's evidence in document order."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.base = url, None
        self.titles: list[str] = []
        self.descriptions: list[str] = []
        self.canonicals: list[str] = []
        self.robots: list[str] = []
        self.lang: str | None = None
        self.links: list[dict] = []
        self.images: list[dict] = []
        self.blocks: list[dict] = []
        self.open: list[tuple[str, dict | None]] = []  # element, microdata item that it begins
        self.open_ids: list[str | None] = []  # id of each open element
        self.ids: set[str] = set()
        self.inside: dict[str, list[tuple[str, list[str], int]]] = {}  # properties below an element with an id: name, values, place
        self.capture: list[tuple[str, list[str], dict | None]] = []  # element whose text is collected
        self.balance = dict.fromkeys(("title", "head", "body", "html"), 0)

    def owner(self) -> dict | None:
        return next((item for _, item in reversed(self.open) if item is not None), None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {}
        for k, v in attrs:
            a.setdefault(k, v)
        if tag in self.balance:
            self.balance[tag] += 1
        if tag == "html" and self.lang is None:
            self.lang = a.get("lang")
        elif tag == "title":
            self.capture.append((tag, [], None))
        elif tag == "base" and self.base is None and a.get("href"):
            try:
                self.base = str(normal_parts(a["href"], self.url)["normalized"])
            except UrlError:
                pass
        elif tag == "meta":
            name = (a.get("name") or "").strip().lower()
            if name == "description":
                self.descriptions.append(squeezed(a.get("content") or ""))
            elif name == "robots" or name.endswith("bot"):
                self.robots += [f"{name}:{d}" for d in directives(a.get("content") or "")]
        elif tag == "link" and "canonical" in (a.get("rel") or "").lower().split():
            self.canonicals.append((a.get("href") or "").strip())
        elif tag in ("a", "area") and "href" in a:
            rel = (a.get("rel") or "").lower().split()
            link = {"index": len(self.links), "element": tag, "href": (a["href"] or "").strip(), "anchor": squeezed(a.get("alt") or "") if tag == "area" else "", "rel": rel, "nofollow": "nofollow" in rel}
            self.links.append(link)
            if tag == "a":
                self.capture.append((tag, [], link))
        elif tag == "img":
            role = (a.get("role") or "").lower()
            self.images.append({
                "index": len(self.images), "src": a.get("src"), "srcset": [x.split()[0] for x in (a.get("srcset") or "").split(",") if x.split()],
                "lazy": next((a[k] for k in PLACEHOLDER_ATTRIBUTES if a.get(k)), None), "alt": (a["alt"] or "") if "alt" in a else None, "width": a.get("width"), "height": a.get("height"), "loading": a.get("loading"),
                "decoding": a.get("decoding"), "priority": a.get("fetchpriority"), "linked": any(t == "a" for t, _, _ in self.capture), "decorative": role in ("presentation", "none") or a.get("aria-hidden") == "true",
            })
        elif tag == "script" and "json" in (a.get("type") or "").lower() and "ld" in (a.get("type") or "").lower():
            self.capture.append((tag, [], {"script_type": a.get("type")}))
        item = self.item(a)
        if a.get("id"):
            self.ids.add(a["id"])
        if tag not in VOID:
            self.open.append((tag, item))
            self.open_ids.append(a.get("id"))

    def item(self, a: dict) -> dict | None:
        """The microdata or RDFa item that an element begins; its properties go to the nearest item around it."""
        item, around = None, self.owner()
        if "itemscope" in a or any(k in a for k in ("typeof", "vocab", "prefix")):
            kind = "microdata" if "itemscope" in a else "rdfa"
            types = (a.get("itemtype") or a.get("typeof") or "").split()
            ids = [a[k] for k in ("itemid", "resource", "about") if a.get(k)][:1]
            item = bare_block(kind) | {"types": types, "ids": ids}
            if kind == "rdfa":
                item["contexts"] = [a[k] for k in ("vocab", "prefix") if a.get(k)]
                if "prefix" in a and not PREFIXES.fullmatch(a["prefix"] or ""):
                    item["diagnostics"].append("rdfa_invalid_prefix_mapping")
            else:
                item["itemref"] = (a.get("itemref") or "").split()
                if "itemid" in a and not IDENTIFIER.fullmatch(a["itemid"] or ""):
                    item["diagnostics"].append("microdata_invalid_itemid")
            self.blocks.append(item)
        if "inlist" in a:
            for held in (item, *(i for _, i in self.open)):
                if held is not None and held["format"] == "rdfa" and "rdfa_unsupported_pattern" not in held["diagnostics"]:
                    held["diagnostics"].append("rdfa_unsupported_pattern")
        names = (a.get("itemprop") or a.get("property") or "").split()
        if around is not None and around["format"] == "rdfa":
            names += [n for k in ("rel", "rev") for n in (a.get(k) or "").split()]
            if names and (a.get("resource") or a.get("href")):
                around["references"].append(a.get("resource") or a["href"])
        elif around is not None and a.get("itemprop") and a.get("itemid"):
            around["references"].append(a["itemid"])
        if around is None and a.get("itemprop"):
            around = bare_block("microdata") | {"diagnostics": ["microdata_property_outside_scope"]}
            self.blocks.append(around)
        if names and around is not None:
            value = next((a[k] for k in ("content", "href", "src", "datetime") if a.get(k)), None)
            told = any(k in a for k in ("content", "href", "src", "resource", "datetime", "value"))
            for n in names:
                values = around["properties"].setdefault(n, [])
                values.append(value or "")
                for i in self.open_ids:
                    if i:
                        self.inside.setdefault(i, []).append((n, values, len(values) - 1))
                if value is None and item is None:
                    self.capture.append(("", [], {"item": around, "name": n, "at": len(values) - 1, "depth": len(self.open), "told": told}))
        return item

    def referred(self, item: dict) -> None:
        """Adds the properties of the elements that an item refers to by id, or says that they aren't there."""
        for i in item.pop("itemref", ()):
            if i not in self.ids:
                item["diagnostics"].append(f"microdata_unresolved_itemref:{i}")
                item["references"].append(i)
            for name, values, at in self.inside.get(i, ()):
                item["properties"].setdefault(name, []).append(values[at])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        for _, parts, _ in self.capture:
            parts.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.balance:
            self.balance[tag] -= 1
        for i in range(len(self.capture) - 1, -1, -1):
            if self.capture[i][0] == tag:
                _, parts, target = self.capture.pop(i)
                self.finish(tag, "".join(parts), target)
                break
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:], self.open_ids[i:]
                break
        for i in range(len(self.capture) - 1, -1, -1):
            target = self.capture[i][2]
            if not self.capture[i][0] and target["depth"] >= len(self.open):
                value = squeezed("".join(self.capture.pop(i)[1]))
                target["item"]["properties"][target["name"]][target["at"]] = value
                if not value and not target["told"]:
                    target["item"]["diagnostics"].append(f"property_missing_value:{target['name']}")

    def finish(self, tag: str, data: str, target: dict | None) -> None:
        if tag == "title":
            self.titles.append(squeezed(data))
        elif tag == "a":
            target["anchor"] = squeezed(data)
        elif tag == "script":
            self.blocks += json_ld(data, target["script_type"])

    def evidence(self) -> dict:
        for tag, parts, target in reversed(self.capture):
            if tag:
                self.finish(tag, "".join(parts), target)
        base = self.base or self.url
        for link in self.links:
            try:
                link |= {"resolved": str(normal_parts(link["href"], base)["normalized"]), "error": None}
            except UrlError as e:
                link |= {"resolved": None, "error": str(e)}
        blocks = self.blocks[:MAX_BLOCKS]
        for i, b in enumerate(blocks):
            b["index"] = i
            self.referred(b)
            b.setdefault("fingerprint", hashlib.sha256(json.dumps([b["types"], b["ids"], b["properties"]], sort_keys=True).encode()).hexdigest())
            b["properties"] = list(b["properties"].items())
        return {
            "titles": self.titles, "descriptions": self.descriptions, "canonicals": self.canonicals, "robots": self.robots, "base": self.base, "lang": self.lang,
            "recovered": any(n > 0 for n in self.balance.values()), "links": self.links, "images": self.images, "blocks": blocks,
        }


def bare_block(kind: str) -> dict:
    return {"format": kind, "types": [], "ids": [], "properties": {}, "error": None, "truncated": False, "contexts": [], "references": [], "diagnostics": [], "script_type": None, "root": None}


def json_ld(data: str, script_type: str | None = "application/ld+json") -> list[dict]:
    """A block for each entity of a JSON-LD script, or one with the error; contexts are those of the whole script."""
    raw = data[:MAX_BLOCK_CHARACTERS]
    common = bare_block("json_ld") | {"truncated": len(data) > len(raw), "script_type": script_type, "root": "empty" if not raw.strip() else None}
    failed = common | {"fingerprint": hashlib.sha256(raw.encode()).hexdigest()}
    twice: list[str] = []

    def pairs(items: list[tuple[str, object]]) -> dict:
        twice.extend(k for k, n in Counter(k for k, _ in items).items() if n > 1)
        return dict(items)

    try:
        document = json.loads(raw, object_pairs_hook=pairs)
    except ValueError:
        return [failed | {"error": "invalid_json"}]
    root = "object" if isinstance(document, dict) else "array" if isinstance(document, list) else "scalar"
    listed = lambda v: v if isinstance(v, list) else [v]
    out: list[dict] = []
    contexts: dict[str, None] = {}
    todo, seen = [(document, 0)], 0
    while todo and seen < MAX_ITEMS:
        x, depth = todo.pop(0)
        seen += 1
        if isinstance(x, list):
            todo += [(y, depth + 1) for y in x if depth < MAX_DEPTH]
        elif isinstance(x, dict):
            contexts |= dict.fromkeys(c for c in listed(x.get("@context", [])) if isinstance(c, str))
            if "@type" in x:
                properties = {k: [shown_value(y) for y in listed(v)] for k, v in x.items() if not k.startswith("@")}
                to = [y["@id"] for k, v in x.items() if not k.startswith("@") for y in listed(v) if isinstance(y, dict) and isinstance(y.get("@id"), str)]
                canonical = json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
                named = {"types": [str(t) for t in listed(x["@type"])], "ids": [str(i) for i in listed(x.get("@id", []))], "properties": properties, "references": sorted(set(to))}
                out.append(common | named | {"fingerprint": hashlib.sha256(canonical.encode()).hexdigest(), "error": "duplicate_key" if twice else None, "root": root})
            todo += [(v, depth + 1) for v in x.values() if isinstance(v, (dict, list)) and depth < MAX_DEPTH]
    return [b | {"contexts": list(contexts)} for b in out] or [failed | {"error": "no_type", "root": root, "contexts": list(contexts)}]


def shown_value(value: object) -> str:
    """Text of a JSON value; an object that names another entity, and any other nested value, is told by a mark."""
    if isinstance(value, dict) and isinstance(value.get("@id"), str):
        return "[reference]"
    if isinstance(value, (dict, list)):
        return "[structured]"
    return value if isinstance(value, str) else json.dumps(value)


def read_page(url: str, html: str | None) -> dict:
    reader = Reader(url)
    reader.feed(html or "")
    reader.close()
    return reader.evidence()


def parsed(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with the struct column `evidence` in place of the html column."""
    names = [c for c in pages.columns if c != html_col]
    kept = pages.select(*names, F.col(html_col).alias("__html"))
    schema = T.StructType([*pages.select(*names).schema.fields, T.StructField("evidence", EVIDENCE)])
    kind, at = to_arrow_type(EVIDENCE), names.index(url_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                found = [read_page(u or "", h) for u, h in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, kind)], names=[*names, "evidence"])

    return kept.mapInArrow(run, schema)


#: SQL of a link's type from href, resolved and error. Fixed values.
LINK_TYPE_SQL = """CASE WHEN href LIKE '#%' THEN 'fragment' WHEN lower(href) LIKE 'javascript:%' THEN 'javascript' WHEN href = '' THEN 'invalid' WHEN lower(href) LIKE 'mailto:%' THEN 'mailto'
 WHEN lower(href) LIKE 'tel:%' THEN 'tel' WHEN lower(href) LIKE 'data:%' THEN 'data' WHEN resolved IS NOT NULL THEN 'http' WHEN error = 'unsupported_scheme' THEN 'unsupported' ELSE 'invalid' END"""


def links(evidence: DataFrame, key: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each link in document order; bounded anchors and hrefs, SHA-256 identities."""
    own = evidence.select(F.col(key), F.col(url_col).alias("source_url"), F.explode("evidence.links").alias("l")).select(key, "source_url", "l.*")
    return own.select(
        key, "source_url", F.col("index").alias("link_sequence"), F.substring("href", 1, 4096).alias("href"), "resolved", F.sha2("resolved", 256).alias("target_identity"), F.substring("anchor", 1, 512).alias("anchor"),
        F.array_join("rel", " ").alias("rel"), "nofollow", F.expr(LINK_TYPE_SQL).alias("link_type"),
    )


def images(evidence: DataFrame, key: str = "page_id", url_col: str = "url") -> DataFrame:
    return evidence.select(F.col(key), F.col(url_col).alias("page_url"), F.explode("evidence.images").alias("i")).select(key, "page_url", "i.*")


def blocks(evidence: DataFrame, key: str = "page_id", url_col: str = "url") -> DataFrame:
    return evidence.select(F.col(key), F.col(url_col).alias("page_url"), F.explode("evidence.blocks").alias("b")).select(key, "page_url", "b.*")


#: Limits of titles and descriptions for the parser's warnings. Fixed values.
TITLE_RANGE, DESCRIPTION_RANGE = (15, 60), (70, 160)


def presence(values: str) -> Column:
    n = F.size(values)
    return F.when(n == 0, "missing").when(n > 1, "multiple").when(F.try_element_at(values, F.lit(1)) == "", "empty").otherwise("single")


def page_projection(evidence: DataFrame, run: str, url_col: str = "url") -> DataFrame:
    """The page facts of one run. evidence: parsed pages with page_id, http_status, content_type, discovery_order.

    Identities are SHA-256 of URLs; facts of the HTML are unavailable where the response failed or isn't HTML.
    """
    first = lambda c: F.try_element_at(c, F.lit(1))
    df = evidence.withColumns({"identity": F.sha2(url_col, 256), "category": content_category(F.col("content_type")), "fetch_failed": F.col("http_status").isNull()})
    df = df.withColumn("parsed_as_html", (F.col("category") == "html") & F.col("http_status").between(200, 299))
    seen = lambda c, otherwise: F.when(F.col("parsed_as_html"), c).otherwise(otherwise)
    df = df.withColumns({
        "title": seen(first("evidence.titles"), None), "description": seen(first("evidence.descriptions"), None), "title_presence": seen(presence("evidence.titles"), "unavailable"), "description_presence": seen(presence("evidence.descriptions"), "unavailable"),
        "c": F.when(F.col("parsed_as_html") & (F.size(F.array_distinct("evidence.canonicals")) == 1), resolve_url(first("evidence.canonicals"), F.coalesce("evidence.base", url_col))), "own": normalize_url(url_col),
    })
    canonicals = F.size(F.array_distinct("evidence.canonicals"))
    title, description = F.length("title"), F.length("description")
    tests = (
        ("missing_title", F.col("title_presence") == "missing"), ("empty_title", F.col("title_presence") == "empty"), ("multiple_titles", F.size("evidence.titles") > 1), ("conflicting_titles", F.size(F.array_distinct("evidence.titles")) > 1),
        ("short_title", (title > 0) & (title < TITLE_RANGE[0])), ("long_title", title > TITLE_RANGE[1]), ("missing_meta_description", F.col("description_presence") == "missing"), ("empty_meta_description", F.col("description_presence") == "empty"),
        ("multiple_meta_descriptions", F.size("evidence.descriptions") > 1), ("conflicting_meta_descriptions", F.size(F.array_distinct("evidence.descriptions")) > 1), ("short_meta_description", (description > 0) & (description < DESCRIPTION_RANGE[0])),
        ("long_meta_description", description > DESCRIPTION_RANGE[1]), ("missing_canonical", F.size("evidence.canonicals") == 0), ("empty_canonical", F.array_contains("evidence.canonicals", "")), ("multiple_canonicals", F.size("evidence.canonicals") > 1),
        ("conflicting_canonicals", canonicals > 1), ("invalid_canonical", F.col("c.error_code").isNotNull()), ("cross_host_canonical", F.col("c.hostname") != F.col("own.hostname")), ("canonical_origin_differs", F.col("c.origin") != F.col("own.origin")),
        ("canonical_url_differs", F.col("c.normalized") != F.col("own.normalized")), ("parser_recovery_used", F.col("evidence.recovered")),
    )
    warnings = F.when(F.col("parsed_as_html"), F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests)))).otherwise(F.array().cast("array<string>"))
    return df.select(
        "page_id", stable_id(F.lit(run), "discovery_order", "identity").alias("evidence_id"), F.col(url_col).alias("url"), "identity", "discovery_order", "http_status", "fetch_failed", "content_type", "category", "parsed_as_html",
        "title", F.length("title").alias("title_length"), "title_presence", F.sha2(nfkc_casefold("title"), 256).alias("title_normalized_hash"), "description", F.length("description").alias("description_length"), "description_presence",
        F.sha2(nfkc_casefold("description"), 256).alias("description_normalized_hash"), seen(presence("evidence.canonicals"), "unavailable").alias("canonical_presence"), F.col("c.normalized").alias("canonical_url"), F.sha2("c.normalized", 256).alias("canonical_identity"),
        seen(F.size("evidence.canonicals"), 0).alias("canonical_count"), seen(canonicals > 1, False).alias("canonical_conflicting"), F.coalesce(F.col("c.hostname") != F.col("own.hostname"), F.lit(False)).alias("canonical_cross_host"),
        F.coalesce(F.col("c.scheme") != F.col("own.scheme"), F.lit(False)).alias("canonical_cross_scheme"), F.coalesce(F.col("c.port") != F.col("own.port"), F.lit(False)).alias("canonical_cross_port"),
        F.coalesce(F.array_contains("evidence.robots", "robots:noindex"), F.lit(False)).alias("meta_noindex"), F.col("evidence.lang").alias("language"), F.col("evidence.recovered").alias("parser_recovered"), warnings.alias("warnings"),
    )
