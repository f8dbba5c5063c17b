"""Sitemap members, their findings and the index tree, against literal documents."""

import pytest
from pyspark.sql import functions as F

from auditlake.operators import sitemap_members, sitemap_tree

NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
SCHEMA = "site string, url string, seed string, final_url string, status int, content_type string, body binary"
SEED = "https://a.example/"


def urlset(*inner, ns=NS):
    return f"<urlset {ns}>{''.join(inner)}</urlset>"


def loc(url):
    return f"<url><loc>{url}</loc></url>"


def index(*urls):
    return f"<sitemapindex {NS}>{''.join(f'<sitemap><loc>{u}</loc></sitemap>' for u in urls)}</sitemapindex>"


def doc(url, body, content_type="application/xml", status=200, final=None, site="a"):
    raw = body.encode() if isinstance(body, str) else body
    return (site, url, SEED, final, status, content_type, None if raw is None else bytearray(raw))


def read(spark, *docs, **limits):
    return sitemap_members.sitemaps(spark.createDataFrame(list(docs), SCHEMA), **limits)


GOOD = loc("https://a.example/1")
#: A document for each code that one alone can have.
DOCUMENTS = {
    "invalid_xml": doc("u", "<urlset><url>"),
    "doctype_forbidden": doc("u", "<! doctype x><urlset/>"),
    "entity_declaration_forbidden": doc("u", '<urlset><!Entity a "b"></urlset>'),
    "invalid_namespace": doc("u", urlset(GOOD, ns="")),
    "unsupported_root_element": doc("u", "<rss/>"),
    "missing_location": doc("u", urlset(GOOD, "<url><lastmod>1</lastmod></url>")),
    "empty_location": doc("u", urlset(GOOD, loc(" \n "))),
    "invalid_location": doc("u", urlset(GOOD, loc("/relative"))),
    "unsupported_scheme": doc("u", urlset(GOOD, loc("mailto:x@a.example"))),
    "out_of_scope_location": doc("u", urlset(GOOD, loc("https://b.example/"))),
    "duplicate_location": doc("u", urlset(GOOD, loc("HTTPS://A.example:443/1#x"))),
    "unexpected_content_type": doc("u", urlset(GOOD), "text/plain"),
    "response_too_large": doc("u", urlset(GOOD, "<!--" + "x" * 5000 + "-->")),
    "url_count_limit_exceeded": doc("u", urlset(*(loc(f"https://a.example/{i}") for i in range(4)))),
    "child_count_limit_exceeded": doc("u", index(*(f"https://a.example/{i}.xml" for i in range(3)))),
    "empty_url_set": doc("u", urlset()),
    "empty_sitemap_index": doc("u", index()),
    "gzip_not_supported": doc("u", b"\x1f\x8b\x08\x00"),
}


def test_one_document_for_each_code(spark):
    docs = [(*d[:1], f"https://a.example/{code}.xml", *d[2:]) for code, d in DOCUMENTS.items()]
    got = read(spark, *docs, most_bytes=4000, most_entries=3, most_children=2)
    found = {}
    for r in got.findings.collect():
        found.setdefault(r["url"].split("/")[-1][:-4], []).append((r["number"], r["code"], r["severity"]))
    expected = {code: [(1, code, sitemap_members.SEVERITIES[code])] for code in DOCUMENTS}
    expected["unexpected_content_type"] = [(1, "unexpected_content_type", "warning")]
    assert found == expected
    state = {r["url"].split("/")[-1][:-4]: r["parse_state"] for r in got.documents.collect()}
    broken = {"invalid_xml", "doctype_forbidden", "entity_declaration_forbidden", "unsupported_root_element", "response_too_large"}
    assert {c for c, s in state.items() if s == "invalid"} == broken and state["gzip_not_supported"] == "unsupported"
    assert {s for c, s in state.items() if c not in broken | {"gzip_not_supported"}} == {"parsed_with_warnings"}


def test_packed_by_name_type_or_bytes_and_html(spark):
    docs = [doc("https://a.example/1.xml.gz?v=1", urlset(GOOD)), doc("https://a.example/2", urlset(GOOD), "application/x-gzip"), doc("https://a.example/3", "  <HTML>", "text/html; charset=x"), doc("https://a.example/4", urlset(GOOD), "text/html"),
            doc("https://a.example/5", urlset(GOOD), "application/atom+xml"), doc("https://a.example/6", urlset(GOOD), None), doc("https://a.example/7", None), doc("https://a.example/8", urlset(GOOD), status=503)]
    got = read(spark, *docs)
    assert {(r["url"][-1], r["code"], r["severity"]) for r in got.findings.collect()} == {("1", "gzip_not_supported", "error"), ("2", "gzip_not_supported", "error"), ("3", "unexpected_content_type", "error"), ("4", "unexpected_content_type", "warning")}
    assert {r["url"][-1]: r["parse_state"] for r in got.documents.collect()} == {"1": "unsupported", "2": "unsupported", "3": "invalid", "4": "parsed_with_warnings", "5": "parsed", "6": "parsed", "7": "not_applicable", "8": "not_applicable"}


def test_members_keep_what_is_told(spark):
    body = urlset(loc(" https://a.example/x?b=1&amp;a=2 "), loc("https://a.example/x?b=1&amp;a=2#f"), "<other><loc>https://a.example/no</loc></other>", loc("https://b.example/"), "<URL><LOC>https://a.example/UP</LOC><LOC>second</LOC></URL>")
    got = [tuple(r) for r in read(spark, doc("https://a.example/s.xml", body)).members.orderBy("sequence").select("sequence", "raw", "normalized", "code", "in_scope", "valid", "duplicate", "child").collect()]
    assert got == [
        (0, "https://a.example/x?b=1&a=2", "https://a.example/x?b=1&a=2", None, True, True, False, False),
        (1, "https://a.example/x?b=1&a=2#f", "https://a.example/x?b=1&a=2", "duplicate_location", True, True, True, False),
        (2, "https://b.example/", "https://b.example/", "out_of_scope_location", False, False, False, False),
        (3, "https://a.example/UP", "https://a.example/UP", None, True, True, False, False),
    ]


def test_no_documents(spark):
    got = read(spark)
    assert got.documents.count() == got.members.count() == got.findings.count() == 0


# The tree


def url(name):
    return f"https://a.example/{name}.xml"


def pages(name, n):
    return doc(url(name), urlset(*(loc(f"https://a.example/{name}/{i}") for i in range(n))))


def walk(spark, docs, roots=("r",), **limits):
    found = read(spark, *docs)
    start = spark.createDataFrame([("a", url(r), i) for i, r in enumerate(roots)], "site string, url string, place long").withColumns({k: F.lit(v) for k, v in limits.items()})
    tree = sitemap_tree.expand(found, start)
    short = lambda u: None if u is None else u.split("/")[-1].removesuffix(".xml")
    read_ = [(short(r["url"]), short(r["parent"]), r["depth"], r["state"]) for r in tree.documents.orderBy("number").collect()]
    told = {(r["code"], short(r["document"]), short(r["subject"])) for r in tree.findings.collect()}
    return read_, told, tuple(tree.sites.select("state", "partial", "documents", "urls").first())


THREE = [doc(url("r"), index(url("i"), url("j"), url("x"))), doc(url("i"), index(url("p"), url("q"), url("r"))), doc(url("j"), index(url("q"), url("j"), url("k"))), pages("x", 2), pages("p", 3), pages("q", 4), doc(url("k"), index(url("deep"))), pages("deep", 1)]


def test_order_of_the_queue_and_loops(spark):
    got, told, site = walk(spark, THREE)
    assert got == [("r", None, 0, "fetched"), ("i", "r", 1, "fetched"), ("j", "r", 1, "fetched"), ("x", "r", 1, "fetched"), ("p", "i", 2, "fetched"), ("q", "i", 2, "fetched"), ("k", "j", 2, "fetched"), ("deep", "k", 3, "fetched")]
    # r was read before its child named it, j names itself; q is only queued when j names it, so it is passed over.
    assert told == {("sitemap_index_loop", "i", "r"), ("sitemap_index_loop", "j", "j")}
    assert site == ("completed_with_warnings", False, 8, 10)


def test_depth_limit(spark):
    got, told, site = walk(spark, THREE, max_depth=2)
    assert [g[0] for g in got] == ["r", "i", "j", "x", "p", "q", "k"] and ("maximum_depth_exceeded", "k", "deep") in told and site[:2] == ("partially_completed", True)


def test_document_limit(spark):
    got, told, site = walk(spark, THREE, max_documents=5)
    assert [g[0] for g in got] == ["r", "i", "j", "x", "p"] and ("sitemap_document_limit_exceeded", "i", "q") in told and site == ("partially_completed", True, 5, 5)
    # With the limit used up at the end of a level the next level reports it once.
    got, told, _ = walk(spark, THREE, max_documents=4)
    assert [g[0] for g in got] == ["r", "i", "j", "x"] and {t for t in told if t[0] != "sitemap_index_loop"} == {("sitemap_document_limit_exceeded", "i", "p")}
    got, told, _ = walk(spark, THREE, max_documents=4, max_depth=1)
    assert {t for t in told if t[0] != "sitemap_index_loop"} == {("sitemap_document_limit_exceeded", "i", "p")}


def test_url_limit_ends_at_the_document(spark):
    got, told, site = walk(spark, THREE, max_urls=4)
    assert [g[0] for g in got] == ["r", "i", "j", "x", "p"] and ("total_url_limit_exceeded", "p", "p") in told and site == ("partially_completed", True, 5, 5)


def test_byte_limit(spark):
    sizes = {d[1]: len(d[6]) for d in THREE}
    upto = lambda *names: sum(sizes[url(n)] for n in names)
    # Exactly used up: the document is read, and the site ends there.
    got, told, site = walk(spark, THREE, max_bytes=upto("r", "i"))
    assert got[-1] == ("i", "r", 1, "fetched") and told == {("response_too_large", "i", "i")} and site[0] == "partially_completed"
    # Longer than what is left: the document fails.
    got, told, _ = walk(spark, THREE, max_bytes=upto("r", "i") - 1)
    assert got[-1] == ("i", "r", 1, "failed") and told == {("response_too_large", "i", "i"), ("child_fetch_failed", "i", "i")}


def test_alias_after_a_redirect(spark):
    docs = [doc(url("r"), index(url("a"), url("b"), url("c"))), doc(url("a"), urlset(loc("https://a.example/1")), final=url("t")), doc(url("b"), urlset(loc("https://a.example/2")), final=url("t")), doc(url("c"), urlset(loc("https://a.example/3")), final=url("r"))]
    got, told, site = walk(spark, docs)
    # r names no final address of its own, so c's target isn't known as read.
    assert [(g[0], g[3]) for g in got] == [("r", "fetched"), ("a", "fetched"), ("b", "skipped"), ("c", "fetched")] and told == {("redirect_alias_duplicate", "b", "t")} and site == ("partially_completed", True, 4, 2)


def test_failures_and_outcomes(spark):
    got, told, site = walk(spark, [doc(url("r"), index(url("gone"), url("e"))), doc(url("e"), urlset(), status=500)])
    assert told == {("child_fetch_failed", "gone", "gone"), ("child_fetch_failed", "e", "e")} and site[0] == "partially_completed" and [g[3] for g in got] == ["fetched", "failed", "failed"]
    got, told, site = walk(spark, [doc(url("r"), urlset(GOOD), status=404)])
    assert told == {("fetch_failed", "r", "r")} and site[:2] == ("failed", False)
    assert walk(spark, [pages("r", 3)])[2] == ("completed", False, 1, 3)
    assert walk(spark, [doc(url("r"), "<rss/>")])[2][0] == "failed"
    two = walk(spark, [doc(url("r"), urlset(GOOD), status=404), pages("s", 2)], roots=("r", "s"))
    assert two[2] == ("completed_with_warnings", False, 2, 2)


def test_sites_have_their_own_budgets(spark):
    docs = [(s, u.replace("a.example", f"{s}.example"), f"https://{s}.example/", f, st, c, bytearray(bytes(b).replace(b"//a.example", f"//{s}.example".encode()))) for s in ("a", "b", "c") for _, u, _, f, st, c, b in THREE]
    found = read(spark, *docs)
    roots = spark.createDataFrame([(s, f"https://{s}.example/r.xml", 0, n) for s, n in (("a", 2), ("b", 5), ("c", None))], "site string, url string, place long, max_documents long")
    tree = sitemap_tree.expand(found, roots)
    assert {r["site"]: (r["state"], r["documents"]) for r in tree.sites.collect()} == {"a": ("partially_completed", 2), "b": ("partially_completed", 5), "c": ("completed_with_warnings", 8)}


@pytest.mark.parametrize("code", ["robots_sitemap_invalid", "http_error"])
def test_other_codes_are_known(code):
    assert sitemap_members.SEVERITIES[code] == "warning" and len(sitemap_members.SEVERITIES) == 27
