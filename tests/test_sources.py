import json

from pyspark.sql import functions as F

from auditlake.operators import robots, sitemap
from auditlake.sources import exports, html

PAGE = """<!doctype html><html lang="en"><head><title> One
 title</title><title>Two</title><base href="/base/"><meta name="description" content=" D "><meta name=robots content="noindex, nofollow max-snippet:-1"><link rel="canonical" href="/c">
<script type="application/ld+json">{"@graph":[{"@type":["Article","Thing"],"@id":"x","headline":"H","author":{"@type":"Person","name":"P"}}]}</script><script type="application/ld+json">{"@type":"A","@type":"B"}</script>
<script type="application/ld+json">{bad</script></head><body><a href="p?q=1#f" rel="nofollow ugc">Go <b>there</b></a><a href="javascript:x()">J</a><a href="mailto:a@b.c">M</a><a href="#t">T</a><a href="http://u:p@x/">C</a><a href="">E</a>
<a href="/i"><img src="a.png" alt="" width=10 loading=lazy srcset="a.png 1x, b.png 2x"></a><img src=b.png role=presentation>
<div itemscope itemtype="https://schema.org/Product" itemid="urn:1"><span itemprop="name">Pen <i>red</i></span><div itemprop="offers" itemscope itemtype="Offer"><meta itemprop="price" content="3"></div></div>"""


def test_one_page():
    e = html.read_page("https://a.com/x/", PAGE)
    assert e["titles"] == ["One title", "Two"] and e["descriptions"] == ["D"] and e["canonicals"] == ["/c"] and e["lang"] == "en" and e["base"] == "https://a.com/base/" and e["recovered"]
    assert e["robots"] == ["robots:noindex", "robots:nofollow max-snippet:-1"] or "robots:noindex" in e["robots"]
    first = e["links"][0]
    assert first["resolved"] == "https://a.com/base/p?q=1" and first["anchor"] == "Go there" and first["nofollow"]
    assert [x["error"] for x in e["links"][1:6]] == ["unsupported_scheme", "unsupported_scheme", None, "embedded_credentials", "empty_url"]
    assert e["images"][0]["linked"] and e["images"][0]["alt"] == "" and e["images"][0]["srcset"] == ["a.png", "b.png"] and e["images"][1]["decorative"] and e["images"][1]["alt"] is None
    types = [(b["format"], b["types"], b["error"]) for b in e["blocks"]]
    assert ("json_ld", ["Article", "Thing"], None) in types and ("json_ld", ["Person"], None) in types and ("json_ld", ["B"], "duplicate_key") in types and ("json_ld", [], "invalid_json") in types
    product = next(b for b in e["blocks"] if b["types"] == ["https://schema.org/Product"])
    offer = next(b for b in e["blocks"] if b["types"] == ["Offer"])
    assert dict(product["properties"])["name"] == ["Pen red"] and product["ids"] == ["urn:1"] and dict(offer["properties"]) == {"price": ["3"]}


MARKUP = """<div vocab="https://schema.org/" typeof="Person" about="#me" prefix="bad mapping"><span property="name">Ann</span><a rel="knows" href="#you">B</a><i inlist property=x>1</i></div>
<p itemprop="lost">L</p><div itemscope itemid="a b" itemref="extra gone"><b itemprop="name"></b><b itemprop="none" content=""></b></div><div id="extra"><span itemprop="price">3</span></div>
<script type="application/ld+json">5</script><script type="text/ld-json"> </script><script type="application/ld+json">{"@context":"https://schema.org","@type":"Article","author":{"@id":"#a"},"image":{"url":"u"}}</script>"""


def test_block_evidence():
    blocks = html.read_page("https://a.com/", MARKUP)["blocks"]
    person, lost, item, outside, scalar, empty, article = blocks
    assert person["contexts"] == ["https://schema.org/", "bad mapping"] and person["references"] == ["#you"] and person["diagnostics"] == ["rdfa_invalid_prefix_mapping", "rdfa_unsupported_pattern"]
    assert dict(person["properties"]) == {"name": ["Ann"], "knows": ["#you"], "x": ["1"]}
    assert lost["diagnostics"] == outside["diagnostics"] == ["microdata_property_outside_scope"] and dict(lost["properties"]) == {"lost": ["L"]}
    assert dict(item["properties"]) == {"name": [""], "none": [""], "price": ["3"]} and item["references"] == ["gone"]
    assert sorted(item["diagnostics"]) == ["microdata_invalid_itemid", "microdata_unresolved_itemref:gone", "property_missing_value:name"]
    assert (scalar["root"], scalar["error"], empty["root"], empty["error"], empty["script_type"]) == ("scalar", "no_type", "empty", "invalid_json", "text/ld-json")
    assert article["contexts"] == ["https://schema.org"] and article["references"] == ["#a"] and dict(article["properties"]) == {"author": ["[reference]"], "image": ["[structured]"]}


def test_evidence_tables(spark):
    pages = spark.createDataFrame([(1, "https://a.com/x/", PAGE), (2, "https://a.com/y", None), (3, "https://a.com/z", "")], "page_id long, url string, html string")
    own = html.parsed(pages)
    links = html.links(own).orderBy("link_sequence").collect()
    assert [r.link_type for r in links] == ["http", "javascript", "mailto", "fragment", "invalid", "invalid", "http"]
    assert html.images(own).count() == 2 and html.blocks(own).count() == 6
    assert own.where("page_id > 1").select(F.size("evidence.titles")).distinct().collect()[0][0] == 0


ROBOTS = """# comment
Disallow: /ignored
User-agent: *
Disallow: /private
Allow: /private/open
Disallow: /*.pdf$
Sitemap: https://a.com/s.xml
User-agent: auditbot
User-agent: other
Disallow: /only
Crawl-delay: 1.5
"""


def test_robots(spark):
    rows = robots.rules(spark.createDataFrame([("a", ROBOTS), ("b", None), ("c", "User-agent: nobody\nDisallow: /")], "origin string, body string"))
    assert rows.where("sitemap is not null").count() == 1 and {r.delay for r in rows.where("delay is not null").collect()} == {1.5}
    urls = spark.createDataFrame([(1, "a", "/private/x"), (2, "a", "/private/open/x"), (3, "a", "/f.pdf"), (4, "a", "/f.pdf?x"), (5, "a", "/"), (6, "b", "/x"), (7, "c", "/x"), (8, "d", "/x")], "url_id long, origin string, target string")
    got = {r.url_id: (r.allowed, r.reason) for r in robots.decisions(urls, rows, "somebot").collect()}
    assert got == {1: (False, "disallowed_by_rule"), 2: (True, "allowed_by_rule"), 3: (False, "disallowed_by_rule"), 4: (True, "no_matching_rule"), 5: (True, "no_matching_rule"), 6: (True, "no_matching_group"), 7: (True, "no_matching_group"), 8: (True, "no_matching_group")}
    own = {r.url_id: r.allowed for r in robots.decisions(urls, rows, "auditbot").collect()}
    assert own[1] and own[3]
    states = spark.createDataFrame([("a", "temporary"), ("b", "forbidden"), ("c", "no_policy")], "origin string, state string")
    closed = {r.url_id: r.allowed for r in robots.decisions(urls, rows, "somebot", states).collect()}
    assert closed[5] is False and closed[6] is False and closed[7] is True


def test_sitemap_parse_and_expand(spark):
    urlset = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://a.com/1 </loc></url><url><loc></loc></url></urlset>'
    index = "<sitemapindex><sitemap><loc>c1</loc></sitemap><sitemap><loc>root</loc></sitemap></sitemapindex>"
    assert sitemap.parse_sitemap(urlset) == ("urlset", ["https://a.com/1"], None)
    assert sitemap.parse_sitemap("<!DOCTYPE x><urlset/>")[2] == "unsafe_declaration" and sitemap.parse_sitemap(b"\x1f\x8b12")[2] == "compressed_not_supported" and sitemap.parse_sitemap("<a>")[2] == "malformed_xml" and sitemap.parse_sitemap(None)[2] == "malformed_xml"
    docs = spark.createDataFrame([("root", index), ("c1", urlset), ("unused", urlset)], "url string, body string")
    assert {(r.url, r.level) for r in sitemap.expand_indexes(docs, ["root"]).collect()} == {("root", 0), ("c1", 1)}


def test_sitemap_documents(spark):
    urls = spark.createDataFrame([(f"https://a.com/{i % 7}?a&b", i) for i in range(20)], "url string, sequence long")
    got = sorted(sitemap.xml_documents(urls, most=3).collect())
    assert [(r.document, r.entries) for r in got] == [(0, 3), (1, 3), (2, 1)]
    assert sitemap.parse_sitemap(got[0].xml)[1] == [f"https://a.com/{i}?a&b" for i in range(3)]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x"), (2, " +y"), (3, "ok"), (4, None)], "id long, v string")
    assert [r[0] for r in df.orderBy("id").select(exports.guarded(F.col("v"))).collect()] == ["'=x", " +y", "ok", None]
    assert [r[0] for r in df.orderBy("id").select(exports.guarded(F.col("v"), trim=True)).collect()][1] == "' +y"
    assert exports.csv_export(df, ["id", "v"], ["id"], str(tmp_path / "out"), most=2) is True
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    assert json.loads(exports.json_export(df, ["id"], 3)) == {"rows": [{"id": 1, "v": "=x"}, {"id": 2, "v": " +y"}, {"id": 3, "v": "ok"}], "truncated": True}
    assert "| id | v |" in exports.markdown_export("T", {"rows": df}) and json.loads(exports.manifest({"b": b"1", "a": b""}))[0]["name"] == "a"
    (tmp_path / "m.csv").write_text("Old_URL,to\nhttp://a,http://b\n")
    assert [tuple(r) for r in exports.read_delimited(spark, str(tmp_path / "m.csv")).collect()] == [("http://a", "http://b")]
    (tmp_path / "u.txt").write_text("http://a\n\nhttp://b\n")
    assert exports.read_delimited(spark, str(tmp_path / "u.txt")).count() == 2
