from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from claimspark.functions import html
from claimspark.operators import extract, jsonld
from claimspark.sources.pages import key_collisions
from claimspark.sources.sitemap import read_url_set, sitemap_urls


def script(*values):
    return "".join(
        f'<script type="application/ld+json">{v if isinstance(v, str) else json.dumps(v)}</script>' for v in values
    )


REVIEW = {
    "@type": "ClaimReview",
    "claimReviewed": "c1",
    "reviewRating": {"alternateName": "Falso"},
    "itemReviewed": {"author": {"name": "ana"}},
    "datePublished": "2021-01-01",
}
ARTICLE = {"@type": "NewsArticle", "headline": "h1", "datePublished": "2020-01-01", "keywords": ["k1", "k2"]}

PAGES = {
    "graph": script({"@graph": [REVIEW, ARTICLE]}),
    "last_wins": script(REVIEW, {"@type": "ClaimReview", "claimReviewed": None}),
    "type_list": script({**REVIEW, "@type": ["Review", "ClaimReview", ""]}),
    "rating_value": script({**REVIEW, "reviewRating": {"ratingValue": 2, "alternateName": ""}}),
    "author_list": script(REVIEW, {**REVIEW, "itemReviewed": {"author": [{"name": "eva"}]}}),
    "broken_first": script('{"@type": "ClaimReview"', REVIEW),
    "article_then_review": script(ARTICLE, REVIEW),
    "review_then_article": script(REVIEW, ARTICLE),
    "review_without_date": script(ARTICLE, {**REVIEW, "datePublished": ""}),
    "two_articles": script({**ARTICLE, "headline": ""}, ARTICLE, {**ARTICLE, "headline": "h2", "keywords": "solo"}),
    "metas": '<head><title>t | Site</title><meta content="og &amp; x" property="og:title">'
    '<meta property="article:published_time" content="2019-05-05"></head><body>Engañoso: algo</body>',
    "suffix": "<title> Nota &#241; \n| Site </title>",
    "empties": script({**ARTICLE, "headline": "", "datePublished": ""})
    + '<meta property="og:title" content=""><title>T</title>',
    "lookalike": script({"@type": "ClaimReviewX", "claimReviewed": "no"}),
    "commented": "<!-- " + script(REVIEW) + " --><p>x</p>",
    "missing": None,
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(list(PAGES.items()), "url string, html string").cache()


@pytest.fixture(scope="module")
def records(pages):
    return {r.url: r for r in extract.structured_records(pages).collect()}


@pytest.fixture(scope="module")
def sample(pages):
    return {r.url: r for r in extract.article_sample(pages, "Site").collect()}


def test_graph_is_folded(records):
    r = records["graph"]
    assert (r.claim_reviewed, r.claimant, r.rating, r.headline, r.keywords) == ("c1", "ana", "Falso", "h1", "k1, k2")
    assert r.jsonld_types == "ClaimReview|NewsArticle" and r.date_jsonld == "2021-01-01"


def test_last_review_wins_even_when_empty(records):
    r = records["last_wins"]
    assert (r.claim_reviewed, r.rating, r.claimant, r.date_jsonld) == (None, None, None, "2021-01-01")


def test_type_lists_ratings_and_authors(records):
    assert records["type_list"].jsonld_types == "ClaimReview|Review"
    assert records["rating_value"].rating == "2"
    assert records["author_list"].claimant == "ana"
    assert records["broken_first"].claim_reviewed == "c1"


def test_dates(records):
    assert records["article_then_review"].date_jsonld == "2021-01-01"
    assert records["review_then_article"].date_jsonld == "2021-01-01"
    assert records["review_without_date"].date_jsonld == "2020-01-01"


def test_first_headline_last_keywords(records):
    assert (records["two_articles"].headline, records["two_articles"].keywords) == ("h1", "solo")


def test_no_markup(records):
    for name in ("metas", "suffix", "commented", "missing"):
        assert records[name].jsonld_types is None and records[name].claim_reviewed is None


def test_fallbacks(sample):
    assert (sample["metas"].title, sample["metas"].pub_date_raw) == ("og & x", "2019-05-05")
    assert sample["metas"].verdict_in_page == "Engañoso"
    assert sample["suffix"].title == "Nota ñ"
    assert (sample["empties"].title, sample["empties"].pub_date_raw) == ("T", None)
    assert sample["graph"].verdict_in_page == "Falso"
    assert "missing" not in sample


def test_markup_flag(pages):
    rows = {r.url: r for r in extract.harvest_rows(pages).collect()}
    assert rows["lookalike"].has_claimreview and rows["lookalike"].claim_reviewed is None
    assert not rows["missing"].has_claimreview and rows["metas"].pub_date == "2019-05-05"


def test_node_order(spark):
    value = {"@type": "A", "x": [{"@type": "B", "y": {"@type": "C"}}, {"@type": "D"}], "z": {"@type": "E"}}
    df = spark.createDataFrame([("u", script(value))], "url string, html string")
    rows = jsonld.node_rows(df).orderBy("ord").collect()
    assert [r.types for r in rows] == [["A"], ["B"], ["C"], ["D"], ["E"]]


def test_deep_json_is_walked():
    value = {}
    for _ in range(5000):
        value = {"a": [value]}
    assert sum(1 for _ in jsonld.walk(value)) == 5001


def test_visible_text_and_anchors(frame):
    page = (
        "<!DOCTYPE html><title>T</title><!-- no --><style>p{}</style><SCRIPT>var a='<a href=\"/c/x\">no</a>';</SCRIPT>"
        "<p>uno<b> dos </b>&lt;tres&gt;</p> &nbsp; <a class=x href='/c/1?q=1'>A <i>b</i>\n c</a><a href=\"/d/2\">no</a>"
        "<a name=q>n</a><a href=/c/3>tres &amp;amp; &#x41;&unknown;</a>"
    )
    clean = F.col("h")
    row = frame("h string", [(page,)]).select(
        html.visible_text(clean).alias("t"), html.anchors(clean, r"/c/[^?#]+").alias("a")
    ).first()
    assert row.t == "T uno dos <tres> A b c no n tres &amp; A&unknown;"
    assert [(a.pos, a.href, a.text) for a in row.a] == [(0, "/c/1?q=1", "A b c"), (1, "/c/3", "tres &amp; A&unknown;")]


EDGES = {
    "mark in a script": ('<script>var a = "<!--";</script><script type="application/ld+json">{"a": "<!-- x"}</script><a href="/c/1">y</a>', ["/c/1 y"], 1),
    "commented out": ('<!-- <script type="application/ld+json">{}</script> <a href="/c/1">n</a> --><a href="/c/2">y</a><!-- end', ["/c/2 y"], 0),
    "script in a string": ("<script>x = '<script type=\"application/ld+json\">{}';</script><a href='/c/1'>y</a>", ["/c/1 y"], 0),
    "gt in attributes": ('<a title="a > b" data-x=\'> "\' href="/c/1?q=1&amp;r">y</a><img alt="<a href=/c/9>no</a>">', ["/c/1?q=1&r y"], 0),
    "unclosed links": ('<a href=/c/1>one <b>two<a class=k href=/c/2>three</b><!-- </a> --> four</a> five<a href="/c/3">six', ["/c/1 one two", "/c/2 three four", "/c/3 six"], 0),
    "tight attributes": ('<a class="x"href="/c/1"id=q>y</a><a data-href="/c/2" href="/d">n</a>', ["/c/1 y"], 0),
    "type unquoted, other case": ("<SCRIPT defer TYPE=application/ld+json >[1]</SCRIPT ><script type='application/ld+json' id=a>[2]", [], 2),
    "textarea": ('<textarea><a href="/c/1">n</a></textarea><a href="/c/2">y<script>"</a>"</script>z</a>', ["/c/2 y z"], 0),
    "other types": ('<script type="text/javascript" data-type="application/ld+json">{}</script><script id="type=application/ld+json">{}</script>', [], 0),
    "many attributes": ("<a " + " ".join(f'd{i}="{i}"' for i in range(20_000)) + ' href="/c/1">y</a>' + "<p =" + "=" * 50_000 + ">", ["/c/1 y"], 0),
}


@pytest.mark.parametrize("name", EDGES)
def test_markup_edges(frame, name):
    page, links, blocks = EDGES[name]
    row = frame("h string", [(page,)]).select(
        html.anchors(F.col("h"), "/c/").alias("a"), F.size(html.jsonld_blocks(F.col("h"))).alias("b")
    ).first()
    assert ([f"{a.href} {a.text}" for a in row.a], row.b) == (links, blocks)


def test_head_edges(frame):
    page = (
        '<!-- <title>no</title><meta property="og:title" content="no"> --><script>"<title>no</title>"</script>'
        "<meta name=\"a > b\" property=og:title data-content='no' content=\"it's > x &amp; y\"><meta property='og:title' content=late>"
        "<title lang=es>Uno <!-- dos --> &lt;tres&gt; | Site</title><svg><title>no</title></svg>"
    )
    row = frame("h string", [(page,), ]).select(
        html.meta_content(F.col("h"), "og:title").alias("m"), html.title_text(F.col("h"), "Site").alias("t"),
        html.meta_content(F.col("h"), "og:url").alias("u"), html.visible_text(F.col("h")).alias("v"),
    ).first()
    assert (row.m, row.t, row.u) == ("it's > x & y", "Uno <!-- dos --> <tres>", None)
    assert frame("h string", [("<p>x",), (None,)]).select(html.title_text(F.col("h")).alias("t")).collect() == [(None,), (None,)]


def test_comments_go_and_marks_in_scripts_stay(frame):
    page = '<p title="<!-- a -->">x<!-- b --><script>"<!--"</script>y<!-->z<!---->w<!-- end'
    clean = frame("h string", [(page,)]).select(html.without_comments(F.col("h")).alias("c")).first().c
    assert clean == '<p title="<!-- a -->">x<script>"<!--"</script>yzw'


def test_review_with_a_comment_mark_is_kept(frame):
    page = script({**REVIEW, "claimReviewed": "<!-- c --> d"}) + "<!-- " + script({**REVIEW, "claimReviewed": "gone"}) + " -->"
    df = frame("url string, html string", [("u", page)])
    assert extract.structured_records(df).first().claim_reviewed == "<!-- c --> d"
    assert [r.types for r in jsonld.node_rows(df).collect()] == [["ClaimReview"], [], [], []]


def test_entities(frame):
    cases = {"&eacute;&ntilde;&hellip;": "éñ…", "a & b &; &amp;lt;": "a & b &; &lt;", "&#8364;&#x1F600;&#0;": "€😀&#0;", "&apos;&quot": "'&quot"}
    df = frame("t string", [(k,) for k in cases])
    for r in df.select("t", html.decode_entities(F.col("t")).alias("v")).collect():
        assert r.v == cases[r.t]


def urlset(*entries):
    return "<urlset>" + "".join(f"<url><loc>{loc}</loc>{f'<lastmod> {m} </lastmod>' if m else ''}</url>" for loc, m in entries) + "</urlset>"


def test_sitemap(frame, spark, tmp_path):
    index = "<x><sitemap><loc>c2</loc></sitemap><sitemap><loc>c1</loc></sitemap>" + urlset((" https://s/in/own ", "2020")) + "</x>"
    docs = frame("url string, xml string", [
        ("root", index),
        ("c1", urlset(("https://s/in/a", "late"), ("https://s/in/b?x=1&amp;y=2", None))),
        ("c2", urlset(("https://s/in/a", "early"), ("https://s/out/c", "2021"))),
        ("c3", urlset(("https://s/in/unlisted", None))),
    ])
    rows = {r.url: r.lastmod for r in sitemap_urls(docs, "root", "/in/").collect()}
    assert rows == {"https://s/in/own": "2020", "https://s/in/a": "early", "https://s/in/b?x=1&y=2": None}
    nothing = sitemap_urls(docs, "absent", "/in/")
    assert nothing.columns == ["url", "lastmod"] and nothing.isEmpty()
    (tmp_path / "s.xml").write_text(urlset((" https://s/in/a ", "m"), ("https://s/out", None), ("https://s/in/a", "earlier")))
    assert [tuple(r) for r in read_url_set(spark, str(tmp_path), "/in/").collect()] == [("https://s/in/a", "m")]


def test_key_collisions(frame):
    long = "https://s/" + "x" * 200
    df = frame("url string", [(long + "1",), (long + "2",), (long + "2",), ("https://s/a",)])
    assert [r.n_urls for r in key_collisions(df).collect()] == [2]


@pytest.mark.parametrize("levels", [10, 50_000])
def test_json_beyond_the_parsers_depth_is_walked(levels):
    _nested, block_nodes = jsonld._nested, jsonld.block_nodes

    body = '{"@type": "ClaimReview", "claimReviewed": "c\\u00e9 ]"}'
    text = '{"x": [1, ' * levels + body + "]} " * levels
    nodes = block_nodes(text)
    assert len(nodes) == levels + 1 and nodes[-1]["claim"] == "c\u00e9 ]"
    assert block_nodes(text + "]") == block_nodes(text[:-4]) == []
    for good in (' {"a": [], "b": {}, "c": [1.5e3, null, true, "x"]} ', "[]", '"s"', " 1 "):
        assert _nested(good) == json.loads(good)
    for bad in ("", "[1,]", '{"a" 1}', "{1: 2}", "[1 2]", '{"a": 1,}', "[}", "nul"):
        with pytest.raises(ValueError):
            _nested(bad)
