"""Checks and scores: a page that passes everything, one that fails everything, and every boundary."""

import pytest
from pyspark.sql import functions as F

from pagelens.operators import checks as C
from pagelens.operators import site as A

WORDS = " ".join(f"word{i}" for i in range(640))
PERFECT = f"""<html lang="lt"><head><title>Lamps and reviews from Vilnius for you</title>
<meta name="description" content="{'What makes our Vilnius lamps the best local service? Reviews tell. ' + 'x' * 87}?">
<meta name="viewport" content="w"><meta name="robots" content="index"><link rel="canonical" href="/c">
<link rel="alternate" hreflang="lt" href="/lt"><link rel="alternate" hreflang="en" href="/en">
<meta property="og:title" content="t"><meta property="og:description" content="d"><meta property="og:image" content="i">
<meta name="geo.region" content="LT"><meta name="geo.position" content="1"><meta name="geo.placename" content="V">
<script type="application/ld+json">{{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[]}}</script>
<script type="application/ld+json">{{"@context":"https://schema.org","@type":"LocalBusiness","name":"Lamps","telephone":"+370 600 12345","address":"Main street"}}</script>
<script type="application/ld+json">{{"@context":"https://schema.org","@type":"Article"}}</script>
<script type="application/ld+json">{{"@context":"https://schema.org","@type":"Organization"}}</script></head>
<body><h1>Lamps</h1><h2>What is it?</h2><h2>How to buy?</h2><ul><li>1. a</li></ul><a href="/1" title="t">one</a><a href="/2" title="t">two</a>
<a href="/3" title="t">three</a><img src="/a.png" alt="a lamp" width="1" height="1" loading="lazy">
<div>FAQ<h3>Why?</h3><p>Because.</p><h3>When?</h3><p>Now.</p></div>
<p>12 Main street, Vilnius, LT 01234 tel. +370 600 12345</p><iframe src="https://www.google.com/maps/embed"></iframe>
<p>local service what is how to - {WORDS}</p></body></html>"""
FAILING = "<html><head></head><body><img src='/x.png'><p>x</p></body></html>"


def points(df, scheme):
    return {(r.pillar, r.check): (r.points, r.max_points, r.task) for r in C.check_rows(df, scheme).collect()}


@pytest.mark.parametrize("scheme", ["pillars", "answers", "breakdown"])
def test_points_within_maximum_and_sums(page, scheme):
    s = page(PERFECT, FAILING)
    rows = C.check_rows(s, scheme)
    assert rows.where("points > max_points or points < 0").count() == 0
    sums = {(r.page_id, r.pillar): r.p for r in rows.groupBy("page_id", "pillar").agg(F.sum("points").alias("p")).collect()}
    pts = C.page_points(s, scheme)
    for r in pts.collect():
        for name in [n for n in pts.columns if n.startswith("points_")]:
            assert sums[(r.page_id, name[7:])] == r[name]


def test_perfect_page(page):
    s = page(PERFECT)
    got = points(s, "pillars")
    lost = {k for k, v in got.items() if v[0] < v[1]}
    assert lost == {("AEO", "reviews")}  # reviews are looked up in keywords and warnings only
    got = points(s, "answers")
    assert {k for k, v in got.items() if v[0] < v[1]} == set()
    assert got[("GEO", "hreflang")][0] == 25
    r = A.answer_scores(s).collect()[0]
    assert (r.aeo, r.geo, r.overall) == (100, 100, 100.0)
    b = C.page_breakdown(s).collect()[0]
    assert b.aeo_present == 6 and b.geo_present == 5


def test_failing_page(page):
    s = page(FAILING, )
    s = s.withColumn("url", F.lit("http://x.com/p")).withColumn("host", F.lit("x.com"))
    got = points(s, "pillars")
    passed = {k for k, v in got.items() if v[0] == v[1]}
    assert passed == {("SEO", "viewport"), ("TECH", "broken"), ("TECH", "indexable")}
    got = points(s, "answers")
    assert sum(v[0] for k, v in got.items() if k[0] == "AEO") == 5  # one image without text still gets 5


def test_weighted_score_by_hand(page):
    s = page(PERFECT, FAILING)
    r = A.pillar_scores(s).collect()[0]
    rows = C.page_points(s, "pillars").select("word_count", "points_TECH", "points_SEO").collect()
    w = [max(x.word_count, 1) for x in rows]
    tech = round(100.0 * sum(x.points_TECH * k for x, k in zip(rows, w)) / (20 * sum(w)))
    seo = min(100, round(100.0 * sum(x.points_SEO * k for x, k in zip(rows, w)) / (40 * sum(w))))
    assert (r.technical, r.seo) == (tech, seo)


@pytest.mark.parametrize("n,ok", [(1, True), (60, True), (61, False)])
def test_title_boundary(page, n, ok):
    assert (points(page(f"<title>{'t' * n}</title>"), "pillars")[("SEO", "title")][0] == 5) is ok


@pytest.mark.parametrize("n,seo,exact", [(49, 0, 0), (50, 5, 0), (149, 5, 0), (150, 5, 10), (160, 5, 10), (161, 0, 0)])
def test_meta_boundary(page, n, seo, exact):
    s = page(f'<meta name="description" content="{"d" * n}">')
    assert points(s, "pillars")[("SEO", "meta")][0] == seo
    assert points(s, "answers")[("AEO", "meta_length")][0] == exact


@pytest.mark.parametrize("n,seo,aeo", [(499, 0, 0), (500, 5, 0), (599, 5, 0), (600, 5, 5)])
def test_word_boundary(page, n, seo, aeo):
    s = page("<h1>h</h1><p>" + " ".join(["w"] * (n - 1)) + "</p>")
    got = points(s, "pillars")
    assert (got[("SEO", "words")][0], got[("AEO", "answers")][0]) == (seo, aeo)


@pytest.mark.parametrize("with_alt,total,want", [(0, 0, 15), (69, 100, 5), (70, 100, 10), (89, 100, 10), (90, 100, 15)])
def test_alt_boundary(page, with_alt, total, want):
    s = page("<img src=a alt='some'>" * with_alt + "<img src=a>" * (total - with_alt) + "<p>x</p>")
    assert points(s, "answers")[("AEO", "alt_text")][0] == want


def test_result_does_not_depend_on_partitions(page):
    s = page(PERFECT, FAILING, PERFECT.replace("Lamps", "Desks"))
    a = A.pillar_scores(s).collect()
    b = A.pillar_scores(s.repartition(5).orderBy(F.desc("page_id"))).collect()
    assert a == b


def test_site_health(spark):
    df = spark.createDataFrame([("a", True, True, True, 573, True, False), ("b", False, False, False, 0, False, True)],
                               "site string, llms_txt boolean, robots_txt boolean, ssl boolean, page_speed_ms int, mobile_friendly boolean, structured_data boolean")
    rows = C.site_health(df).collect()
    assert sum(r.site == "a" and r.kind == "good" for r in rows) == 5
    assert [r.message for r in rows if r.site == "b"] == ["llms.txt file not found", "Structured data found"]


def test_language_and_industry(page):
    s = page("<title>Das ist nicht die Lampe und der Tisch</title>", "<title>Buy in our shop</title><h1>cart price</h1>")
    assert {r.language for r in A.page_languages(s).collect()} >= {"de"}
    assert A.industry_best(s).collect()[0].industry == "ecommerce"
