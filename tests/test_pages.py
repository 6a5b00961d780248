"""Page extraction on inline HTML."""

import pytest
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions import urls as U
from pagelens.operators import page_rows as P
from pagelens.operators import site as A
from pagelens.operators.page_signals import with_page_defaults

BRAND_PAGE = """<html><head><title>Example Brand - Home</title><meta property="og:site_name" content="Example Brand">
<script type="application/ld+json">{"@type":"Organization","name":"Example Brand","address":{"addressLocality":"Kaunas"}}</script></head>
<body><h1>Welcome to Example Brand</h1><h2>Our Products</h2><h3>Product A</h3><h3>Product B</h3>
<img src="/logo.jpg" alt="Example Brand Logo"><img src="/product.jpg" alt=""></body></html>"""


def test_brand_page(page):
    s = page(BRAND_PAGE)
    assert A.brand_name(s).collect()[0].brand == "Example Brand"
    assert {r.product for r in P.products(s).collect()} >= {
        "Welcome to Example Brand", "Our Products", "Product A", "Product B"}
    assert [r.type for r in P.jsonld_type_rows(s).collect()] == ["Organization"]
    assert [(r.src, r.issue) for r in P.alt_issues(s).collect()] == [("/product.jpg", "missing")]
    assert P.geo_signal_rows(s).count() == 0
    assert A.location(s).collect()[0].location == ""


def test_quoting_order_and_comments(page):
    r = page("""<!-- <title>no</title><h1>no</h1> --><HTML LANG='de'><head><TITLE> A &amp; B </TITLE>
      <meta content='D1' name="description"><link href=/c rel=canonical><link href='/lt' hreflang=lt rel='alternate'>
      </head><body><h1 class="x">T<b>wo</b></h1><script>var x = "<h1>no</h1></p>";</script><style>h1{}</style>
      <img alt=photo src=/a.png><img data-src="/b.png" alt='ok text'><noscript>hidden</noscript>Visible&nbsp;text""").collect()[0]
    assert (r.title, r.meta, r.lang, r.canonical) == ("A & B", "D1", "de", "/c")
    assert r.h1 == ["Two"]
    assert [(h.hreflang, h.href) for h in r.hreflang] == [("lt", "/lt")]
    assert [(i.src, i.alt) for i in r.images] == [("/a.png", "photo"), ("", "ok text")]
    assert "hidden" not in r.text and "Visible text" in r.text and "var x" not in r.text


def test_tag_ends_outside_of_quotes(page):
    r = page("""<title>Caf&eacute; &#8217;s &#x2014; &amp;lt; &nope; R&D &#0; &#xD800; &#1114112;</title>
      <img alt='a > b' src='/x.png'><a href='/a' title='1 > 2'>x <b data-q="</a>">y</b></a><h2 title="p > q">Head</h2>
      <p class="a > b">Para</p><p data=it's>don't</p><a href=/open title="never closed>z</a> end""").collect()[0]
    assert r.title == "Caf\u00e9 \u2019s \u2014 &lt; &nope; R&D \ufffd \ufffd \ufffd"
    assert [(i.src, i.alt) for i in r.images] == [("/x.png", "a > b")]
    assert (r.anchors[0].href, r.anchors[0].title) == ("/a", "1 > 2")
    assert r.anchors[1].href == "/open" and r.anchors[1].text == "z"
    assert r.h2 == ["Head"]
    assert r.text.endswith("Head Para don't z end") and ">" not in r.text


def test_very_long_tag_and_many_entities(page):
    r = page("<p " + "a='>' " * 40000 + ">in</p>" + "&eacute;" * 20000).collect()[0]
    assert r.text == "in " + "\u00e9" * 20000


def test_empty_and_missing_html(page, spark):
    s = page(None)
    r = s.collect()[0]
    assert (r.title, r.word_count, r.images, r.blocked) == ("", 0, [], True)
    want = spark.createDataFrame([("https://www.acme.lt/shop/blue-lamp",), ("https://x.lt/gone",)], "url string")
    rows = {x.url: x for x in with_page_defaults(want, s).collect()}
    assert rows["https://x.lt/gone"].title == "" and rows["https://x.lt/gone"].page_id is None


@pytest.mark.parametrize("base,href,want", [
    ("https://a.lt/x/y.html?q=1#f", "z.html", "https://a.lt/x/z.html"),
    ("https://a.lt/x/y.html", "/r", "https://a.lt/r"),
    ("https://a.lt/x/y.html", "//cdn.lt/q", "https://cdn.lt/q"),
    ("https://a.lt/x/y.html?q=1", "?p=2", "https://a.lt/x/y.html?p=2"),
    ("https://a.lt/x/y.html?q=1#f", "#top", "https://a.lt/x/y.html?q=1#top"),
    ("https://a.lt/x/y/z.html", "../up/./p.html?k=/../", "https://a.lt/x/up/p.html?k=/../"),
    ("https://a.lt", "b", "https://a.lt/b"),
    ("https://a.lt/x/", "../../../b", "https://a.lt/b"),
    ("https://a.lt/x/y", "..", "https://a.lt/"),
    ("https://a.lt/x", "mailto:a@b.c", "mailto:a@b.c"),
    ("https://a.lt/x", "http://b.lt/../c", "http://b.lt/../c"),
    ("https://a.lt/x?y", "", "https://a.lt/x?y"),
])
def test_resolve(spark, base, href, want):
    df = spark.createDataFrame([(base, href)], "b string, h string")
    assert df.select(U.resolve_url("b", "h").alias("u")).collect()[0].u == want


def test_url_columns(spark):
    rows = [("https://www.shop.co.uk/a-b/c-d",), ("http://x.y.de/1234567890",), ("https://cheap-pills.lt",), ("https://u:p@a.b.lt:80/p?q#f",)]
    df = spark.createDataFrame(rows, "u string")
    out = df.select(U.site_of("u").alias("s"), U.tld_country(U.host_of("u")).alias("c"), U.url_language("u").alias("l"),
                    U.slug_keyword("u").alias("k"), U.slug_is_poor("u").alias("p"), U.host_label("u").alias("b"),
                    U.host_of("u").alias("h"), U.brand_from_url("u").alias("bu")).collect()
    assert [r.s for r in out] == ["shop.co.uk", "y.de", "cheap-pills.lt", "b.lt"]
    assert [r.c for r in out] == ["", "Germany", "Lithuania", "Lithuania"]
    assert [r.l for r in out] == ["en", "de", "lt", "lt"]
    assert [r.k for r in out][:2] == ["c d", "1234567890"]
    assert [r.p for r in out] == [False, True, False, True]
    assert out[2].b == "Cheap-Pills" and out[3].h == "a.b.lt" and out[2].bu == "Cheap-pills"
    assert df.select(U.city_mention(F.lit("From Vilnius to Berlin")).alias("x")).collect()[0].x == "berlin"
    assert df.select(U.slugify(F.lit(" Blue  Lamp! -- žalia ")).alias("x")).collect()[0].x == "blue-lamp-alia"
    assert df.select(U.file_stem(F.lit("/img/big_red-car.v2.jpg?x=1")).alias("x")).collect()[0].x == "big red car.v2"


def test_link_modes(page):
    html = ('<a href="/a?x=1#t">x</a><a href="/a?x=1">y</a><a href="https://blog.acme.lt/b">z</a><a href="https://o.com/c.png">o</a>'
            '<a href="mailto:a@b.c">m</a><a href="/pic.jpg">p</a><a name="n">no href</a>')
    s = page(html)
    got = {(r.url, r.internal) for r in P.page_links(s).collect()}
    assert got == {("https://www.acme.lt/a?x=1", True), ("https://blog.acme.lt/b", True), ("https://o.com/c.png", False),
                   ("https://www.acme.lt/pic.jpg", True)}
    assert {r.url for r in P.page_links(s, "path_only").collect()} == {"https://www.acme.lt/a", "https://www.acme.lt/pic.jpg"}
    assert "https://www.acme.lt/pic.jpg" not in {r.url for r in P.page_links(s, "no_images").collect()}
    assert {r.url for r in P.page_links(s, "netloc").collect()} == {
        "https://www.acme.lt/a?x=1#t", "https://www.acme.lt/a?x=1", "https://www.acme.lt/pic.jpg"}


def test_faq_rules(page, spark):
    s = page("<h2>Kodėl mes?</h2><h2>Whatever</h2><p>Q: Where is it?</p><p>A: In Kaunas.</p><p>How much?<br>Ten euro.</p>"
             "<div>FAQ<h3>What is it</h3><ul><li>A thing</li></ul></div>")
    got = [(r.question, r.answer) for r in P.faq_headings(s).orderBy("pos").collect()]
    assert got[0] == ("Kodėl mes?", "")
    assert ("Where is it?", "In Kaunas.") in got and ("How much?", "Ten euro.") in got
    assert [(r.question, r.answer) for r in P.faq_sections(s).collect()] == [("What is it", "A thing")]
    nested = page("<div><section>Frequently asked<div><h3>What is it?</h3><p>A <b>lamp</b></p></div><div><h3>How?</h3><div><div>x</div>y</div></div></section></div>",
                  "<article>questions<h2>Why</h2>text<img src=a><p>z</p><h2>When</h2></article><p>out</p></div>",
                  "<section>FAQ<h4>Where?<i>now</i></h4><ul><li>a<li>b</section><div><h2>Who?</h2><p>no section</p></div>",
                  f"<div>Q&amp;A<h2>What &amp; why</h2><p title='a > b'>{'word ' * 60}</p></div><div>faq<h3>How open?</h3><p>left open", "<div>nothing</div>")
    assert sorted((r.page_id, r.question, r.answer) for r in P.faq_sections(nested).collect()) == [
        (0, "How?", "xy"), (0, "How?", "xy"), (0, "What is it?", "A lamp"), (0, "What is it?", "A lamp"),
        (2, "Where?now", "ab"), (3, "How open?", "left open"), (3, "What & why", ("word " * 60)[:200] + "...")]
    raw = spark.createDataFrame([(1, "s", "Why?\nBecause so\nNext line. When? Now\n\nEnd"), (2, "s", "No marks here")],
                                "page_id long, site string, text string")
    pairs = [(r.question, r.answer) for r in P.faq_text_pairs(raw, "sentence").collect()]
    assert pairs == [("Why", "Because so"), ("Next line. When", "Now")]


def test_local_business_and_nap(page):
    s = page('<title>Acme Lamps</title><script type="application/ld+json">[{"@type":["LocalBusiness","Store"],"name":"Acme",'
             '"telephone":"+370 600 12345","address":"12 Main street"}]</script><script type="application/ld+json">{bad</script>'
             '<p>12 Main street, Vilnius, LT 01234 tel. +370 600 12345</p>')
    r = P.nap(s).collect()[0]
    assert (r.schema_name, r.schema_address) == ("Acme", "12 Main street")
    assert r.text_address == "12 Main street, Vilnius, LT 01234 tel. +370 600 12345" and r.address == "street" and "600" in r.phone
    from pagelens.operators import checks as C

    n = C.nap_consistency(s).collect()[0]
    assert (n.consistency, n.is_consistent) == (100, True)


@pytest.mark.parametrize("word,stem", [
    ("fundamentally", "fundament"), ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"),
    ("plastered", "plaster"), ("motoring", "motor"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"),
    ("vietnamization", "vietnam"), ("hopefulness", "hope"), ("adjustable", "adjust"), ("probate", "probat"), ("rate", "rate"),
    ("controll", "control"), ("yes", "ye"), ("is", "is"), ("conflated", "conflat"), ("hopping", "hopp"), ("filing", "file"),
])
def test_stem(spark, word, stem):
    df = spark.createDataFrame([(word,)], "w string")
    assert T.with_stem(df, "w").collect()[0].stem == stem


def test_small_text_columns(spark):
    df = spark.createDataFrame([("aXbXXc", "X"), ("abc", ""), (" a  b ", "a")], "s string, p string")
    assert [r.n for r in df.select(T.count_substring("s", "p").alias("n")).collect()] == [3, 0, 1]
    assert df.select(T.shorten(F.lit("abcdef  xyz"), 9).alias("x")).collect()[0].x == "abcdef..."
    assert [r.n for r in df.select(T.word_count("s").alias("n")).collect()] == [1, 1, 2]
    one = df.limit(1)
    assert one.select(T.ngrams(F.array(F.lit("a")), 2).alias("g")).collect()[0].g == []
    assert one.select(T.capitalised_names(F.lit("Éric met Blue  Lamp, Acme9 and New York.")).alias("g")).collect()[0].g == [
        "Blue Lamp", "New York"]
    assert one.select(T.marker_language(F.lit("kaip ir kada")).alias("g")).collect()[0].g == "lt"


def test_text_variants(page):
    s = page("<p>Lamp Alpha vs Beta, compared to Gamma. Better than all. Versus none</p>")
    assert {r.competitor for r in P.competitor_phrases(s, "after").collect()} == {"beta", "gamma", "all"}
    assert [r.competitor for r in P.competitor_phrases(s, "next").collect()] == ["Beta,", "to", "none"]


def test_platform_and_blocked(page):
    s = page("<link href='/wp-content/x.css'><p>Attention Required | Cloudflare</p>" + "x" * 600, "x" * 300)
    rows = {r.page_id: r for r in s.select("page_id", "blocked", "blocked_strict").collect()}
    assert (rows[0].blocked, rows[0].blocked_strict) == (True, False)
    assert (rows[1].blocked, rows[1].blocked_strict) == (False, True)
    assert A.platform(s).collect()[0].platform == "wordpress"
