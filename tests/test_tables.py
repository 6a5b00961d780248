"""Links, robots, sitemaps, CMS pages, replies, sessions, sinks, streams, skewed keys."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from pagelens.functions.exprs import blank_to_null
from pagelens.operators import domains as D
from pagelens.operators import grams as GR
from pagelens.operators import languages as LG
from pagelens.operators import links as G
from pagelens.operators import page_rows as P
from pagelens.operators import recommend as R
from pagelens.operators import sessions as SE
from pagelens.operators import skew
from pagelens.operators import visibility as V
from pagelens.plans import jobs as JB
from pagelens.sources import io
from pagelens.streaming import stream as ST

ROBOTS = "# c\n\nUser-agent: *\nDisallow: /\nDisallow: /private\nDisallow: /*/print\nDisallow:\nSitemap: https://a.lt/s.xml\n"


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def test_robots(spark):
    r = spark.createDataFrame([("a.lt", ROBOTS), ("b.lt", "User-agent: Other\nUser-agent: GPTBot\nDisallow: /\n"),
                               ("c.lt", "User-agent: GPTBot\nDisallow: /x\nUser-agent: Other\nDisallow: /\n")], "host string, raw string")
    rules = io.robots_rules(r)
    assert [(x.kind, x.value) for x in rules.where("host='a.lt'").orderBy("line").collect()] == [
        ("disallow", "/"), ("disallow", "/private"), ("disallow", "/*/print"), ("disallow", ""), ("sitemap", "https://a.lt/s.xml")]
    pages = spark.createDataFrame(
        [(1, "https://a.lt/private/x"), (2, "https://a.lt/p/print"), (3, "https://a.lt/p/print/2"), (4, "https://a.lt"), (5, "https://z.lt/private")],
        "page_id long, url string")
    assert {x.page_id for x in G.robots_blocked(pages, rules).collect()} == {1, 2}
    assert {x.host: x.ai_allowed for x in io.ai_crawler_access(r).collect()} == {"a.lt": True, "b.lt": False, "c.lt": True}


def test_sitemaps(spark):
    ns = '<urlset xmlns="http://www.sitemaps.org"><url><loc>\n https://a.lt/1#f </loc></url><url><loc>https://b.lt/2</loc></url>'
    rows = [("a.lt", "/sitemap_index.xml", "<loc>https://a.lt/index-only</loc>"), ("a.lt", "/sitemap.xml", ns), ("a.lt", "/list.txt", "https://a.lt/3\n\n/4\r\n"),
            ("c.lt", "/sitemap.xml", "<broken"), ("c.lt", "/sitemap_index.xml", "<s:loc>https://c.lt/5</s:loc>")]
    got = {r.url for r in io.sitemap_urls(spark.createDataFrame(rows, "host string, path string, body string")).collect()}
    assert got == {"https://a.lt/1", "https://a.lt/3", "https://a.lt/4", "https://c.lt/5"}


def test_crawl_graph_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    n = 60
    pairs = sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(90)} | {(0, i) for i in range(1, 20)})
    url = lambda i: f"https://a.lt/{i:03d}"
    edges = spark.createDataFrame([("a.lt", a, url(a), url(b), True) for a, b in pairs],
                                  "site string, src_page_id long, src_url string, dst_url string, internal boolean")
    seeds = spark.createDataFrame([("a.lt", url(0))], "site string, url string")
    depth, level, d = {0: 0}, [0], 0
    while level:
        d += 1
        level = sorted({b for a, b in pairs if a in set(level)} - set(depth))
        depth.update({b: d for b in level})
    got = {r.url: r.depth for r in G.crawl_depth(edges, seeds, max_pages=1000).collect()}
    assert got == {url(i): k for i, k in depth.items()}
    capped = G.crawl_depth(edges, seeds, max_pages=10).collect()
    assert len(capped) == 10 and {r.url for r in capped} == {url(i) for i in range(10)}
    chain = spark.createDataFrame([("a.lt", i, url(i), url(i + 1), True) for i in range(70)], edges.schema)
    assert {r.url: r.depth for r in G.crawl_depth(chain, seeds, max_pages=None).collect()} == {url(i): i for i in range(71)}


def test_frontier_and_broken(spark):
    edges = spark.createDataFrame(
        [("s", 1, "u1", "https://s/sitemap", True), ("s", 1, "u1", "https://s/a", True), ("s", 2, "u2", "https://s/b", True),
         ("s", 2, "u2", "https://s/a", True), ("s", 2, "u2", "https://o/x", False)],
        "site string, src_page_id long, src_url string, dst_url string, internal boolean")
    seen = spark.createDataFrame([("s", "https://s/b")], "site string, url string")
    got = [r.url for r in G.frontier(edges, seen, 10).orderBy("rank").collect()]
    assert got == ["https://s/a", "https://s/sitemap"]
    assert [r.url for r in G.frontier(edges, seen, 2).collect()] == ["https://s/a"]
    st = spark.createDataFrame([("https://s/a", 404), ("https://s/b", 301), ("https://o/x", 500), ("https://s/sitemap", None)], "url string, status int")
    assert [(r.dst_url, r.status) for r in G.broken_links(edges, st).collect()] == [("https://s/a", 404)]
    assert {r.src_page_id: r.n_broken for r in G.page_broken_links(edges, st).collect()} == {1: 1, 2: 1}


def test_cms(spark):
    cms = spark.createDataFrame([(1, "https://a.lt/x", "", "c1"), (2, "", "about", "c2"), (3, "", "out", "c3"), (4, "", "", "c4")],
                                "cms_id long, link string, slug string, content string")
    sug = spark.createDataFrame([("https://a.lt/x", "T", "", "H", [("q", "a")]), ("https://a.lt/about", "T", "M", "", []), ("https://a.lt/none", "T", "", "", [])],
                                "url string, new_title string, new_meta string, new_h1 string, faq array<struct<q:string,a:string>>")
    assert {r.url: r.cms_id for r in G.cms_match(sug, cms).collect()} == {"https://a.lt/x": 1, "https://a.lt/about": 2}
    out = JB.cms_updates(sug, cms)
    rows = {r.url: r for r in out["payload"].collect()}
    assert rows["https://a.lt/x"].content.startswith("<h1>H</h1>\nc1\n<div class=\"faq-section\">")
    assert rows["https://a.lt/about"].content is None and rows["https://a.lt/about"].meta_description == "M"
    assert [r.url for r in out["unmatched"].collect()] == ["https://a.lt/none"]


def test_replies(spark):
    rows = [(1, '["a","b"]'), (2, '```json\n["a","b"]\n```'), (3, '["a"]'), (4, "{broken"), (5, ""), (6, None)]
    df = io.ingest_replies(spark.createDataFrame(rows, "id long, raw string"), "array<string>", length=2)
    assert {r.id: r.valid for r in df.collect()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}


def test_answers(spark):
    rows = [("s", 1, "brand", "Blue Lamp", "Blue Lamp is best. blue lamp wins. Alternatives: Red Desk, Acme Inc and others"),
            ("s", 2, "competitor", "Blue Lamp", "A blue chair"), ("s", 3, "odd", "Blue Lamp", "nothing here"),
            ("s", 4, "brand", "One Two Three Four", "one two and three only"), ("s", 5, "brand", "", "text")]
    a = spark.createDataFrame(rows, "site string, query_id long, category string, brand string, response string")
    e = {r.query_id: r for r in V.evaluate_answers(a).collect()}
    assert [e[i].strength for i in (1, 2, 3)] == ["Strong", "Weak", "None"]
    assert e[1].competitors == ["Acme Inc", "Alternatives", "Red Desk"]
    assert e[1].recommendation == "One of many" and e[2].recommendation == "Not mentioned"
    f = {r.query_id: r.m for r in a.select("query_id", V.brand_mentioned_fuzzy("response", "brand").alias("m")).collect()}
    assert (f[1], f[2], f[4]) == (True, False, True)
    s = V.visibility_summary(V.evaluate_answers(a.where("query_id < 4"))).collect()[0]
    assert (s.visibility_score, s.total_weight) == (75.0, 4.0)
    assert (s.share_of_ai_voice, s.strength_score) == (40.0, 2.0)


def test_templates(spark):
    p = spark.createDataFrame([("a", "Acme", None, "", "retail", ["Lamp"], "Bolt"), ("b", "Bee", None, "Kaunas", "food", [], "")],
                              "site string, brand string, product string, location string, industry string, products array<string>, competitor string")
    q = R.fallback_queries(p)
    assert q.groupBy("site").count().where("count != 20").count() == 0
    assert {r.text for r in q.where("site='a' and query_id in (13, 5)").collect()} == {"What are the benefits of services?", "Best services for businesses"}
    k = R.keyword_ideas(p, "AEO").where("site='a'").orderBy("kind", "rank").collect()
    assert [r.text for r in k if r.kind == "keyword"] == ["what is Acme", "how does Acme work", "best Lamp", "Lamp guide", "how to solve retail problems"]
    assert [r.text for r in k if r.kind == "question"][-2:] == ["What makes Acme better than Bolt?", "What are the common retail challenges?"]
    own = spark.createDataFrame([("a", 0, "mine")], "site string, pos int, text string")
    assert R.custom_queries(q.where("query_id <= 19"), own).where("category='custom'").collect()[0].query_id == 20
    assert R.custom_queries(q, own).where("category='custom'").count() == 0
    m = spark.createDataFrame([("Our service",), ("All about us",), ("x" * 170 + "?",), ("",)], "m string")
    got = [r.o for r in m.select(R.optimize_meta(F.col("m")).alias("o")).collect()]
    assert got == ["What services do we offer? Our service", "What is all  us?", "x" * 157 + "...", ""]


def test_sessions(spark):
    now = dt.datetime(2024, 3, 1)
    ago = lambda **k: now - dt.timedelta(**k)
    rows = [("1", "s", "started", "website", ago(hours=23), None), ("2", "s", "started", "site_health", ago(hours=25), None), ("3", "s", "completed", "finishing", ago(days=2), ago(days=1)),
            ("4", "s", "started", "odd", ago(days=30), None), ("5", "s", "started", "website", ago(days=31), None), ("6", "t", "started", "unknown", ago(days=8), None)]
    s = spark.createDataFrame(rows, "id string, site_id string, status string, current_step string, created_at timestamp, completed_at timestamp").withColumn("updated_at", F.col("created_at"))
    f = SE.funnel(s, "2024-03-01 00:00:00").collect()
    assert [(r.current_step, r.sessions, r.percentage) for r in f] == [("website", 1, 25.0), ("site_health", 1, 25.0), ("finishing", 1, 25.0), ("unknown", 1, 25.0)]
    assert {r.id for r in SE.abandoned(s, "2024-03-01 00:00:00").collect()} == {"2", "4", "5", "6"}
    m = SE.completion_metrics(s).collect()[0]
    assert (m.total_started, m.total_completed, m.avg_minutes_to_complete) == (6, 1, 1440.0)
    assert SE.avg_time_to_complete(s).collect()[0].avg_seconds == 86400.0
    assert {r.id for r in SE.retention_cleanup(s, "2024-03-01 00:00:00").collect()} == {"1", "2", "3"}
    assert [r.id for r in SE.sessions_for_site(s, "t").collect()] == ["6"]
    assert SE.current_step(s, "3").collect()[0].current_step == "finishing"
    assert [r.id for r in SE.completed_desc(s).collect()] == ["3"]


def test_sinks(spark, tmp):
    sites = spark.createDataFrame([("a", "A"), ("b", "B")], "site string, brand string")
    pages = spark.createDataFrame([("a", 1)], "site string, page_id long")
    audits = spark.createDataFrame([("a", "x")], "site string, value string")
    io.write_audit(sites, pages, audits, tmp)
    io.write_audit(sites.unionByName(spark.createDataFrame([("c", "C")], "site string, brand string")), pages, audits, tmp)
    assert sorted(r.site for r in spark.read.parquet(f"{tmp}/sites").collect()) == ["a", "b", "c"]
    assert spark.read.parquet(f"{tmp}/pages").count() == 2
    io.write_scores(audits, tmp), io.write_optimizations(audits, tmp), io.write_answers(audits, tmp)
    io.write_json(audits, f"{tmp}/json")
    assert spark.read.json(f"{tmp}/json").count() == 1
    body = spark.createDataFrame([(1, "u", "<p>")], "page_id long, url string, body string")
    body.write.parquet(f"{tmp}/raw")
    assert io.read_pages(spark, f"{tmp}/raw").collect()[0].html == "<p>"


def test_jobs(spark, page, tmp):
    html = "<title>Acme shop</title><h1>Lamps</h1><a href='/a'>a</a><h2>What is it?</h2>"
    pages = spark.createDataFrame([(i, f"https://a.lt/{'product' if i % 2 else 'contact'}/{i}", html) for i in range(6)], "page_id long, url string, html string")
    out = JB.audit_sites(pages, tmp)
    assert out["profile"].collect()[0].brand == "Acme shop" and out["signals"].where("kind='product'").count() == 2
    robots = spark.createDataFrame([("a.lt", "Disallow: /product")], "host string, raw string")
    status = spark.createDataFrame([("https://a.lt/a", 404)], "url string, status int")
    full = JB.audit_full(pages, robots, status)
    r = full["rollup"].collect()[0]
    assert (r.pages, r.pages_blocked_by_robots) == (6, 3)
    assert full["pages"].where("n_broken = 1").count() == 6
    geo = JB.audit_aeo_geo(pages)
    assert geo["scores"].collect()[0].pages == 6 and geo["recommendations"].count() > 0
    assert JB.audit_page(pages)["recommendations"].count() > 0
    s = page(html, html)
    assert JB.score_sites(s).count() == 1 and JB.optimize_sites(s, 1).count() == 1
    assert JB.site_context(s).where("kind='faq_topic'").count() == 1
    prof = JB.profile_for_keywords(s)
    assert JB.recommend_keywords(prof).select("mode").distinct().count() == 2
    vis = JB.brand_page_visibility(s, spark.createDataFrame([("acme.lt", "Acme")], "site string, brand string"))
    assert vis["queries"].count() == 10 and vis["advice"].count() > 0
    q = spark.createDataFrame([("s", 1, "brand", "t"), ("s", 2, "brand", "t")], "site string, query_id long, category string, text string")
    a = spark.createDataFrame([("s", 1, "B", "B is best"), ("s", 2, "B", "no")], "site string, query_id long, brand string, response string")
    q, a = (df.unionByName(df.withColumn("site", F.lit("t"))) for df in (q, a))
    ch = spark.createDataFrame([("s", 1), ("t", 1), ("t", 9)], "site string, query_id long")
    qv = JB.query_visibility(q, a, ch)  # site t chose a query that does not exist and gets the error alone
    assert [(r.site, r.query_id) for r in qv["answers"].collect()] == [("s", 1)]
    assert [(r.site, r.error) for r in qv["errors"].collect()] == [("t", "Some selected queries not found")]


def test_record_of_an_audit_is_stored_once(spark, tmp):
    pages = spark.createDataFrame([(i, f"https://a.lt/{'shop' if i % 2 else 'p'}/{i}", f"<title>T{i}</title><a href='/x{i % 3}'>x</a><a href='https://b.lt/x0'>o</a>") for i in range(12)],
                                  "page_id long, url string, html string")
    robots = spark.createDataFrame([("a.lt", "Disallow: /shop\nDisallow: /*7\nDisallow: /")], "host string, raw string")
    status = spark.createDataFrame([("https://a.lt/x0", 404), ("https://a.lt/x1", 500), ("https://b.lt/x0", 404), ("https://a.lt/x2", 200)], "url string, status int")
    for _ in range(2):  # a second run gives the same
        record = JB.stored_record(pages, "audit_of_test", robots, status, buckets=4, folder=tmp)
        assert sorted((r.page_id, r.n_broken, r.blocked_by_robots) for r in record.collect()) == [(i, int(i % 3 < 2), i % 2 == 1) for i in range(12)]
    narrow = JB.audited_record(spark, "audit_of_test").select("page_id", "n_broken", "title")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    out = JB.score_audit(record, status)
    r = out["rollup"].collect()[0]
    assert (r.pages, r.pages_blocked_by_robots, r.broken_unique) == (12, 6, 2)
    found = {(x.check, x.present): x.n for x in out["checks"].where("pillar = 'TECH'").groupBy("check", "present").agg(F.count("*").alias("n")).collect()}
    assert found[("broken", True)] == 4 and found[("broken", False)] == 8 and found[("indexable", True)] == 6 and found[("indexable", False)] == 6
    assert out["scores"].collect()[0].technical < JB.score_audit(JB.stored_record(pages, "audit_of_test", folder=tmp), status)["scores"].collect()[0].technical


def test_many_robots_rules_of_one_host(spark):
    rules = spark.range(100_000).select(F.lit("a.lt").alias("host"), F.lit("disallow").alias("kind"), F.concat(F.lit("/d"), F.col("id"), F.lit("/")).alias("value"))
    rules = rules.unionByName(spark.createDataFrame([("a.lt", "disallow", "/*.pdf"), ("a.lt", "disallow", "/"), ("b.lt", "disallow", "/q*"), ("a.lt", "allow", "/d5/")], rules.schema))
    urls = ["https://a.lt/d99999/x", "https://a.lt/d100000/x", "https://a.lt/d7/a.pdf", "https://a.lt/z/b.pdf?x", "https://b.lt/qa", "https://b.lt/d5/", "https://a.lt", "https://a.lt/d7"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert sorted(r.page_id for r in G.robots_blocked(pages, rules).collect()) == [0, 2, 3, 4]


def test_public_suffixes(spark):
    lines = ["// list", "", "com", "uk", "co.uk  ", "*.ck", "!www.ck", "GitHub.io", ".lt", "*.x.y"]
    rules = D.suffix_rules(spark.createDataFrame([(x,) for x in lines], "line string"))
    hosts = {"a.b.co.uk": "b.co.uk", "co.uk": None, "uk": None, "b.uk": "b.uk", "a.b.c.ck": "b.c.ck", "c.ck": None, "ck": None, "www.ck": "www.ck", "z.www.ck": "www.ck",
             "me.github.io": "me.github.io", "p.me.github.io": "me.github.io", "github.io": None, "w.acme.lt": "acme.lt", "A.Acme.LT.": "acme.lt", "q.unknown": "q.unknown",
             "localhost": None, "10.0.0.1": "10.0.0.1", "": None, "a.b.x.y": "a.b.x.y", "b.x.y": None}
    df = spark.createDataFrame([(h, 1) for h in [*hosts, None, "uk"]], "host string, suffix int")
    assert {r.host: r.domain for r in D.registrable_domains(df, rules).collect()} == hosts
    assert D.registrable_domains(df.limit(0), rules).collect() == []
    assert {r.domain for r in D.registrable_domains(df.where("host = 'a.b.co.uk'"), rules.limit(0)).collect()} == {"co.uk"}


def test_sites_and_links_by_suffix(spark, page):
    s = page("<a href='https://b.co.uk/x'>1</a><a href='https://z.a.co.uk/y'>2</a><a href='/w'>3</a>", url="https://www.a.co.uk/p")
    rules = D.suffix_rules(spark.createDataFrame([("co.uk",), ("uk",)], "line string"))
    assert {(r.dst_url, r.internal) for r in D.edges_by_domain(s, rules).collect()} == {("https://b.co.uk/x", False), ("https://z.a.co.uk/y", True), ("https://www.a.co.uk/w", True)}
    assert [r.site for r in D.pages_by_domain(s, rules).collect()] == ["a.co.uk"] and D.pages_by_domain(s, rules).columns == s.columns


def test_languages_by_profiles(spark):
    labelled = [("en", "the house and the river"), ("en", "then there was the other one"), ("de", "der Fluss und das Haus"), ("de", "dann war noch der andere da"), (None, "zzz"), ("xx", "123"), ("de", None)]
    profiles = LG.language_profiles(spark.createDataFrame(labelled, "lang string, text string"))
    assert {r.lang for r in profiles.select("lang").distinct().collect()} == {"en", "de"}
    texts = [(1, "the river and the other house, then"), (2, "UND DER ANDERE FLUSS; das Haus und der"), (3, "the"), (4, None), (5, "12 34"), (None, "the the the the the the the"),
             (6, "qqqqqqqqqqqqqqqqqqqqqqqqqq"), (7, "the river"), (7, "the other house and the river")]
    got = {r.k: r.lang_found for r in LG.detect_languages(spark.createDataFrame(texts, "k long, text string"), profiles, "k").collect()}
    assert got == {1: "en", 2: "de", 3: None, 4: None, 5: None, 6: got[6], 7: "en"} and got[6] in ("en", "de")


def test_streams_equal_batch(spark, tmp):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.repartition(4).write.parquet(f"{tmp}/ev")

    marks = {}

    def drain(df, name):
        q = df.writeStream.format("parquet").option("checkpointLocation", f"{tmp}/{name}-state").trigger(availableNow=True).start(f"{tmp}/{name}")
        q.awaitTermination()
        marks[name] = q.lastProgress["eventTime"].get("watermark")
        return spark.read.schema(df.schema).parquet(f"{tmp}/{name}")

    src = ST.read_stream(spark, f"{tmp}/ev", ev.schema)
    closed = drain(ST.stream_funnel(src), "funnel")
    rows = closed.unionByName(ST.still_open(ST.stream_funnel(ev), "window_end", marks["funnel"])).collect()
    got = {(r.window_start, r.event_type): r.n for r in rows}
    assert len(got) == len(rows) and sum(got.values()) == ev.count()
    sessions = drain(ST.stream_sessions(src), "sessions")
    sessions = sessions.unionByName(ST.still_open(ST.stream_sessions(ev), "session_end", marks["sessions"]))
    assert sessions.agg(F.sum("n")).first()[0] == ev.count()
    want = {(r.h, r.event_type): r["count"] for r in ev.groupBy(F.date_trunc("hour", "ts").alias("h"), "event_type").count().collect()}
    assert got == want
    sliding = drain(ST.stream_funnel(src, slide="30 minutes"), "sliding")
    assert sliding.count() > closed.count()
    html = "<title>T</title><h1>H</h1>"
    pages = spark.createDataFrame([(i, f"https://a.lt/{i}", html) for i in range(5)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp}/pg")
    from pagelens.operators import checks as C
    from pagelens.operators.page_signals import page_signals

    st = drain(ST.stream_page_audit(ST.read_stream(spark, f"{tmp}/pg", pages.schema)), "audit")
    key = ["page_id", "pillar", "check", "points"]
    assert sorted(st.select(*key).collect()) == sorted(C.check_rows(page_signals(pages), "pillars").select(*key).collect())


def test_skewed_keys_stay_whole(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"))
    look = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = skew.salted_lookup(rows, look, ["k"], "id")
    assert out.count() == 3000 and out.where("k = 'hot' and n = 1000").count() == 1000
    dup = GR.duplicate_pages(rows, "k", "id")
    assert dup.count() == 1000 and dup.select("copies").distinct().collect()[0].copies == 1000


def test_word_statistics(spark):
    t = spark.createDataFrame([(1, "a", "Cats and cat run, running runs"), (2, "a", "cat cats"), (3, "b", "one")], "page_id long, site string, text string")
    got = {(r.site, r.stem): (r.word, r.n) for r in GR.stem_counts(t, "site", "page_id", stop_words=["and"]).collect()}
    assert got[("a", "cat")] == ("cats", 4)
    assert {r.gram: r.n for r in GR.gram_counts(t, "site", 2).where("site='a'").collect()}["cat run"] == 1
    assert GR.token_counts(t, "site", stop_words=GR.default_stop_words()).where("token='and'").count() == 0
    assert GR.site_keywords(t, "site", "page_id", more_than=3).collect()[0].gram == "cat"


def test_performance_hints_with_bytes(spark, page):
    s = page("<img src='/a.png' width=1 height=2 loading=lazy><img src='/b.png'>")
    b = spark.createDataFrame([("https://www.acme.lt/a.png", 10), ("https://www.acme.lt/b.png", 5)], "src string, bytes long")
    r = P.performance_hints(s, b).collect()[0]
    assert (r.n_images, r.images_lazy, r.images_no_dimensions, r.image_bytes) == (2, 1, 1, 15)
    assert spark.range(1).select(blank_to_null(F.lit("")).alias("x")).collect()[0].x is None


def test_reply_with_list_in_prose(spark):
    raw = spark.createDataFrame([('Here: ["a","b"] ok',), ('x {"k": [1]} y',), ("no",)], "raw string")
    assert [r[0] for r in raw.select(io.parse_reply(F.col("raw"), F.lit("[]"))).collect()] == ['["a","b"]', '{"k": [1]}', "[]"]


def test_refused_selection_has_no_queries(spark):
    q = spark.createDataFrame([(s, i) for s in ("a", "b", "d") for i in range(12)], "site string, query_id int")
    chosen = q.where("(site = 'a' AND query_id < 8) OR (site = 'b' AND query_id < 9)").union(spark.createDataFrame([("d", 1), ("d", 99)], q.schema))
    picked, errors = V.select_queries(q, chosen)
    assert {r.site for r in errors.collect()} == {"b", "d"} and [r.site for r in picked.collect()] == ["a"] * 8
