"""Rules of round 3: results whose plans are easily rewritten wrongly, and plans that must stay cheap on large tables."""

import datetime as dt
import time

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import TimerValues

from catalog.scores import host_signals as HOSTS
from pagelens.functions import html as H
from pagelens.operators import checks as C
from pagelens.operators import grams as GR
from pagelens.operators import languages as LG
from pagelens.operators import page_rows as P
from pagelens.operators import page_signals as PS
from pagelens.operators import site as A
from pagelens.plans import jobs as JB
from pagelens.sources import io
from pagelens.streaming import stream as ST


def exchanges(df, text):
    """Lines of the plan that shuffle by ``text``."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange " + text in x]


def test_open_sessions_keep_their_earlier_events(spark):
    """A filter on the end of sessions must not reach their events."""
    at = [dt.datetime(2024, 1, 30, 22, 22), dt.datetime(2024, 1, 30, 22, 33), dt.datetime(2024, 1, 30, 23, 59)]
    events = spark.createDataFrame([(1, at[0]), (1, at[1]), (2, at[2])], "user_id long, ts timestamp")
    rows = ST.still_open(ST.stream_sessions(events), "session_end", "2024-01-30T22:59:25Z")
    half = dt.timedelta(minutes=30)
    assert sorted(map(tuple, rows.collect())) == [(1, at[0], at[1] + half, 2), (2, at[2], at[2] + half, 1)]
    assert [r.n for r in ST.stream_sessions(events).where(F.col("session_start") > F.lit("2024-01-30T22:30:00Z").cast("timestamp")).collect()] == [1]


def test_languages_in_one_pass(spark):
    """Texts are read once and only sums per key are shuffled; a table too long to broadcast gives the same."""
    labelled = spark.createDataFrame([("en", "the house and the river"), ("en", "then there was the other one"), ("de", "der Fluss und das Haus"), ("de", "dann war noch der andere da")], "lang string, text string")
    rows = [(1, "the river and the other house, then"), (2, "UND DER ANDERE FLUSS; das Haus und der"), (3, "the"), (4, None), (5, "12 34"), (None, "the the"), (6, "q" * 26), (7, "the river"), (7, "the other house and the river"), (8, "")]
    texts, profiles = spark.createDataFrame(rows, "k long, text string"), LG.language_profiles(labelled)
    near, far = LG.detect_languages(texts, profiles, "k"), LG.detect_languages(texts, profiles, "k", broadcast_scores=0)
    some = LG.detect_languages(texts, profiles, "k", common_words=2)
    assert sorted(near.collect()) == sorted(far.collect()) == sorted(some.collect()) and near.count() == 8
    assert {r.k: r.lang_found for r in near.collect() if r.k != 6} == {1: "en", 2: "de", 3: None, 4: None, 5: None, 7: "en", 8: None}
    plan = LG.detect_languages(texts, profiles, "k")
    assert len(exchanges(plan, "hashpartitioning(k")) == 1
    assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()
    nothing = LG.detect_languages(texts, profiles.limit(0), "k")
    assert nothing.count() == 8 and nothing.where("lang_found IS NOT NULL").count() == 0


def test_comparisons_search_a_long_word_once(spark):
    """A word of 200,000 letters before a keyword: time by the text's length, not by its square."""
    texts = spark.createDataFrame([(1, "s", "a" * 200_000 + "- alternative. Blue vs Red vs\n Green alternative é vs x_1"), (2, "s", "vsop likely"), (3, "s", None)], "page_id long, site string, text string")
    t = time.time()
    got = sorted(r.competitor for r in P.competitor_phrases(texts).collect())
    assert got == ["blue vs red", "green alternative é", "é vs x_1"] and time.time() - t < 20


def test_first_words_of_stems_without_a_sort_of_all_tokens(spark):
    """Tokens are aggregated by hash when the order is a number; any other order gives the same words."""
    rows = [("a", None, "house runs houses"), ("a", -5, "run houses"), ("a", 3, "run house"), ("b", 2**62, "runs run"), ("b", 2**62 - 1, "walk run"), ("b", -2**62, None)]
    texts = spark.createDataFrame(rows, "lang string, o long, text string")
    named = texts.withColumn("o", F.when(F.col("o").isNotNull(), F.lpad((F.col("o").cast("decimal(20,0)") + F.lit(2**62).cast("decimal(20,0)")).cast("string"), 22, "0")))
    got, same = GR.stem_counts(texts, "lang", "o"), GR.stem_counts(named, "lang", "o")
    assert sorted(got.collect()) == sorted(same.collect())
    assert {(r.lang, r.stem): (r.word, r.n) for r in got.collect()} == {("a", "hous"): ("house", 4), ("a", "run"): ("runs", 3), ("b", "run"): ("run", 3), ("b", "walk"): ("walk", 1)}
    plan = GR.stem_counts(texts, "lang", "o")._jdf.queryExecution().executedPlan().toString()
    assert sum("SortAggregate" in x and "token" in x and "count(1)" in x for x in plan.splitlines()) == 0
    assert sum("HashAggregate" in x and "count(1)" in x for x in plan.splitlines()) == 2


def test_grams_are_cut_once(spark):
    """N-grams of a text come from its tokens without a list per gram, and of short texts there are none."""
    texts = spark.createDataFrame([("s", 1, "aa bb cc aa bb"), ("s", 2, "aa"), ("t", 3, None), ("t", 4, "")], "site string, page_id long, text string")
    assert {(r.gram, r.n) for r in GR.gram_counts(texts, "site", 2).collect()} == {("aa bb", 2), ("bb cc", 1), ("cc aa", 1)}
    assert {r.gram for r in GR.gram_counts(texts, "site", 5).collect()} == {"aa bb cc aa bb"} and GR.gram_counts(texts, "site", 6).count() == 0
    assert {r.gram for r in GR.gram_counts(texts, "site", 1).collect()} == {"aa", "bb", "cc"}
    got = {(r.kind, r.gram, r.n) for r in GR.site_keywords(texts, "site", stop_words=["aa"], more_than=1).collect()}
    assert got == {("stem", "bb", 2), ("bigram", "aa bb", 2)}
    plan = GR.site_keywords(texts, "site")._jdf.queryExecution().executedPlan().toString()
    assert "array_join" not in plan and plan.count("hashpartitioning(site") == 2 and "kind" not in next(x for x in plan.splitlines() if "partial_count(1)" in x)


def test_audit_writes_few_files(spark, tmp_path):
    """Files of a stored audit grow with its buckets, not with tasks times buckets."""
    pages = spark.range(0, 4000, 1, 16).select(F.concat(F.lit("s"), F.col("id") % 10).alias("site"), F.col("id").alias("page_id"))
    io.write_audit(pages.select("site").distinct(), pages, pages, str(tmp_path), "a")
    buckets = io.with_site_bucket(pages).select("site_bucket").distinct().count()
    for name in ("pages", "audits", "sites"):
        assert len(list((tmp_path / name).rglob("*.parquet"))) <= 2 * buckets
    assert io.read_run(spark, f"{tmp_path}/pages", "a").count() == 4000


def test_stored_audit_extracts_its_pages_once(spark, monkeypatch):
    from catalog import composites

    calls = []
    monkeypatch.setattr(composites, "host_signals", lambda *a: calls.append(a) or HOSTS(*a))
    composites._audited_twice(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_timer_moves_only_with_the_first_event():
    """Each call to the state store is a trip out of Python: none is made that changes nothing."""
    calls = []

    class Handle:
        held, timers = None, []

        def getValueState(self, *_):
            return self

        def exists(self):
            calls.append("exists")
            return self.held is not None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, held):
            calls.append("update")
            self.held = held

        def listTimers(self):
            calls.append("list")
            return iter(self.timers)

        def deleteTimer(self, t):
            calls.append("delete")
            self.timers.remove(t)

        def registerTimer(self, t):
            calls.append("register")
            self.timers.append(t)

    p, h = ST.AbandonedSessions("purchase", 24), Handle()
    h.timers = []
    p.init(h)
    hour = 3_600_000_000
    for at, want in ((5 * hour, ["get", "register", "update"]), (6 * hour, ["get", "update"]), (6 * hour, ["get"]), (4 * hour, ["get", "delete", "register", "update"])):
        calls.clear()
        p.handleInputRows(("a",), iter([Row(site_id="1", step="view", event_id=1, at=at)]), None)
        assert calls == want and len(h.timers) == 1
    assert h.timers == [28 * 3_600_000] and h.held == ("1", "view", 1, 4 * hour, 6 * hour, False)


def test_audited_record_extracts_its_pages_once(spark, monkeypatch):
    """Statuses of the pages' links come from the stored signals, not from a second extraction."""
    from catalog import answers

    def again(*_):
        raise AssertionError("pages are extracted a second time")

    monkeypatch.setattr(answers, "host_signals", again)
    record = answers.audited(spark, "/root/testdata/sf0.001")
    assert record.where("n_broken > 0").count() > 0


def test_pages_are_cut_and_searched_once(spark):
    pages = spark.createDataFrame([(1, "https://a.lt/", "<a href=\"it's\" title='say \"hi\"'>x</a><a href=\"\">e</a><a title=t>n</a><p>one<p>two")], "page_id long, url string, html string")
    df = pages.select(H.anchors("html").alias("a"), H.paragraphs("html").alias("p"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(H.ANCHOR_START) == 1 and plan.count(H.PARAGRAPH_START) == 1
    row = df.collect()[0]
    assert [tuple(x) for x in row.a] == [("it's", 'say "hi"', "x"), ("", None, "e")] and row.p == ["one", "two"]
    href = pages.select(H.attr("html", "href").alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert href.count(r"\shref") == 1


def test_quick_searches_find_what_the_patterns_find(spark):
    odd = ["", "+370 600 12345", "x+ (8) 600-1234", "12345", "(5) 555 5555x", "++1 2 345 678", "1 main street, x", " Str.x", "g.a", " RĪGA ", "vilnius", "Kraków-Praha", "a.ul.b", "<b>Road</b>", "rd. x", None]
    rows = spark.createDataFrame([(x,) for x in odd], "s string")
    for whole, quick in ((PS.PHONE, PS.PHONE_SEARCH), (PS.ADDRESS_HINT, PS.ADDRESS_SEARCH)):
        got = rows.select(F.regexp_extract(F.concat(F.lit(" "), "s", F.lit(" ")), whole, 0).alias("a"), F.regexp_extract(F.concat(F.lit(" "), "s", F.lit(" ")), quick, 0).alias("b")).collect()
        assert all(r.a == r.b for r in got) and sum(bool(r.a) for r in got) > 2


def test_site_breakdown_extracts_its_pages_once(spark):
    """Scores, coverage, platform and advice of a site audit read one row of sums per site, not the pages."""
    pages = spark.createDataFrame([(i, f"https://a{i % 2}.lt/{i}", "<title>T</title><h2>What is it?</h2><ul><li>a</li></ul><p>one</p>" * (i + 1) + "wp-content" * (i % 3)) for i in range(9)], "page_id long, url string, html string")
    signals = PS.page_signals(pages)
    out = JB.audit_aeo_geo(signals)
    for name in ("scores", "coverage", "platform", "recommendations"):
        assert "regexp" not in out[name]._jdf.queryExecution().optimizedPlan().toString()
    apart = {"scores": A.site_mean_scores(C.page_breakdown(signals)), "coverage": A.signal_coverage(signals), "platform": A.platform(signals)}
    for name, df in apart.items():
        assert df.dtypes == out[name].dtypes
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, out[name].collect()))


class BucketHandle:
    """A state store with one value and timers, that counts the calls made to it."""

    def __init__(self):
        self.calls, self.held, self.timers = [], None, []

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls.append("get")
        return self.held

    def update(self, held):
        self.calls.append("update")
        self.held = held

    def clear(self):
        self.calls.append("clear")
        self.held = None

    def registerTimer(self, t):
        self.calls.append("register")
        self.timers.append(t)

    def deleteTimer(self, t):
        self.calls.append("delete")
        self.timers.remove(t)


def test_sessions_of_a_bucket_share_calls_and_one_timer():
    """Trips out of Python are made per bucket and not per session; the timer is that of the next session to end."""
    h, p, hour = BucketHandle(), ST.AbandonedSessionsByBucket("purchase", 24), 3_600_000_000
    p.init(h)

    def events(*rows):
        h.calls.clear()
        frames = [pd.DataFrame(rows[i:i + 300], columns=["id", "site_id", "step", "event_id", "at"]) for i in range(0, len(rows), 300)]
        assert list(p.handleInputRows((0,), iter(frames), None)) == []
        return h.calls

    def expired(at):
        h.calls.clear()
        h.timers.remove(min(h.timers))  # Spark does so
        return [r for f in p.handleExpiredTimer((0,), TimerValues(0, at // 1000), None) for r in f.to_dict("records")]

    many = [(f"s{i}", "1", "view", i, 5 * hour + i) for i in range(1000)]
    assert events(*many) == ["get", "register", "update"] and h.timers == [29 * 3_600_000]
    assert events(("s7", "1", "purchase", 2000, 6 * hour), ("s8", "1", "click", 2001, 6 * hour)) == ["get", "update"]
    assert events(("s9", "1", "view", 2002, 4 * hour)) == ["get", "delete", "register", "update"] and h.timers == [28 * 3_600_000]
    assert expired(28 * hour) == [{"id": "s9", "site_id": "1", "current_step": "view", "created": 4 * hour, "updated": 5 * hour + 9, "ended": 28 * hour}]
    assert h.calls == ["get", "register", "update"] and h.timers == [29 * 3_600_000] and len(h.held[0]) == 999
    rest = expired(30 * hour)
    assert sorted(r["id"] for r in rest) == sorted(f"s{i}" for i in range(1000) if i not in (7, 9))
    assert [r["current_step"] for r in rest if r["id"] == "s8"] == ["click"] and h.calls == ["get", "clear"] and h.timers == []


def test_buckets_give_the_rows_of_single_sessions(spark, tmp_path):
    """Over several batches, with events out of order, nulls, ids that come again after their end and sessions of one bucket that end apart."""
    t0 = dt.datetime(2024, 1, 1)
    schema = "id string, site_id string, step string, event_id long, ts timestamp"
    odd = [(None, None, None, None, t0), (None, "1", "view", 2**62 + 1, t0 + dt.timedelta(hours=1)), ("s1", None, "click", 2**62 + 1, t0), ("s1", "2", "view", 2**62 + 2, t0)]
    for k in range(7):
        rows = [(f"s{i}", str(i % 3), "purchase" if (i + k) % 7 == 0 else f"step {k}", 100 * k + i, t0 + dt.timedelta(hours=12 * k + i * 7 % 11, microseconds=i * 1001 % 9)) for i in range(40) if (i + k) % 3]
        spark.createDataFrame(rows + odd * (k == 0), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    conf = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "2"}
    before, found = {name: spark.conf.get(name) for name in conf}, {}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        for buckets in (None, 3):
            events = ST.read_stream(spark, f"{tmp_path}/in", schema, max_files=1)
            q = ST.stream_abandoned(events, watermark="10 minutes", buckets=buckets).writeStream.format("parquet").option(
                "checkpointLocation", f"{tmp_path}/state{buckets}").trigger(availableNow=True).start(f"{tmp_path}/out{buckets}")
            q.awaitTermination()
            found[buckets] = sorted(map(str, spark.read.parquet(f"{tmp_path}/out{buckets}").collect()))
            ids = [r.split(",")[0] for r in found[buckets]]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert found[3] == found[None]
    assert len(set(ids)) > 20 and len(ids) > len(set(ids)) and ids.count("Row(id=None") == 1


def test_stream_of_abandoned_sessions_is_kept_by_bucket(spark, tmp_path):
    schema = "id string, site_id string, step string, event_id long, ts timestamp"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    plan = ST.stream_abandoned(ST.read_stream(spark, f"{tmp_path}/in", schema))._jdf.queryExecution().analyzed().toString()
    assert "pmod(xxhash64(id" in plan
