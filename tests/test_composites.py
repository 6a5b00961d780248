"""Sinks keyed by run, reply lines, message templates and the session timer, on small tables with literal results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagelens.functions.exprs import message
from pagelens.plans import jobs as JB
from pagelens.sources import io
from pagelens.streaming import stream as ST

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def tmp(tmp_path):
    return str(tmp_path)


def test_message(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "x string, n int")
    rows = df.select(message("{x} has {n} (100%).", x=F.col("x"), n=F.col("n").cast("string")).alias("m"), message("plain").alias("p")).collect()
    assert [(r.m, r.p) for r in rows] == [("a has 1 (100%).", "plain"), (None, "plain")]


def test_runs(spark, tmp):
    t = lambda *xs: spark.createDataFrame([(x,) for x in xs], "site string")
    io.write_run(t("a", "b"), f"{tmp}/t", "2024-01-01")
    io.write_run(t("c"), f"{tmp}/t", "2")
    io.write_run(t("b"), f"{tmp}/t", "2024-01-01")
    assert sorted((r.site, r.run) for r in io.read_run(spark, f"{tmp}/t").collect()) == [("b", "2024-01-01"), ("c", "2")]
    assert [r.site for r in io.read_run(spark, f"{tmp}/t", "2").collect()] == ["c"]
    with pytest.raises(ValueError):
        io.write_run(t("a"), f"{tmp}/t", "../x")


def test_audit_of_a_repeated_run(spark, tmp):
    def pages(n, host):
        return spark.createDataFrame([(i, f"https://{host}/{i}", f"<title>T{i}</title><h2>What is {i}?</h2>") for i in range(n)], "page_id long, url string, html string")

    def stored(name):
        return sorted(map(str, spark.read.parquet(f"{tmp}/{name}").drop("site_bucket").collect()))

    JB.audit_sites(pages(3, "a.lt"), tmp, "r1")
    before = {n: stored(n) for n in ("pages", "audits", "sites", "page_signals")}
    JB.audit_sites(pages(3, "a.lt"), tmp, "r1")
    assert {n: stored(n) for n in before} == before and len(before["pages"]) == 3
    JB.audit_sites(pages(2, "a.lt").unionByName(pages(2, "b.lt")), tmp, "r2")
    assert sorted((r.site, r.run) for r in io.read_run(spark, f"{tmp}/sites").collect()) == [("a.lt", "r1"), ("b.lt", "r2")]
    assert io.read_run(spark, f"{tmp}/pages").groupBy("run").count().where("run = 'r2' AND count = 4").count() == 1


@pytest.mark.parametrize("raw, queries", [
    (None, []), ("", []), ("[broken", []), ("[broken, list]", []),
    ('["q1", "q2", "q3", "q4", "q5"]', ["q1", "q2", "q3", "q4", "q5"]),
    ('["only one of them"]', ["[only one of them]"]),
    ('# Heading line\n- a point of a list\n "What is it?"  \nshort\nWho\'s the best one', ["What is it?", "Whos the best one"]),
    ("\n".join(f"Query number {i}" for i in range(9)), [f"Query number {i}" for i in range(5)]),
])
def test_generated_queries(spark, raw, queries):
    df = spark.createDataFrame([(1, raw)], "id int, raw string")
    assert io.generated_queries(df).collect()[0].queries == queries


def test_abandoned_sessions_by_timer(spark, tmp):
    """Events out of order and over several batches; each abandoned session comes once, completed and young ones never."""
    def at(day, hour, minute=0):
        return dt.datetime(2024, 1, day, hour, minute)

    batches = [
        [("a", "1", "view", 1, at(1, 10)), ("b", "2", "view", 2, at(1, 10))],
        [("a", "1", "click", 4, at(1, 11)), ("a", "1", "signup", 3, at(1, 11)), ("a", "1", "view", 0, at(1, 9, 50)), ("b", "2", "purchase", 5, at(1, 12))],
        [("c", "1", "view", 6, at(2, 9, 30))],
        [("d", "1", "view", 7, at(2, 12))],
        [("c", "1", "click", 8, at(2, 13))],
    ]
    schema = "id string, site_id string, step string, event_id long, ts timestamp"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        events = ST.read_stream(spark, f"{tmp}/in", schema, max_files=1)
        q = ST.stream_abandoned(events, watermark="10 minutes").writeStream.format("parquet").outputMode("append").option(
            "checkpointLocation", f"{tmp}/state").trigger(availableNow=True).start(f"{tmp}/out")
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    rows = spark.read.parquet(f"{tmp}/out").collect()
    assert [(r.id, r.site_id, r.current_step, r.created_at, r.updated_at, r.abandoned_at) for r in rows] == [
        ("a", "1", "click", at(1, 9, 50), at(1, 11), at(2, 9, 50))]
