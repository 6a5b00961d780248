"""Inputs of the catalogue: the given tables, and one expression that adds page features they lack.

``AUGMENT`` reads the same in Spark SQL and in DuckDB.  It appends head and body fragments that depend on the page
id to the whole HTML of every page; no page is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.operators.page_signals import page_signals

AUGMENT = """
concat(replace(html, '</head>', concat(
  CASE WHEN page_id % 5 = 0 THEN '' ELSE concat('<meta name="description" content="', CASE page_id % 5 WHEN 1 THEN 'How to choose a product?' WHEN 2 THEN substr(repeat('Local service in Vilnius. ', 10), 1, 155) WHEN 3 THEN substr(repeat('What we do: ', 20), 1, 200) ELSE 'Shop now' END, '">') END,
  CASE WHEN page_id % 3 = 0 THEN '<meta property="og:site_name" content="Acme"><meta property="og:title" content="T"><meta property="og:description" content="D"><meta property="og:image" content="/i.png">' WHEN page_id % 3 = 1 THEN '<meta content="T" property="og:title">' ELSE '' END,
  CASE page_id % 8 WHEN 0 THEN '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Organization","name":"Acme","telephone":"+370 600 12345"}</script>' WHEN 1 THEN '<script type="application/ld+json">{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"What is it?","acceptedAnswer":{"@type":"Answer","text":"A thing."}},{"@type":"Question","name":"Why now?","acceptedAnswer":{"@type":"Answer","text":"Because."}}]}</script>' WHEN 2 THEN '<script type="application/ld+json">{"@type":"LocalBusiness","name":"Acme","address":{"addressLocality":"Kaunas","addressCountry":"LT"}}</script>' WHEN 3 THEN '<script type="application/ld+json">[{"@type":"Product","name":"Blue Lamp"},{"@type":"Article","name":"Guide"}]</script>' WHEN 4 THEN '<script type="application/ld+json">{bad json</script>' WHEN 5 THEN '<script type="application/ld+json">{"@type":"Product","name":"Red Lamp"}</script>' ELSE '' END,
  CASE page_id % 4 WHEN 1 THEN '<link rel="alternate" hreflang="lt" href="https://a.example/lt">' WHEN 2 THEN '<link rel="alternate" hreflang="lt" href="/lt"><link hreflang="en" rel="alternate" href="/en">' WHEN 3 THEN '<link rel="alternate" href="/feed">' ELSE '' END,
  CASE WHEN page_id % 2 = 0 THEN '<link rel="canonical" href="/c">' ELSE '' END,
  CASE page_id % 6 WHEN 0 THEN '<meta name="robots" content="noindex,follow">' WHEN 1 THEN '<meta name="robots" content="index,follow">' ELSE '' END,
  CASE WHEN page_id % 7 = 0 THEN '<meta name="geo.region" content="LT-VL"><meta name="geo.placename" content="Vilnius">' ELSE '' END,
  CASE WHEN page_id % 9 <> 0 THEN '<meta name="viewport" content="width=device-width">' ELSE '' END,
  '</head>')),
  '<h2>', CASE page_id % 3 WHEN 0 THEN 'How does it work?' WHEN 1 THEN 'Our Products' ELSE 'Was ist das?' END, '</h2>',
  CASE WHEN page_id % 4 = 0 THEN '<section><h3>What is the price?</h3><p>Ten euro.</p> frequently asked questions Q: Where? A: Here. Q: When? A: Now.</section>' ELSE '' END,
  CASE WHEN page_id % 5 = 0 THEN '' ELSE repeat('<img src="/img/product-1.jpg" alt="">', CAST(page_id % 3 AS INT)) END,
  CASE WHEN page_id % 3 = 0 THEN '<img src="/logo.png" alt="Company logo" loading="lazy" width="10" height="10"><img src=/t.png alt=img>' ELSE '' END,
  CASE WHEN page_id % 6 = 0 THEN '<iframe src="https://www.google.com/maps/embed?x=1"></iframe>' WHEN page_id % 6 = 3 THEN '<iframe src="https://www.openstreetmap.org/e"></iframe>' ELSE '' END,
  CASE WHEN page_id % 11 = 2 THEN '<p title="1 > 2">Caf&eacute; &#8217;s &#x2014; &copy; &unknown; a & b</p><img alt="a > b" src="/gt.png"><a title="x > y" href="/gt">quoted</a>' ELSE '' END,
  CASE WHEN page_id % 7 = 1 THEN '<table><tr><td>1</td></tr></table><p>12 Main street, Vilnius, LT 01234 tel. +370 600 12345</p>' ELSE '' END,
  CASE page_id % 10 WHEN 1 THEN '<link href="/wp-content/x.css">' WHEN 2 THEN '<img src="https://cdn.shopify.com/a.png" alt="Lamp on desk">' WHEN 3 THEN '<p>Please enable JavaScript</p>' ELSE '' END,
  '<a href="https://other.example/x?y=1#z">x</a><a href="mailto:a@b.c">m</a><a href="../up/p.html">click here</a><a href="//cdn.example/q" title="t">q</a>')
"""

_SIGNALS: dict[tuple[int, str], tuple[SparkSession, DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; those with costly per-row work are dealt out over all cores, as they come in one row group."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(spark.sparkContext.defaultParallelism) if name in ("pages", "documents", "conversations") else df


def aug_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", F.expr(AUGMENT).alias("html"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_signals`` of the augmented pages; only the plan is kept between queries, no data."""
    key = (id(spark), sf_dir)
    if key not in _SIGNALS:
        _SIGNALS[key] = (spark, page_signals(aug_pages(spark, sf_dir)))
    return _SIGNALS[key][1]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as stored answers; site, category and brand follow from the conversation id."""
    t = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return t.select(
        F.concat(F.lit("s"), (F.col("conv_id") % 7).cast("string")).alias("site"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.expr("CASE conv_id % 6 WHEN 0 THEN 'brand' WHEN 1 THEN 'service_product' WHEN 2 THEN 'competitor' "
               "WHEN 3 THEN 'local_geo' WHEN 4 THEN 'problem_solving' ELSE 'custom' END").alias("category"),
        F.expr("CASE conv_id % 7 WHEN 0 THEN 'The' WHEN 1 THEN 'Of the' WHEN 2 THEN 'De' WHEN 3 THEN 'En Que' "
               "WHEN 4 THEN 'Der' WHEN 5 THEN 'La Paz' ELSE 'Acme' END").alias("brand"),
        F.concat(F.col("text"), F.expr(
            "CASE conv_id % 5 WHEN 0 THEN ' The best options such as Blue Lamp, Acme and IBM are recommended.' "
            "WHEN 1 THEN ' Alternatives: Red Desk or Northwind Traders, besides Acme.' "
            "WHEN 2 THEN ' Acme vs Contoso is also a choice.' ELSE '' END")).alias("response"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session per user and day of the events; completed when it holds a purchase."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    bought = F.col("event_type") == "purchase"
    g = e.groupBy("user_id", "day").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("current_step"),
        F.max(F.when(bought, F.col("ts"))).alias("completed_at"))
    return g.select(
        F.concat("user_id", F.lit("-"), F.date_format("day", "yyyyMMdd")).alias("id"),
        (F.col("user_id") % 10).cast("string").alias("site_id"),
        F.when(F.col("completed_at").isNotNull(), "completed").otherwise("started").alias("status"),
        "current_step", "created_at", "updated_at", "completed_at")
