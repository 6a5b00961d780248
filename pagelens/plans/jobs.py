"""Composite jobs: what each report asks for, as a few tables from one set of page signals.

``page_signals`` is the expensive stage.  Jobs take it ready made; on a cluster write it once with
``write_table`` and read it back, so that every later job reads only the columns it needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import structured as J
from ..functions.exprs import entries
from ..operators import checks as C
from ..operators import links as G
from ..operators import page_rows as P
from ..operators import recommend as R
from ..operators import site as A
from ..operators import visibility as V
from ..operators.page_signals import page_signals
from ..session import checkpoint_ready
from ..sources import io

c = F.col


def site_signals(signals: DataFrame) -> DataFrame:
    """Distinct signals per site: ``site, kind, value``; all kinds of a page come out of one explode of its row."""
    def kind(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("kind"), v.alias("value")))

    rows = P.with_topics(signals.withColumn("_low", F.lower("text")).select("*", F.concat(
        kind("product", P.product_names()),
        kind("competitor", P.comparison_phrases(c("_low"))),
        kind("faq", F.transform(J.faq_entities("jsonld"), lambda e: e["question"])),
        kind("schema", c("jsonld_types")),
        kind("alt_issue", P.alt_issue_texts()),
        kind("geo_signal", P.geo_signal_texts())).alias("_kinds")), "site", "_kinds")
    every = F.concat("_kinds", kind("topic", F.transform("_topics", lambda t: t["topic"])))
    return rows.select("site", F.explode(entries(every)).alias("r")).select("site", "r.*").distinct()


def site_profile(signals: DataFrame) -> DataFrame:
    """One row per site: brand, description, location, industry."""
    return A.profile(signals)


def _signals(pages: DataFrame) -> DataFrame:
    """Signals of pages; a table that holds them already is taken as it is."""
    return pages if "word_count" in pages.columns else page_signals(pages)


def audit_sites(pages: DataFrame, root: str | None = None, run: str = "current") -> dict[str, DataFrame]:
    """Profile and distinct signals of every site; written below ``root`` when one is given.

    All tables there hold one part per ``run`` (say, the crawl's date), which a repeated run replaces as a whole, so that
    running twice, or once more after a failure, leaves the same tables.
    """
    signals = _signals(pages)
    out = {"profile": site_profile(signals), "signals": site_signals(signals)}
    if root:
        io.write_run(signals, f"{root}/page_signals", run)
        stored = io.read_run(pages.sparkSession, f"{root}/page_signals", run).drop("run")
        out = {"profile": site_profile(stored), "signals": site_signals(stored)}
        io.write_audit(out["profile"], stored.select("site", "page_id", "url", "title", "text"), out["signals"], root, run)
    return out


def audit_full(pages: DataFrame, robots: DataFrame | None = None, url_status: DataFrame | None = None) -> dict[str, DataFrame]:
    """Page records with robots and link health, site roll-ups, and sites that hold only technical files."""
    signals = page_signals(pages)
    edges = G.link_edges(signals)
    record = signals
    if robots is not None:
        hit = G.robots_blocked(signals, io.robots_rules(robots)).select("page_id").withColumn(
            "blocked_by_robots", F.lit(True))
        record = record.join(hit, "page_id", "left").withColumn(
            "blocked_by_robots", F.coalesce("blocked_by_robots", F.lit(False)))
    out = {"edges": edges, "technical_only": G.technical_only_sites(signals), "hreflang": P.hreflang_pairs(signals)}
    if url_status is not None:
        broken = G.page_broken_links(edges, url_status).withColumnRenamed("src_page_id", "page_id")
        record = record.join(broken, "page_id", "left").withColumn("n_broken", F.coalesce("n_broken", F.lit(0)))
        out["broken_links"] = G.broken_links(edges, url_status)
    return {"pages": record, "rollup": A.site_rollup(record), "languages": A.site_languages(signals), **out}


def _bucketed(df: DataFrame, name: str, buckets: int, folder: str | None) -> DataFrame:
    write = df.write.format("parquet").mode("overwrite").bucketBy(buckets, "page_id").sortBy("page_id")
    (write.option("path", f"{folder}/{name}") if folder else write).saveAsTable(name)
    return df.sparkSession.table(name)


def stored_record(pages: DataFrame, name: str, robots: DataFrame | None = None, url_status: DataFrame | None = None, *,
                  buckets: int = 64, folder: str | None = None) -> DataFrame:
    """Page signals with ``n_broken`` and ``blocked_by_robots``, from two tables bucketed by ``page_id``.

    Pages are read and extracted once, into ``<name>_signals``; links, robots and statuses are then joined as narrow columns of
    it into ``<name>_health``, in the same buckets.  Joins of the two, now and in later sessions, need no shuffle.  Both tables
    are overwritten, so a second run gives the same; ``folder`` holds them (None: the warehouse).  Choose ``buckets`` so that one
    holds some hundred MB.  Where statuses come from the pages' own links, call the two steps by themselves and take the links
    from what ``stored_signals`` returns.
    """
    stored = stored_signals(pages, name, buckets=buckets, folder=folder)
    return stored_health(stored, name, robots, url_status, buckets=buckets, folder=folder)


def stored_signals(pages: DataFrame, name: str, *, buckets: int = 64, folder: str | None = None) -> DataFrame:
    """First step of ``stored_record``: the one extraction."""
    return _bucketed(page_signals(pages), f"{name}_signals", buckets, folder)


def stored_health(stored: DataFrame, name: str, robots: DataFrame | None = None, url_status: DataFrame | None = None, *,
                  buckets: int = 64, folder: str | None = None) -> DataFrame:
    """Second step of ``stored_record``, over the signals that the first one stored under the same name and buckets."""
    none = stored.select("page_id", F.lit(0).cast("long").alias("n_broken"), F.lit(False).alias("blocked_by_robots")).limit(0)
    parts = [none]
    if url_status is not None:
        broken = G.page_broken_links(G.link_edges(stored), url_status)
        parts.append(broken.select(c("src_page_id").alias("page_id"), c("n_broken").cast("long"), F.lit(False).alias("blocked_by_robots")))
    if robots is not None:
        hit = G.robots_blocked(stored.select("page_id", "url"), io.robots_rules(robots))
        parts.append(hit.select("page_id", F.lit(0).cast("long").alias("n_broken"), F.lit(True).alias("blocked_by_robots")))
    both = reduce(DataFrame.unionByName, parts).groupBy("page_id").agg(
        F.max("n_broken").alias("n_broken"), F.max("blocked_by_robots").alias("blocked_by_robots"))
    _bucketed(both, f"{name}_health", buckets, folder)
    return audited_record(stored.sparkSession, name)


def audited_record(spark: SparkSession, name: str) -> DataFrame:
    """The record that ``stored_record`` keeps under ``name``; buckets of both tables are merged in place."""
    health = spark.table(f"{name}_health").hint("merge")
    record = spark.table(f"{name}_signals").join(health, "page_id", "left")
    return record.withColumn("n_broken", F.coalesce("n_broken", F.lit(0))).withColumn(
        "blocked_by_robots", F.coalesce("blocked_by_robots", F.lit(False)))


def score_audit(record: DataFrame, url_status: DataFrame) -> dict[str, DataFrame]:
    """Pillar scores and site totals on an audited record, where links and robots rules count.

    ``rollup`` has the totals of ``site_rollup`` and ``broken_unique``, the distinct broken internal links of a site.
    """
    broken = G.broken_links(G.link_edges(record), url_status).groupBy("site").agg(F.count(F.lit(1)).alias("broken_unique"))
    rollup = A.site_rollup(record).join(broken, "site", "left").withColumn("broken_unique", F.coalesce("broken_unique", F.lit(0)))
    return {"scores": A.pillar_scores(record), "checks": C.check_rows(record, "pillars"), "rollup": rollup}


def audit_aeo_geo(pages: DataFrame, lang: str = "en") -> dict[str, DataFrame]:
    """Breakdown per page, site scores, coverage, platform and advice, of pages or of their signals.

    All site tables come from one aggregation, kept as a checkpoint of one row per site, so that pages are extracted once for
    them; ``pages`` is left to be computed where it is used.
    """
    checkpoint_ready(pages.sparkSession)
    signals = _signals(pages)
    totals = A.breakdown_totals(signals, lang).checkpoint()
    scores, coverage = A.mean_scores_of(totals), A.coverage_of(totals)
    return {"pages": C.page_breakdown(signals, lang), "scores": scores, "coverage": coverage, "platform": A.platform_of(totals),
            "recommendations": R.site_recommendations(coverage, scores)}


def audit_page(pages: DataFrame, lang: str = "en") -> dict[str, DataFrame]:
    """The same without the site stage."""
    signals = _signals(pages)
    return {"pages": C.page_breakdown(signals, lang),
            "recommendations": R.page_recommendations(C.check_rows(signals, "breakdown"))}


def score_sites(signals: DataFrame) -> DataFrame:
    """Both score schemes, one row per site."""
    pillars = A.pillar_scores(signals)
    answers = A.answer_scores(signals).select(
        "site", c("aeo").alias("answer_aeo"), c("geo").alias("answer_geo"), c("overall").alias("answer_overall"))
    return pillars.join(answers, "site")


def optimize_sites(signals: DataFrame, limit: int = 10) -> DataFrame:
    """Suggestions for the pages with most words of each site."""
    top = A.optimize_candidates(signals, limit).drop("rank")
    return R.page_suggestions(top, A.brand_guess(top))


def site_context(signals: DataFrame, linked_pages: int = 5) -> DataFrame:
    """Products, locations and FAQ topics by the role of a page's URL, from the first pages of each site.

    Long rows ``site, kind, value``: at most ten products, five topics, one location.
    """
    low = F.lower("url")
    few = io.sample_pages(signals, linked_pages).select(
        "site", "page_id", "jsonld", "headings", "text", low.rlike("product|shop|catalog").alias("sells"),
        low.rlike("contact|about|location").alias("locates"))
    products = P.products(few.where("sells"), "long").select("site", F.lit("product").alias("kind"), c("product").alias("value"))
    topics = P.faq_topics(few).select("site", F.lit("faq_topic").alias("kind"), c("topic").alias("value"))
    place = A.location(few.where("locates"), "context").select(
        "site", F.lit("location").alias("kind"), c("location").alias("value"))
    rows = products.unionByName(topics).unionByName(place).distinct()
    from pyspark.sql.window import Window

    w = Window.partitionBy("site", "kind").orderBy("value")
    top = F.when(c("kind") == "product", 10).when(c("kind") == "faq_topic", 5).otherwise(1)
    return rows.withColumn("rank", F.row_number().over(w)).where((c("rank") <= 10) & (c("rank") <= top))


def query_visibility(queries: DataFrame, answers: DataFrame, chosen: DataFrame | None = None) -> dict[str, DataFrame]:
    """Select queries, evaluate their stored answers, summarise per site.

    ``queries(site, query_id, category, text)``, ``answers(site, query_id, brand, response)``.
    """
    picked, errors = (queries, None) if chosen is None else V.select_queries(queries, chosen)
    joined = picked.join(answers, ["site", "query_id"])
    evaluated = V.evaluate_answers(joined)
    out = {"answers": evaluated, "summary": V.visibility_summary(evaluated), "top_competitors": V.top_competitors(evaluated),
           "categories": V.category_counts(queries)}
    return out if errors is None else {**out, "errors": errors}


def recommend_keywords(profile: DataFrame, mode: str = "both") -> DataFrame:
    if mode in ("AEO", "GEO"):
        return R.keyword_ideas(profile, mode)
    return R.keyword_ideas(profile, "AEO").unionByName(R.keyword_ideas(profile, "GEO"))


def brand_page_visibility(signals: DataFrame, brands: DataFrame) -> dict[str, DataFrame]:
    scored = V.page_visibility(signals, brands)
    return {"queries": scored, "advice": V.visibility_advice(scored)}


def cms_updates(suggestions: DataFrame, cms_pages: DataFrame) -> dict[str, DataFrame]:
    """Payloads of matched suggestions, and the suggestions no CMS page matches."""
    match = G.cms_match(suggestions, cms_pages)
    full = suggestions.join(match, "url").join(cms_pages.select("cms_id", "content"), "cms_id")
    return {"payload": G.cms_payload(full), "unmatched": suggestions.join(match, "url", "left_anti")}


def profile_for_keywords(signals: DataFrame) -> DataFrame:
    """Profile with its first products and its first competitor by name: bounded lists only."""
    from pyspark.sql.window import Window

    base = site_profile(signals)
    w = Window.partitionBy("site").orderBy("product")
    prods = P.products(signals).select("site", "product").distinct().withColumn(
        "_n", F.row_number().over(w)).where(c("_n") <= 3).groupBy("site").agg(
        F.array_sort(F.collect_list("product")).alias("products"))
    rival = P.competitor_phrases(signals).groupBy("site").agg(F.min("competitor").alias("competitor"))
    return base.join(prods, "site", "left").join(rival, "site", "left").withColumn(
        "products", F.coalesce("products", F.array().cast("array<string>")))
