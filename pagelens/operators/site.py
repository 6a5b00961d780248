"""Site identity and site roll-ups.

Every roll-up is a map-side combined aggregation on the site key; first-match values are ``min_by`` over the page
id, and ranked lists rank pre-aggregated counts.  No list of pages, texts or urls is collected per site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as fv
from ..functions import html as H
from ..functions import structured as J
from ..functions import text as T
from ..functions import urls as U
from ..functions.exprs import any_of, rx, rx_sub
from . import checks as C

c = F.col
PLACE_IN_TEXT = r"\sin\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"


def _first_filled(signals: DataFrame, value: Column, name: str, latest: bool = False) -> DataFrame:
    """First non-empty value per site in page order (last when ``latest``).

    Empty values get no place in the order instead of being filtered away: a filter would be pushed below the
    projection that computes the value, which would then be computed twice.
    """
    rows = signals.select("site", "page_id", value.alias(name))
    pick = F.max_by if latest else F.min_by
    place = F.when(F.coalesce(c(name), F.lit("")) != "", c("page_id"))
    return rows.groupBy("site").agg(pick(name, place).alias(name), F.count(place).alias("_n")).where(
        c("_n") > 0).drop("_n")


# --- identity ------------------------------------------------------------------------------------
def page_brand(variant: str = "signals") -> Column:
    """Brand of one page.

    ``signals``: og:site_name, Organization name, cleaned title, host label.  ``last``: og:site_name,
    Organization name, head of the title.  ``context``: og:site_name, title without "Home"/"Official", Organization.
    """
    og = F.nullif(F.trim(F.get(F.filter("og", lambda o: F.lower(o["name"]) == "og:site_name"), F.lit(0))["content"]),
                  F.lit(""))
    first = F.get(c("jsonld"), F.lit(0))
    org = F.when(J.json_type(first) == "Organization", F.nullif(F.get_json_object(first, "$.name"), F.lit("")))
    if variant == "signals":
        cleaned = rx_sub("title", r"\s*[-|]\s*(?:Home|Welcome|Official)[^\n]*$")
        return F.coalesce(og, org, F.when(F.length(cleaned) > 3, cleaned), U.host_label("url"))
    if variant == "last":
        head = F.trim(F.element_at(F.split(F.element_at(F.split(c("title"), " - "), 1), r" \| "), 1))
        return F.coalesce(og, org, head)
    titled = F.when(c("has_title_tag"), rx_sub("title", r"(?: - | \| )(?:Home|Official)$"))
    return F.coalesce(og, titled, org, F.lit("Unknown Brand"))


def brand_name(signals: DataFrame, variant: str = "signals") -> DataFrame:
    return _first_filled(signals, page_brand(variant), "brand", latest=variant == "last")


def brand_guess(signals: DataFrame) -> DataFrame:
    """Last part of the first title cut at ``|``, ``-`` or ``–``; '' when it has one part."""
    titles = _first_filled(signals, c("title"), "title")
    parts = F.split(c("title"), r"\s*[|\-–]\s*")
    return titles.select("site", F.when(F.size(parts) > 1, F.trim(F.element_at(parts, -1))).otherwise("").alias("brand"))


def page_description(variant: str = "signals") -> Column:
    if variant == "signals":
        return c("meta")
    og = F.nullif(F.trim(F.get(F.filter("og", lambda o: F.lower(o["name"]) == "og:description"), F.lit(0))["content"]),
                  F.lit(""))
    first_p = F.substring(H.strip_tags(F.get(H.paragraphs("markup"), F.lit(0))), 1, 200)
    return F.coalesce("meta", og, first_p, F.lit(""))


def description(signals: DataFrame, variant: str = "signals") -> DataFrame:
    return _first_filled(signals, page_description(variant), "description")


def page_location(variant: str = "signals") -> Column:
    """LocalBusiness locality, then a place in the text (see the variants)."""
    local = J.blocks_of_type("jsonld", "LocalBusiness")
    locality = F.nullif(J.first_value(local, "$.address.addressLocality"), F.lit(""))
    if variant == "signals":
        return F.coalesce(locality, rx("text", PLACE_IN_TEXT))
    low = F.lower("text")
    if variant == "text":
        found = F.get(F.filter(F.array(*[F.lit(x) for x in fv.TEXT_COUNTRIES]), lambda x: F.contains(low, x)), F.lit(0))
        return F.coalesce(locality, F.initcap(found), F.lit(""))
    found = F.get(F.filter(F.array(*[F.lit(x) for x in fv.CONTEXT_COUNTRIES]),
                           lambda x: F.contains(low, F.lower(x))), F.lit(0))
    country = F.nullif(J.first_value(local, "$.address.addressCountry"), F.lit(""))
    return F.coalesce(found, country, F.lit(""))


def location(signals: DataFrame, variant: str = "signals") -> DataFrame:
    """Schema locality of any page wins over text; within each the first page wins."""
    if variant != "signals":
        return _first_filled(signals, page_location(variant), "location", latest=variant == "context")
    local = J.blocks_of_type("jsonld", "LocalBusiness")
    rows = signals.select(
        "site", "page_id", F.nullif(J.first_value(local, "$.address.addressLocality"), F.lit("")).alias("s"),
        F.nullif(rx("text", PLACE_IN_TEXT), F.lit("")).alias("t"))
    return rows.groupBy("site").agg(
        F.coalesce(F.min_by("s", F.when(c("s").isNotNull(), c("page_id"))),
                   F.min_by("t", F.when(c("t").isNotNull(), c("page_id"))), F.lit("")).alias("location"))


def industry_first(text: Column) -> Column:
    low = F.lower(text)
    out = None
    for name, words in fv.INDUSTRY_FIRST_KEYWORDS.items():
        cond = any_of(low, words)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("General")


def industry_best(signals: DataFrame, short: bool = False) -> DataFrame:
    """Industry with most keywords present anywhere in the site's titles, metas and h1s.

    One ``max`` per keyword keeps this a single aggregation; ties go to the industry declared first.
    """
    table = fv.INDUSTRY_KEYWORDS_SHORT if short else fv.INDUSTRY_KEYWORDS
    wide = signals.select("site", _industry_text().alias("_b")).groupBy("site").agg(*_industry_flags(table))
    return _with_industry(wide, table, "site").select("site", "industry", "score")


def _industry_text() -> Column:
    return F.lower(F.concat(F.lit(" "), c("title"), F.lit(" "), F.coalesce("meta", F.lit("")), F.lit(" "),
                            F.array_join(F.transform("h1", lambda h: F.concat(F.lit(" "), h, F.lit(" "))), "")))


def _industry_flags(table: dict[str, list[str]]) -> list[Column]:
    return [F.max(F.contains("_b", F.lit(w)).cast("int")).alias(f"{ind}_{i}")
            for ind, ws in table.items() for i, w in enumerate(ws)]


def _with_industry(wide: DataFrame, table: dict[str, list[str]], *keep: str) -> DataFrame:
    """``keep``, ``industry`` and its ``score`` from one flag per keyword."""
    scored = wide.select(*keep, *[
        sum((c(f"{ind}_{i}") for i in range(1, len(ws))), c(f"{ind}_0")).cast("bigint").alias(f"_{ind}")
        for ind, ws in table.items()])
    best = F.greatest(*[c(f"_{ind}") for ind in table])
    pick = None
    for ind in table:
        pick = F.when(c(f"_{ind}") == best, ind) if pick is None else pick.when(c(f"_{ind}") == best, ind)
    return scored.select(*keep, F.when(best == 0, F.lit("corporate")).otherwise(pick).alias("industry"),
                         best.alias("score"))


def profile(signals: DataFrame) -> DataFrame:
    """``site, pages, brand, description, location, industry`` in one aggregation over one extraction."""
    table = fv.INDUSTRY_KEYWORDS
    local = J.blocks_of_type("jsonld", "LocalBusiness")
    rows = signals.select(
        "site", "page_id", page_brand().alias("_brand"), page_description().alias("_description"),
        J.first_value(local, "$.address.addressLocality").alias("_local"),
        rx("text", PLACE_IN_TEXT).alias("_text_place"), _industry_text().alias("_b"))

    def first(name: str) -> Column:
        return F.min_by(name, F.when(F.coalesce(c(name), F.lit("")) != "", c("page_id")))

    wide = rows.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"), first("_brand").alias("brand"), first("_description").alias("description"),
        F.coalesce(first("_local"), first("_text_place"), F.lit("")).alias("location"), *_industry_flags(table))
    return _with_industry(wide, table, "site", "pages", "brand", "description", "location").drop("score")


def page_languages(signals: DataFrame) -> DataFrame:
    """Guessed language of title, description and keywords of each page."""
    blob = F.concat_ws(" ", "title", F.coalesce("meta", F.lit("")), F.array_join("keywords", " "))
    pre = signals.select("page_id", "site", T.tokens(blob).alias("_t"))
    return pre.select("page_id", "site", T.guess_language("_t").alias("language"))


def site_language_mix(signals: DataFrame) -> DataFrame:
    counted = page_languages(signals).groupBy("site", "language").agg(
        F.count_if(c("language") != "").alias("pages"))
    return counted.where(c("pages") > 0)


def site_languages(signals: DataFrame) -> DataFrame:
    """Declared languages (``<html lang>``) per site."""
    return signals.groupBy("site", "lang").agg(F.count("lang").alias("pages")).where(c("pages") > 0)


def primary_keyword(signals: DataFrame) -> DataFrame:
    return signals.select("page_id", "site", primary_keyword_col().alias("keyword"))


def primary_keyword_col() -> Column:
    kw = F.nullif(F.trim(F.get(F.filter("keywords", lambda k: F.trim(k) != ""), F.lit(0))), F.lit(""))
    head = F.trim(F.element_at(F.split(c("title"), r"\s*[|\-–]\s*"), 1))
    return F.coalesce(kw, F.nullif(U.slug_keyword("url"), F.lit("")), head, F.lit(""))


# --- roll-ups ------------------------------------------------------------------------------------
def site_rollup(signals: DataFrame) -> DataFrame:
    """Totals per site, counted per (site, language) first so that languages need no collected set."""
    robots = F.lower(F.coalesce("meta_robots", F.lit("")))
    blocked = c("blocked_by_robots") if "blocked_by_robots" in signals.columns else F.lit(False)
    part = signals.select(
        "site", "lang", F.coalesce("canonical", F.lit("")).alias("canonical"), robots.alias("_r"),
        F.coalesce(blocked, F.lit(False)).alias("_b"),
        F.size(F.filter("images", lambda i: i["alt"] == "")).alias("_alt"),
    ).groupBy("site", "lang").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(c("canonical") != "").alias("pages_with_canonical"),
        F.count_if(c("_r").contains("index")).alias("index_pages"),
        F.count_if(c("_r").contains("noindex")).alias("noindex_pages"),
        F.count_if(c("_r").contains("index") & ~c("_r").contains("noindex")).alias("index_only_pages"),
        F.count_if("_b").alias("pages_blocked_by_robots"), F.sum("_alt").alias("images_missing_alt"))
    return part.groupBy("site").agg(
        F.sum("pages").alias("pages"), F.count("lang").alias("n_languages"),
        *[F.sum(n).alias(n) for n in ("pages_with_canonical", "index_pages", "noindex_pages", "index_only_pages",
                                      "pages_blocked_by_robots", "images_missing_alt")])


def pillar_scores(signals: DataFrame) -> DataFrame:
    """Word-count weighted pillar scores 0–100 per site, their mean, and the search/answer mean.

    Points are summed inside the row, so the aggregation reads one narrow row per page.
    """
    pts = C.page_points(signals, "pillars").select(
        "site", F.greatest("word_count", F.lit(1)).alias("w"), *[f"points_{p}" for p in C.PILLAR_MAX])
    sums = pts.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("w").alias("w"),
        *[F.sum(c(f"points_{p}") * c("w")).alias(p) for p in C.PILLAR_MAX])
    return _score_columns(sums)


def _score_columns(sums: DataFrame) -> DataFrame:
    names = {"SEO": "seo", "AEO": "aeo", "GEO": "geo", "A11Y": "a11y", "TECH": "technical"}
    pct = {p: F.greatest(F.lit(0), F.least(F.lit(100), F.bround(
        c(p).cast("double") * 100.0 / (c("w").cast("double") * float(m)), 0).cast("bigint")))
        for p, m in C.PILLAR_MAX.items()}
    scored = sums.select("site", "pages", *[v.alias(names[p]) for p, v in pct.items()])
    total = c("seo") + c("aeo") + c("geo") + c("a11y") + c("technical")
    return scored.withColumn("overall", F.bround(total / 5.0, 0).cast("bigint")).withColumn(
        "combined", F.bround((c("seo") + c("aeo")) / 2.0, 0).cast("bigint"))


def task_counts(check_rows: DataFrame, k: int = fv.MAX_SITE_TASKS) -> DataFrame:
    """Most frequent failing tasks per site and pillar: ``site, pillar, rank, task, pages, label``."""
    counted = check_rows.where(c("task").isNotNull()).groupBy("site", "pillar", "task").agg(
        F.count(F.lit(1)).alias("pages"))
    w = Window.partitionBy("site", "pillar").orderBy(c("pages").desc(), c("task"))
    top = counted.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k)
    return top.withColumn("label", F.concat("task", F.lit(" (x"), c("pages").cast("string"), F.lit(")")))


def site_tasks(check_rows: DataFrame) -> DataFrame:
    """Distinct open tasks per site and pillar."""
    return check_rows.where(c("task").isNotNull()).select("site", "pillar", "task").distinct()


def detected_counts(signals: DataFrame) -> DataFrame:
    """Pages per detected language, city and country: ``site, kind, value, pages``."""
    flagged = C.with_page_flags(signals)
    blob = F.concat_ws(" ", "title", "f_meta", F.array_join("keywords", " "))
    pre = flagged.select("site", "f_city", "f_country", T.tokens(blob).alias("_t"))
    rows = F.array(
        F.struct(F.lit("language").alias("kind"), T.guess_language("_t").alias("value")),
        F.struct(F.lit("city").alias("kind"), c("f_city").alias("value")),
        F.struct(F.lit("country").alias("kind"), c("f_country").alias("value")))
    return pre.select("site", F.explode(rows).alias("r")).select("site", "r.*").where(c("value") != "").groupBy(
        "site", "kind", "value").agg(F.count(F.lit(1)).alias("pages"))


def pages_detail(signals: DataFrame) -> DataFrame:
    """Per page: points of the search and answer pillars, language, place, first three open tasks of each."""
    flagged = C.page_points(signals, "pillars")
    checks = C.pillar_checks()

    def first_tasks(pillar: str) -> Column:
        tasks = F.array_compact(F.array(*[k.task for k in checks if k.pillar == pillar]))
        return F.array_join(F.slice(tasks, 1, fv.MAX_PAGE_TASKS), " | ")

    blob = F.concat_ws(" ", "title", "f_meta", F.array_join("keywords", " "))
    return flagged.select(
        "page_id", "site", "url", "title", "word_count", c("points_SEO").alias("seo_points"),
        c("points_AEO").alias("aeo_points"), T.guess_language(T.tokens(blob)).alias("language"),
        c("f_city").alias("city"), c("f_country").alias("country"), first_tasks("SEO").alias("top_seo_tasks"),
        first_tasks("AEO").alias("top_aeo_tasks"))


def answer_scores(signals: DataFrame) -> DataFrame:
    """Answer and geographic scores of the rule checks: share of possible points, weighted 0.6 / 0.4."""
    pts = C.page_points(signals, "answers").select("site", "points_AEO", "points_GEO")
    sums = pts.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("points_AEO").alias("a"), F.sum("points_GEO").alias("g"))
    top_a = sum(k.max_points for k in C.answer_checks() if k.pillar == "AEO")
    top_g = sum(k.max_points for k in C.answer_checks() if k.pillar == "GEO")
    scored = sums.select(
        "site", "pages", F.floor(c("a") / (c("pages") * top_a) * 100).cast("bigint").alias("aeo"),
        F.floor(c("g") / (c("pages") * top_g) * 100).cast("bigint").alias("geo"))
    return scored.withColumn("overall", c("aeo") * F.lit(0.6).cast("double") + c("geo") * F.lit(0.4).cast("double"))


def site_mean_scores(breakdown: DataFrame) -> DataFrame:
    """Truncated means of the page breakdown scores."""
    return mean_scores_of(breakdown.groupBy("site").agg(
        F.count(F.lit(1)).alias("total_pages"), F.sum("aeo").alias("aeo"), F.sum("geo").alias("geo")))


def mean_scores_of(totals: DataFrame) -> DataFrame:
    """The means, from one row of sums per site."""
    means = totals.select("site", c("total_pages").alias("pages"), *[
        F.floor(c(n) / c("total_pages")).cast("bigint").alias(n) for n in ("aeo", "geo")])
    return means.withColumn("overall", F.floor((c("aeo") + c("geo")) / 2).cast("bigint"))


def breakdown_totals(signals: DataFrame, lang: str = "en") -> DataFrame:
    """One row of sums per site, out of one extraction: ``mean_scores_of``, ``coverage_of`` and ``platform_of`` read it."""
    checks, names = C.breakdown_checks(), list(fv.PLATFORM_MARKERS)
    rows = C.with_breakdown_flags(signals, lang).select(
        "site", *[k.points.alias(f"p_{k.name}") for k in checks], *[k.present.cast("int").alias(f"n_{k.name}") for k in checks],
        *[F.element_at(c("platform_hits"), i + 1)["hits"].alias(n) for i, n in enumerate(names)])

    def capped(pillar: str) -> Column:
        own = [c(f"p_{k.name}") for k in checks if k.pillar == pillar]
        return F.least(F.lit(100), sum(own[1:], own[0]).cast("bigint"))

    return rows.groupBy("site").agg(
        F.count(F.lit(1)).alias("total_pages"), F.sum(capped("AEO")).alias("aeo"), F.sum(capped("GEO")).alias("geo"),
        *[F.sum(f"p_{k.name}").alias(f"p_{k.name}") for k in checks], *[F.sum(f"n_{k.name}").alias(f"n_{k.name}") for k in checks],
        *[F.sum(n).alias(n) for n in names])


def signal_coverage(signals: DataFrame, lang: str = "en") -> DataFrame:
    """Per site and signal: pages with it, total points, coverage, mean and strength.

    Eleven signals are two sums each in one aggregation; the long form is unpivoted from one row per site.
    """
    flagged = C.with_breakdown_flags(signals, lang)
    checks = C.breakdown_checks()
    pre = flagged.select("site", *[k.points.alias(f"p_{k.name}") for k in checks],
                         *[k.present.cast("int").alias(f"n_{k.name}") for k in checks])
    wide = pre.groupBy("site").agg(
        F.count(F.lit(1)).alias("total_pages"), *[F.sum(f"p_{k.name}").alias(f"p_{k.name}") for k in checks],
        *[F.sum(f"n_{k.name}").alias(f"n_{k.name}") for k in checks])
    return coverage_of(wide)


def coverage_of(wide: DataFrame) -> DataFrame:
    """The coverage, from one row of sums per site."""
    checks = C.breakdown_checks()
    rows = F.array(*[F.struct(
        F.lit(k.pillar).alias("pillar"), F.lit(k.name).alias("check"), c(f"n_{k.name}").alias("pages_with_signal"),
        c(f"p_{k.name}").alias("total_score"), F.lit(k.max_points).cast("bigint").alias("max_points"))
        for k in checks])
    long = wide.select("site", "total_pages", F.explode(rows).alias("r")).select("site", "total_pages", "r.*")
    cov = F.floor(c("pages_with_signal") / c("total_pages") * 100).cast("bigint")
    return long.withColumn("coverage", cov).withColumn(
        "average", F.floor(c("total_score") / c("total_pages")).cast("bigint")).withColumn(
        "strength", F.when(c("coverage") >= 80, "strong").when(c("coverage") >= 50, "moderate").otherwise("weak"))


def fetch_stats(pages: DataFrame) -> DataFrame:
    """Pages per fetch method and the protection status of the site: one aggregation, then its site totals."""
    method = F.coalesce("fetch_method", F.lit("unknown"))
    by_method = pages.groupBy("site", method.alias("fetch_method")).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(c("fetch_status") == "blocked_by_protection").alias("blocked"))
    w = Window.partitionBy("site")
    return by_method.withColumn("site_blocked", F.sum("blocked").over(w)).withColumn(
        "protection_status", F.when(c("site_blocked") > 0, "blocked").otherwise("accessible"))


def platform(signals: DataFrame) -> DataFrame:
    """Platform with most marker hits over all pages of a site; ``custom`` when none hit."""
    names = list(fv.PLATFORM_MARKERS)
    pre = signals.select("site", *[F.element_at(c("platform_hits"), i + 1)["hits"].alias(n) for i, n in enumerate(names)])
    return platform_of(pre.groupBy("site").agg(*[F.sum(n).alias(n) for n in names]))


def platform_of(sums: DataFrame) -> DataFrame:
    """The platform, from one row of sums per site."""
    names = list(fv.PLATFORM_MARKERS)
    best = F.greatest(*[c(n) for n in names])
    pick = None
    for n in names:
        pick = F.when(c(n) == best, n) if pick is None else pick.when(c(n) == best, n)
    return sums.select("site", F.when(best == 0, F.lit("custom")).otherwise(pick).alias("platform"), best.alias("hits"))


def issue_counts(signals: DataFrame) -> DataFrame:
    low = F.lower("url")
    pre = signals.select(
        "site", (c("title") == "").alias("t"), (F.coalesce("meta", F.lit("")) == "").alias("m"),
        (F.size("h1") == 0).alias("h"), F.size("images").alias("i"), low.contains("contact").alias("ct"),
        low.contains("product").alias("pr"))
    return pre.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if("t").alias("missing_titles"),
        F.count_if("m").alias("missing_meta"), F.count_if("h").alias("missing_h1"), F.sum("i").alias("total_images"),
        F.max("ct").alias("has_contact_info"), F.max("pr").alias("has_products"))


def optimize_candidates(signals: DataFrame, limit: int = 10) -> DataFrame:
    """Pages with most words per site; the rank filter is pushed below the shuffle as a group limit."""
    w = Window.partitionBy("site").orderBy(c("word_count").desc(), c("page_id"))
    return signals.withColumn("rank", F.row_number().over(w)).where(c("rank") <= limit)


def score_requested(requested: DataFrame, signals: DataFrame) -> DataFrame:
    """One score row per requested site; a site without pages keeps a row with ``error``."""
    scores = pillar_scores(signals)
    joined = requested.select("site").distinct().join(scores, "site", "left")
    return joined.withColumn("error", F.when(c("pages").isNull(), F.lit("Audit has no pages")))
