"""Brand visibility in stored answers: ``site, query_id, category, brand, response``.

Evaluations are column expressions on the answer row; summaries are map-side combined aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as fv
from ..functions import text as T
from ..functions.exprs import as_col, count_of, entries, message
from .page_rows import next_words

c = F.col


def brand_detection(answers: DataFrame, response: str = "response", brand: str = "brand") -> DataFrame:
    """Adds ``exact_mentions, partial_mentions, strength, is_mentioned``."""
    low, low_brand = F.lower(response), F.lower(brand)
    first_word = F.coalesce(F.get(F.filter(F.split(low_brand, r"\s+"), lambda w: w != ""), F.lit(0)), F.lit(""))
    counted = answers.withColumn("exact_mentions", T.count_substring(low, low_brand).cast("bigint")).withColumn(
        "partial_mentions", T.count_substring(low, first_word).cast("bigint"))
    strength = (F.when(c("exact_mentions") >= 2, "Strong").when(c("exact_mentions") >= 1, "Medium")
                .when(c("partial_mentions") >= 1, "Weak").otherwise("None"))
    return counted.withColumn("strength", strength).withColumn(
        "is_mentioned", (c("exact_mentions") > 0) | (c("partial_mentions") > 0))


def brand_mentioned(response, brand) -> Column:
    return F.contains(F.lower(as_col(response)), F.lower(as_col(brand)))


def brand_mentioned_fuzzy(response, brand) -> Column:
    """Exact substring, or at least 70 % of the words of a brand of several words."""
    low, low_brand = F.lower(as_col(response)), F.lower(as_col(brand))
    words = F.filter(F.split(low_brand, r"\s+"), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: F.contains(low, w)))
    return F.contains(low, low_brand) | ((F.size(words) > 1) & (hits >= F.size(words) * F.lit(0.7).cast("double")))


def answer_competitors(response, brand, limit: int | None = 5) -> Column:
    """Capitalised names near the first occurrence of an indicator, not the brand: first five by name."""
    text, low_brand = as_col(response), F.lower(as_col(brand))
    low = F.lower(text)

    def near(indicator: str) -> Column:
        at = F.instr(low, indicator)  # 1-based, 0 when absent
        start = F.greatest(at - 100, F.lit(1))
        window = F.when(at > 0, F.substring(text, start, at + 200 - start)).otherwise(F.lit(""))
        return T.capitalised_names(window)

    names = F.array_distinct(F.concat(*[near(i) for i in fv.COMPETITOR_INDICATORS]))
    kept = F.array_sort(F.filter(names, lambda n: (F.lower(n) != low_brand) & (F.length(n) > 2)))
    return kept if limit is None else F.slice(kept, 1, limit)


def answer_names(response, brand, limit: int | None = 5) -> Column:
    """Capitalised names and acronyms of the whole answer, minus the brand and filler words: first five by name."""
    text, low_brand = as_col(response), F.lower(as_col(brand))
    names = F.array_distinct(F.concat(T.capitalised_names(text), T.acronyms(text)))
    kept = F.array_sort(F.filter(names, lambda n: (F.lower(n) != low_brand) & (F.length(n) > 2)
                                 & ~F.lower(n).isin(fv.NAME_STOP_WORDS)))
    return kept if limit is None else F.slice(kept, 1, limit)


def recommendation_strength(response, brand) -> Column:
    low = F.lower(as_col(response))
    strong, weak = count_of(low, fv.STRONG_WORDS), count_of(low, fv.WEAK_WORDS)
    return (F.when(~brand_mentioned(response, brand), "Not mentioned").when(strong > weak, "Best option")
            .otherwise("One of many"))


def evaluate_answers(answers: DataFrame) -> DataFrame:
    """All rule evaluations of each answer."""
    return brand_detection(answers).withColumn(
        "competitors", answer_competitors("response", "brand")).withColumn(
        "recommendation", recommendation_strength("response", "brand"))


def category_weight(category="category") -> Column:
    pairs = [x for k, v in fv.CATEGORY_WEIGHTS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), as_col(category)), F.lit(1.0))


def visibility_summary(evaluated: DataFrame) -> DataFrame:
    """Per site: weighted visibility, share of voice, mean strength of mentions, totals."""
    pre = evaluated.select(
        "site", category_weight().alias("w"), "is_mentioned", F.size("competitors").alias("k"),
        F.when(c("is_mentioned"), F.when(c("strength") == "Strong", 3).when(c("strength") == "Medium", 2)
               .when(c("strength") == "Weak", 1)).alias("s"))
    sums = pre.groupBy("site").agg(
        F.count(F.lit(1)).alias("total_queries"), F.count_if("is_mentioned").alias("brand_mentions"),
        F.sum("k").alias("competitor_mentions"), F.sum("w").alias("total_weight"),
        F.sum(F.when(c("is_mentioned"), c("w")).otherwise(0.0)).alias("weighted_score"), F.avg("s").alias("_s"))
    voices = c("brand_mentions") + c("competitor_mentions")
    return sums.select(
        "site", F.bround(c("weighted_score") / c("total_weight") * 100, 1).alias("visibility_score"),
        F.when(voices == 0, 0.0).otherwise(F.bround(c("brand_mentions") / voices * 100, 1)).alias("share_of_ai_voice"),
        F.bround(F.coalesce("_s", F.lit(0.0)), 1).alias("strength_score"),
        "total_queries", "brand_mentions", "competitor_mentions", "total_weight", "weighted_score")


def top_competitors(evaluated: DataFrame, k: int = 5) -> DataFrame:
    counted = evaluated.select("site", F.explode(entries("competitors")).alias("name")).groupBy("site", "name").agg(
        F.count(F.lit(1)).alias("mentions"))
    w = Window.partitionBy("site").orderBy(c("mentions").desc(), c("name"))
    return counted.withColumn("rank", F.row_number().over(w)).where(c("rank") <= k)


def simple_visibility(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("site").agg(
        F.floor(F.count_if("is_mentioned") * 100 / F.count(F.lit(1)) + 0.5).cast("bigint").alias("visibility"))


def page_visibility(signals: DataFrame, brands: DataFrame, kind: str = "page") -> DataFrame:
    """Mentions of the site's brand per page, scored, for each default query of the brand.

    ``brands(site, brand)`` has one row per site; queries are expanded inside the row, so there is no product join.
    """
    from .recommend import default_queries_array  # the template lives with the other templates
    from .skew import salted_lookup

    pre = signals.select("page_id", "site", "title", "text", F.coalesce("meta", F.lit("")).alias("meta"))
    known = salted_lookup(pre, brands.select("site", "brand"), ["site"], "page_id", "inner")
    low = F.lower("brand")
    counted = known.select(
        "page_id", "site", "brand", T.count_substring(F.lower("text"), low).alias("n_text"),
        T.count_substring(F.lower("title"), low).alias("n_title"),
        T.count_substring(F.lower("meta"), low).alias("n_meta"))
    scored = counted.select(
        "page_id", "site", "brand", (c("n_text") > 0).alias("mentioned"),
        F.least(F.lit(100), c("n_text") * 10 + c("n_title") * 20 + c("n_meta") * 15).cast("bigint").alias("visibility"))
    return scored.select("*", (c("visibility") > 50).alias("snippet_potential"),
                         F.explode(default_queries_array(kind)).alias("query"))


def visibility_advice(scored: DataFrame, visibility: str = "visibility") -> DataFrame:
    tier = F.when(c(visibility) < 30, "low").when(c(visibility) < 60, "middle").otherwise("high")
    rows = F.when(tier == "low", F.array(*map(F.lit, fv.VISIBILITY_ADVICE["low"]))).when(
        tier == "middle", F.array(*map(F.lit, fv.VISIBILITY_ADVICE["middle"]))).otherwise(
        F.array(*map(F.lit, fv.VISIBILITY_ADVICE["high"])))
    keys = [n for n in ("page_id", "site", "brand") if n in scored.columns]
    return scored.select(*keys, visibility).distinct().select(*keys, visibility, F.explode(rows).alias("advice"))


def answer_advice(query, brand, mentioned: Column, first_competitor: Column, stored: bool = False) -> Column:
    """Message by (brand mentioned, competitors present)."""
    query, brand = as_col(query), as_col(brand)
    rivals = F.coalesce(first_competitor, F.lit("")) != ""
    versus = message(fv.TEXTS["brand_is_mentioned_but"], brand=brand, rival=first_competitor)
    if stored:
        return (F.when(mentioned & ~rivals,
                       F.lit(fv.TEXTS["excellent_brand_is_mentioned"]))
                .when(mentioned, versus)
                .otherwise(message(fv.TEXTS["brand_is_missing_from"], query=query, brand=brand)))
    return (F.when(mentioned & ~rivals, F.lit(fv.TEXTS["no_action_needed_brand"]))
            .when(mentioned, versus)
            .when(rivals, message(fv.TEXTS["brand_missing_from_answer"], query=query))
            .otherwise(message(fv.TEXTS["brand_not_visible_create"], query=query)))


def answer_report(answers: DataFrame, stored: bool = False) -> DataFrame:
    """``site, query_id, brand_mentioned, first_competitor, recommendation`` of each answer with its query text."""
    rivals = next_words(c("response")) if stored else answer_names("response", "brand")
    hit = brand_mentioned("response", "brand") if stored else brand_mentioned_fuzzy("response", "brand")
    pre = answers.select("site", "query_id", "query", "brand", hit.alias("brand_mentioned"),
                         F.coalesce(F.get(rivals, F.lit(0)), F.lit("")).alias("first_competitor"))
    return pre.withColumn("recommendation", answer_advice(
        "query", "brand", c("brand_mentioned"), c("first_competitor"), stored))


def select_queries(queries: DataFrame, chosen: DataFrame, limit: int = 8) -> tuple[DataFrame, DataFrame]:
    """Queries whose ``(site, query_id)`` was chosen, and per site an error row where the choice is not valid.

    A site with an error gets no queries.
    """
    wanted = chosen.select("site", "query_id").distinct()
    picked = queries.join(wanted, ["site", "query_id"], "left_semi")
    missing = wanted.join(queries.select("site", "query_id"), ["site", "query_id"], "left_anti").groupBy("site").agg(
        F.count(F.lit(1)).alias("missing"))
    sizes = wanted.groupBy("site").agg(F.count(F.lit(1)).alias("chosen"))
    errors = sizes.join(missing, "site", "left").select(
        "site", F.when(c("chosen") > limit, message(fv.TEXTS["maximum_queries_allowed"], limit=F.lit(str(limit))))
        .when(c("missing") > 0, F.lit(fv.TEXTS["some_selected_queries_not"])).alias("error")).where(c("error").isNotNull())
    return picked.join(errors.select("site"), "site", "left_anti"), errors


def category_counts(queries: DataFrame) -> DataFrame:
    return queries.groupBy("site", "category").agg(F.count(F.lit(1)).alias("queries"))
