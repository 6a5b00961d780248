"""Templates and suggestions.  Templates are literals expanded inside the row, so nothing is cross joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as fv
from ..functions import text as T
from ..functions import urls as U
from ..functions.exprs import any_of, message, texts
from .page_rows import text_pairs
from .site import primary_keyword_col

c = F.col


def fill(template: str, **slots: Column) -> Column:
    """``message`` with an empty string for a slot that is null."""
    return message(template, **{k: F.coalesce(v, F.lit("")) for k, v in slots.items()})


# --- queries and keywords ------------------------------------------------------------------------
def fallback_queries(profile: DataFrame) -> DataFrame:
    """Twenty queries per site: ``site, query_id, category, text``.

    ``profile(site, brand, product, location, industry)``; the local queries are replaced by product queries where
    the location is empty.
    """
    place = F.coalesce("location", F.lit(""))
    slots = {
        "brand": c("brand"), "location": place,
        "product": F.coalesce(F.nullif("product", F.lit("")), F.lit(fv.FALLBACK_PRODUCT)),
        "industry": F.coalesce("industry", F.lit("business")),
    }
    rows = F.array_compact(F.array(*[
        F.when(F.lit(True) if local is None else ((place != "") if local else (place == "")),
               F.struct(F.lit(i).cast("bigint").alias("query_id"), F.lit(cat).alias("category"),
                        fill(text, **slots).alias("text")))
        for i, cat, local, text in fv.QUERY_TEMPLATES]))
    return profile.select("site", F.explode(rows).alias("r")).select("site", "r.*")


def default_queries_array(kind: str = "brand") -> Column:
    slots = {"brand": c("brand")}
    if kind == "brand":
        slots["industry"] = c("industry")
    return F.array(*[fill(t, **slots) for t in fv.DEFAULT_QUERIES[kind]])


def default_queries(profile: DataFrame, kind: str = "brand") -> DataFrame:
    return profile.select("site", F.posexplode(default_queries_array(kind)).alias("pos", "query"))


def custom_queries(generated: DataFrame, custom: DataFrame, limit: int = 20) -> DataFrame:
    """Generated queries first, then the site's own ones, at most twenty per site."""
    own = custom.select("site", (F.lit(1_000_000) + c("pos")).cast("bigint").alias("_o"),
                        F.lit("custom").alias("category"), "text")
    both = generated.select("site", c("query_id").alias("_o"), "category", "text").unionByName(own)
    w = Window.partitionBy("site").orderBy("_o")
    return both.withColumn("query_id", F.row_number().over(w).cast("bigint")).where(c("query_id") <= limit).drop("_o")


def keyword_ideas(profile: DataFrame, mode: str = "AEO") -> DataFrame:
    """Keyword and question ideas per site, first six and five.

    ``profile(site, brand, location, industry, products ARRAY<STRING>, competitor)``.
    """
    slots = {n: F.coalesce(c(n), F.lit("")) for n in ("brand", "location", "industry", "competitor")}
    templates = fv.AEO_TEMPLATES if mode == "AEO" else fv.GEO_TEMPLATES

    def row(t, rep: int, product: Column | None) -> Column:
        kind, pos, _, needs, text, kind_type, volume, difficulty, intent, potential, category = t
        filled = fill(text, **slots, **({} if product is None else {"product": product}))
        cond = F.lit(True)
        for need in (needs or "").split("+"):
            if need:
                cond = cond & (slots[need] != "")
        if product is not None:
            cond = cond & product.isNotNull()
        return F.when(cond, F.struct(
            F.lit(kind).alias("kind"), F.lit(order_of(t, rep)).alias("_o"), filled.alias("text"),
            F.lit(kind_type).alias("type"), F.lit(volume).alias("search_volume"),
            F.lit(difficulty).alias("difficulty"), F.lit(intent).alias("intent"),
            F.lit(potential).alias("potential"), F.lit(category).alias("category")))

    def order_of(t, rep: int) -> int:
        """Templates of one product stay together: product first, then template."""
        same = [x for x in templates if x[0] == t[0] and x[2] == t[2]]
        base = min(x[1] for x in same) if t[2] else t[1]
        return base * 100 + rep * 10 + (t[1] - base)

    entries = []
    for t in templates:
        if t[2] == 0:
            entries.append(row(t, 0, None))
        else:
            entries += [row(t, i, F.get(c("products"), F.lit(i))) for i in range(t[2])]
    ideas = F.array_sort(F.array_compact(F.array(*entries)), lambda a, b: F.when(a["_o"] < b["_o"], -1).when(
        a["_o"] > b["_o"], 1).otherwise(0))

    def first(kind: str, n: int) -> Column:
        return F.transform(F.slice(F.filter("_ideas", lambda r: r["kind"] == kind), 1, n),
                           lambda r, i: F.struct((i + 1).cast("bigint").alias("rank"), r.alias("r")))

    pre = profile.select("site", ideas.alias("_ideas"))
    out = pre.select("site", F.explode(F.concat(first("keyword", fv.MAX_KEYWORDS), first("question", fv.MAX_QUESTIONS))).alias("x"))
    return out.select("site", F.lit(mode).alias("mode"), c("x.rank").alias("rank"), "x.r.*").drop("_o")


# --- advice --------------------------------------------------------------------------------------
def site_recommendations(coverage: DataFrame, mean_scores: DataFrame) -> DataFrame:
    """Advice rows per site: weak signals, weakest signal of each pillar, quick wins."""
    pairs = [x for k, v in fv.SITE_ADVICE.items() for x in (F.lit(k), F.lit(v))]
    advice = F.create_map(*pairs)
    from .checks import SIGNAL_ORDER

    order = F.array_position(F.array(*[F.lit(n) for n in SIGNAL_ORDER]), c("check"))
    weak = coverage.where(c("coverage") < 50).select(
        "site", F.lower("pillar").alias("kind"), F.element_at(advice, c("check")).alias("advice"))
    lowest = coverage.groupBy("site", "pillar").agg(
        F.min(F.struct(c("coverage"), order.alias("o"), c("check"))).alias("m"))
    priority = lowest.where(c("m.coverage") < 30).select(
        "site", F.lit("priority").alias("kind"), message(
            fv.TEXTS["priority_improve_2"], signal=F.replace(c("m.check"), F.lit("_"), F.lit(" ")),
            share=c("m.coverage").cast("string")).alias("advice"))
    wins = mean_scores.select("site", F.explode(F.concat(
        texts(c("aeo") < 70, *fv.QUICK_WINS["aeo"]), texts(c("geo") < 70, *fv.QUICK_WINS["geo"]))).alias("advice")
    ).select("site", F.lit("quick_win").alias("kind"), "advice")
    return weak.unionByName(priority).unionByName(wins)


def page_recommendations(check_rows: DataFrame) -> DataFrame:
    """Advice for signals of the breakdown below half of their maximum."""
    rows = F.array_compact(F.array(*[
        F.when(c("check") == sig, F.struct(F.lit(cat).alias("category"), F.lit(pri).alias("priority"),
                                           F.lit(title).alias("title"), F.lit(desc).alias("description"),
                                           F.lit(act).alias("action")))
        for sig, cat, pri, title, desc, act in fv.PAGE_ADVICE]))
    low = check_rows.where(c("points") * 2 < c("max_points"))
    return low.select("page_id", "site", F.explode(rows).alias("r")).select("page_id", "site", "r.*")


def faq_advice(has_words: Column, n_pairs: Column, has_schema: Column) -> Column:
    return F.concat(
        texts(~has_words, fv.TEXTS["add_faq_section_with_common"],
              fv.TEXTS["include_questions_like_what"]),
        texts(n_pairs < 3, fv.TEXTS["add_more_q_a"]),
        texts(~has_schema, fv.TEXTS["add_faq_schema_markup"]),
        texts(n_pairs > 0, fv.TEXTS["optimize_existing_q_a"]))


def alt_advice(n_missing: Column) -> Column:
    return texts(n_missing > 0,
                 message(fv.TEXTS["add_descriptive_alt_text_to_images"], n=n_missing.cast("string")),
                 fv.TEXTS["use_specific_descriptive_alt"],
                 fv.TEXTS["avoid_generic_alt_text"],
                 fv.TEXTS["include_relevant_keywords_in"])


def _meta_flags(meta: Column) -> tuple[Column, Column, Column]:
    return (F.length(meta), F.endswith(F.trim(meta), F.lit("?")), any_of(F.lower(meta), fv.META_QUESTION_WORDS))


def meta_advice(meta: Column) -> Column:
    n, asks, words = _meta_flags(meta)
    filled = meta != ""
    return F.concat(
        texts(~filled, fv.TEXTS["add_meta_description_optimized"]),
        texts(filled & ~n.between(150, 160), fv.TEXTS["optimize_meta_description_length_150"]),
        texts(filled & ~asks, fv.TEXTS["consider_question_format_for"]),
        texts(filled & ~words, fv.TEXTS["include_question_words_how_what"]))


def geo_advice(n_hreflang: Column, has_local: Column, completeness: Column, has_words: Column) -> Column:
    return F.concat(
        texts(n_hreflang < 2, fv.TEXTS["implement_hreflang_tags_for"]),
        texts(~has_local, fv.TEXTS["add_localbusiness_or_organization"]),
        texts(completeness < 100, fv.TEXTS["complete_nap_name_address"]),
        texts(~has_words, fv.TEXTS["add_geographic_targeting_signals"],
              fv.TEXTS["include_location_specific_keywords"]))


def optimize_meta(meta: Column) -> Column:
    """Padded, cut or rewritten as a question."""
    n, asks, words = _meta_flags(meta)
    low = F.lower(meta)
    sized = F.when(n < 150, message(fv.TEXTS["learn_more_about_our"], meta=meta)).when(
        n > 160, F.concat(F.substring(meta, 1, 157), F.lit("..."))).otherwise(meta)
    return (F.when(meta == "", F.lit(""))
            .when(~asks & ~words & low.contains("service"), message(fv.TEXTS["what_services_do_we"], meta=meta))
            .when(~asks & ~words & low.contains("about"),
                  message(fv.TEXTS["what_is"], meta=F.replace(low, F.lit("about"), F.lit(""))))
            .otherwise(sized))


def _page_state(signals: DataFrame) -> DataFrame:
    low, low_title = F.lower("text"), F.lower("title")
    schema = F.array_join("jsonld", " ")
    return signals.select(
        "page_id", "site", "url", "title", F.coalesce("meta", F.lit("")).alias("meta"), "images",
        any_of(low, fv.FAQ_WORDS_WIDE).alias("has_faq_content"),
        F.size(text_pairs(c("text"))).alias("n_pairs"),
        (schema.contains("FAQPage") | schema.contains("Question")).alias("has_faq_schema"),
        F.size("images").alias("n_images"),
        F.size(F.filter("images", lambda i: i["alt"] == "")).alias("n_missing"),
        U.tld("host").alias("tld"), F.size("hreflang").alias("n_hreflang"),
        (schema.contains("LocalBusiness") | schema.contains("Organization")).alias("has_local_schema"),
        (((c("phone") != "").cast("int") + (c("address") != "").cast("int")) * 50.0).alias("nap_completeness"),
        (any_of(low, fv.GEO_WORDS) | any_of(low_title, fv.GEO_WORDS)).alias("has_geo_content"))


def faq_analysis(signals: DataFrame) -> DataFrame:
    return _page_state(signals).select("page_id", "site", "has_faq_content",
                                       c("n_pairs").cast("bigint").alias("n_pairs"), "has_faq_schema")


def image_analysis(signals: DataFrame) -> DataFrame:
    return _page_state(signals).select(
        "page_id", "site", c("n_images").cast("bigint").alias("total_images"),
        c("n_missing").cast("bigint").alias("images_without_alt"),
        (c("n_images") - c("n_missing")).cast("bigint").alias("images_with_alt"))


def geo_analysis(signals: DataFrame) -> DataFrame:
    return _page_state(signals).select(
        "page_id", "site", "tld", c("n_hreflang").cast("bigint").alias("n_hreflang"), "has_local_schema",
        "nap_completeness", "has_geo_content")


def page_advice(signals: DataFrame) -> DataFrame:
    """All suggestion rows of a page: ``page_id, site, kind, advice``."""
    s = _page_state(signals)
    faq = faq_advice(c("has_faq_content"), c("n_pairs"), c("has_faq_schema"))
    aeo = F.concat(
        texts(~c("has_faq_content"), fv.TEXTS["add_faq_section_with_common"]),
        texts(~c("has_faq_schema"), fv.TEXTS["add_faq_schema_markup"]),
        texts(c("n_missing") > 0, message(fv.TEXTS["add_alt_text_to"], n=c("n_missing").cast("string"))),
        meta_advice(c("meta")))
    kinds = {
        "faq": faq, "alt": alt_advice(c("n_missing")), "meta": meta_advice(c("meta")),
        "geo": geo_advice(c("n_hreflang"), c("has_local_schema"), c("nap_completeness"), c("has_geo_content")),
        "aeo": aeo,
    }

    def labelled(kind: str, advice: Column) -> Column:
        return F.transform(advice, lambda a: F.struct(F.lit(kind).alias("kind"), a.alias("advice")))

    rows = F.concat(*[labelled(k, arr) for k, arr in kinds.items()])
    return s.select("page_id", "site", F.explode(rows).alias("r")).select("page_id", "site", "r.*")


# --- page suggestions ----------------------------------------------------------------------------
def with_brand(kw: Column, brand: Column) -> Column:
    add = (brand != "") & ~F.contains(F.lower(kw), F.lower(brand))
    return F.when(add, F.concat(kw, F.lit(" | "), brand)).otherwise(kw)


def page_suggestions(signals: DataFrame, brands: DataFrame) -> DataFrame:
    """New title, meta description, h1, slug and language per page; current values stay where they are within limits.

    ``brands(site, brand)`` has one row per site.
    """
    from .skew import salted_lookup

    blob = F.concat_ws(" ", "title", F.coalesce("meta", F.lit("")))
    pre = signals.select(
        "page_id", "site", "url", "title", F.coalesce("meta", F.lit("")).alias("meta"),
        F.coalesce(F.get(F.filter("h1", lambda h: h != ""), F.lit(0)), F.lit("")).alias("h1"), "word_count", "images",
        "phone", "address", "keywords", primary_keyword_col().alias("keyword"),
        F.coalesce(F.nullif(T.guess_language(T.tokens(blob)), F.lit("")), F.lit("en")).alias("language"))
    known = salted_lookup(pre, brands.select("site", "brand"), ["site"], "page_id", "left").withColumn(
        "brand", F.coalesce("brand", F.lit("")))
    base_kw = F.coalesce(F.nullif("keyword", F.lit("")), F.nullif("title", F.lit("")))
    base = F.coalesce(base_kw, F.nullif("brand", F.lit("")), F.lit("Home"))
    titled = known.withColumn("new_title", F.when(F.length("title").between(1, 60), c("title")).otherwise(
        T.shorten(with_brand(base, c("brand")), 60)))
    title_like = F.coalesce(F.nullif("title", F.lit("")), c("new_title"))
    padded = F.when(F.length("meta") < 50, F.trim(F.concat("meta", F.lit(" "), title_like))).otherwise(c("meta"))
    plain = F.when(c("brand") != "", F.concat(title_like, F.lit(" - "), c("brand"))).otherwise(title_like)
    made = F.when(F.length(plain) < 50, F.concat(plain, F.lit("."))).otherwise(plain)
    new_meta = F.when(F.length("meta").between(50, 160), c("meta")).when(
        c("meta") != "", T.shorten(padded, 160)).otherwise(T.shorten(made, 160))
    head = F.trim(F.element_at(F.split(title_like, r"\s*[|\-–]\s*"), 1))
    new_h1 = F.when(F.length("h1").between(1, 70), c("h1")).otherwise(
        T.shorten(F.coalesce(F.nullif("keyword", F.lit("")), head), 70))
    full = titled.withColumn("new_meta", new_meta).withColumn("new_h1", new_h1)
    topic = F.coalesce(F.nullif("keyword", F.lit("")), F.nullif("new_h1", F.lit("")), c("new_title"))
    return full.withColumn("topic", topic).withColumn(
        "new_slug", F.when(U.slug_is_poor("url"), U.slugify("topic")))


def title_suggestions(suggested: DataFrame) -> DataFrame:
    return suggested.select("page_id", "site", "new_title", "new_meta", "new_h1")


def slug_suggestions(suggested: DataFrame) -> DataFrame:
    return suggested.where(U.slug_is_poor("url")).select("page_id", "site", "url", "new_slug")


def alt_suggestions(suggested: DataFrame) -> DataFrame:
    """Alternative text for each image without one: keyword, h1 or file name, with the brand."""
    rows = suggested.select("page_id", "site", "brand", "keyword", "new_h1", F.explode(
        F.filter("images", lambda i: i["alt"] == "")).alias("img"))
    key = F.coalesce(F.nullif(F.trim("keyword"), F.lit("")), F.nullif(F.trim("new_h1"), F.lit("")),
                     F.nullif(U.file_stem(c("img.src")), F.lit("")))
    made = F.coalesce(T.shorten(with_brand(key, c("brand")), 100), F.lit(fv.TEXTS["descriptive_image_of_the"]))
    return rows.select("page_id", "site", c("img.src").alias("src"), made.alias("suggested_alt"))


def alt_suggestions_by_name(signals: DataFrame) -> DataFrame:
    """Variant that goes by words in the file name."""
    rows = signals.select("page_id", "site", "title", F.explode(F.filter("images", lambda i: i["alt"] == "")).alias("img"))
    low = F.lower("img.src")
    or_else = lambda d: F.coalesce(F.nullif("title", F.lit("")), F.lit(fv.TEXTS[d]))
    made = (F.when(low.contains("logo"), message(fv.TEXTS["logo_for"], title=or_else("the_website")))
            .when(low.contains("product"), message(fv.TEXTS["product_image_for_2"], title=or_else("the_product")))
            .when(any_of(low, ["team", "staff"]), F.lit(fv.TEXTS["team_member_photo"]))
            .when(any_of(low, ["office", "building"]), F.lit(fv.TEXTS["office_or_building_image"]))
            .otherwise(message(fv.TEXTS["image_related_to"], title=or_else("the_content"))))
    return rows.select("page_id", "site", c("img.src").alias("src"), made.alias("suggested_alt"))


def faq_prompts(suggested: DataFrame) -> DataFrame:
    """Two questions in the page language, about its topic; English where the language has no prompts."""
    lang, topic = F.substring("language", 1, 2), c("topic")
    pair = None
    for code, (a, b) in fv.FAQ_PROMPTS.items():
        both = F.array(fill(a, x=topic), fill(b, x=topic))
        pair = F.when(lang == code, both) if pair is None else pair.when(lang == code, both)
    pair = pair.otherwise(F.array(*[fill(t, x=topic) for t in fv.FAQ_PROMPTS["en"]]))
    hints = F.array(*[F.lit(h) for h in fv.FAQ_ANSWER_HINTS])
    return suggested.select("page_id", "site", "language", F.posexplode(pair).alias("pos", "q")).withColumn(
        "a", F.element_at(hints, c("pos") + 1))


# --- JSON-LD -------------------------------------------------------------------------------------
def _named(name: str, value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).alias(name)


def faq_jsonld(pairs: Column) -> Column:
    """``ARRAY<STRUCT<question,answer>>`` → FAQPage JSON-LD; '' for an empty list."""
    entities = F.transform(pairs, lambda p: F.struct(
        _named("@type", "Question"), _named("name", p["question"]),
        F.struct(_named("@type", "Answer"), _named("text", p["answer"])).alias("acceptedAnswer")))
    body = F.to_json(F.struct(_named("@context", "https://schema.org"), _named("@type", "FAQPage"),
                              entities.alias("mainEntity")))
    return F.when(F.size(pairs) == 0, F.lit("")).otherwise(body)


def business_jsonld(name: Column, phone: Column, address: Column, url: Column) -> Column:
    return F.to_json(F.struct(
        _named("@context", "https://schema.org"), _named("@type", "LocalBusiness"), _named("name", name),
        _named("telephone", phone),
        F.struct(_named("@type", "PostalAddress"), _named("streetAddress", address)).alias("address"),
        _named("url", url)))


def product_jsonld(name: Column, brand: Column, description: Column) -> Column:
    return F.to_json(F.struct(
        _named("@context", "https://schema.org"), _named("@type", "Product"), _named("name", name),
        _named("brand", brand), _named("description", description),
        F.struct(_named("@type", "Offer"), _named("priceCurrency", "EUR"), _named("price", "0.00"),
                 _named("availability", "https://schema.org/InStock")).alias("offers")))


def org_jsonld(name: Column) -> Column:
    return F.to_json(F.struct(_named("@context", "https://schema.org"), _named("@type", "Organization"),
                              _named("name", name)))


def page_jsonld(suggested: DataFrame) -> DataFrame:
    """JSON-LD of each page where its trigger holds: contact data for a business, URL or keywords for a product."""
    name = F.coalesce(F.nullif("brand", F.lit("")), F.nullif("new_h1", F.lit("")), c("new_title"))
    blob = F.lower(F.concat_ws(" ", F.array_join("keywords", " "), "url"))
    return suggested.select(
        "page_id", "site",
        F.when((c("phone") != "") | (c("address") != ""),
               business_jsonld(name, c("phone"), c("address"), c("url"))).alias("business_jsonld"),
        F.when(any_of(blob, fv.PRODUCT_URL_WORDS),
               product_jsonld(c("topic"), c("brand"), c("new_meta"))).alias("product_jsonld"),
        org_jsonld(c("brand")).alias("org_jsonld"))


def prioritize(recommendations: DataFrame) -> DataFrame:
    """Impact and effort → critical, high, medium or low."""
    i, e = F.coalesce("impact", F.lit("medium")), F.coalesce("effort", F.lit("medium"))
    return recommendations.withColumn(
        "priority", F.when((i == "high") & (e == "low"), "critical").when((i == "high") & (e == "high"), "high")
        .when((i == "low") & (e == "low"), "medium").otherwise("low"))
