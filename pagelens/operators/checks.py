"""Rule checks of a page.

A check is (scheme, pillar, name, points, max points, present, task).  Each scheme is a list of checks whose
points are plain conditions over page columns.  The same list feeds the long table (``check_rows``) and, without
any row explosion, the per-page pillar sums (``page_points``) that site scores aggregate.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import structured as J
from ..functions import urls as U
from ..functions.exprs import any_of, message, rx_sub
from .page_rows import question_headings_array, section_pairs, snippet_score

c = F.col
PILLAR_MAX = {"SEO": 40, "AEO": 35, "GEO": 20, "A11Y": 20, "TECH": 20}


class Check(NamedTuple):
    scheme: str
    pillar: str
    name: str
    points: Column
    max_points: int
    present: Column
    task: Column


def _pass(scheme: str, pillar: str, name: str, cond: Column, points: int, task) -> Check:
    cond = F.coalesce(cond, F.lit(False))
    text = task if isinstance(task, Column) else F.lit(task)
    return Check(scheme, pillar, name, F.when(cond, points).otherwise(0), points, cond,
                 F.when(~cond, text))


# --- pillars ---------------------------------------------------------------------------------------
def with_page_flags(signals: DataFrame) -> DataFrame:
    """Helper flags the pillar checks read; each is one named column, computed once."""
    warn = F.lower(F.array_join("warnings", " | "))
    has = lambda name, default: c(name) if name in signals.columns else F.lit(default)
    flagged = signals.withColumn("_warn", warn).withColumn(
        "_place", F.lower(F.concat_ws(" ", "title", F.coalesce("meta", F.lit("")), F.array_join("keywords", " "))))
    return flagged.select(
        "*",
        F.coalesce(F.get(F.filter("h1", lambda h: h != ""), F.lit(0)), F.lit("")).alias("f_h1"),
        F.coalesce("meta", F.lit("")).alias("f_meta"),
        any_of("_warn", ["missing alt", "image missing alt", "img missing alt"]).alias("f_alt_missing"),
        any_of("_warn", ["missing viewport", "no viewport"]).alias("f_viewport_missing"),
        F.contains("_warn", F.lit("missing og:title")).alias("f_og_title_missing"),
        F.contains("_warn", F.lit("missing og:description")).alias("f_og_description_missing"),
        F.contains("_warn", F.lit("missing og:image")).alias("f_og_image_missing"),
        F.contains("_warn", F.lit("map")).alias("f_map_warning"),
        any_of(F.concat_ws(" ", F.lower(F.array_join("keywords", " ")), "_warn"), fv.REVIEW_WORDS).alias("f_reviews"),
        F.array_join("jsonld", " ").alias("f_schema"),
        U.is_https("url").alias("f_https"),
        U.city_mention("_place").alias("f_city"),
        U.tld_country("host").alias("f_country"),
        F.lower(F.coalesce("meta_robots", F.lit(""))).alias("f_robots"),
        F.coalesce(has("n_broken", 0), F.lit(0)).alias("f_broken"),
        F.coalesce(has("blocked_by_robots", False), F.lit(False)).alias("f_blocked"),
        F.size(F.filter("images", lambda i: i["alt"] == "")).alias("f_images_missing_alt"),
        F.size(F.filter("images", lambda i: (F.coalesce(i["width"], F.lit("")) == "")
                        | (F.coalesce(i["height"], F.lit("")) == ""))).alias("f_images_no_dimensions"),
        F.size(F.filter("images", lambda i: i["loading"] == "lazy")).alias("f_images_lazy"),
    ).drop("_warn", "_place")


def pillar_checks() -> list[Check]:
    """Search, answer, geographic, accessibility and technical pillars over ``with_page_flags`` columns."""
    def seo(name, cond, task):
        return _pass("pillars", "SEO", name, cond, 5, task)

    def aeo(name, cond, task):
        return _pass("pillars", "AEO", name, cond, 5, task)

    n_title, n_h1, n_meta, wc = F.length("title"), F.length("f_h1"), F.length("f_meta"), c("word_count")
    og = [("f_og_title_missing", "og:title"), ("f_og_description_missing", "og:description"),
          ("f_og_image_missing", "og:image")]
    og_any = c(og[0][0]) | c(og[1][0]) | c(og[2][0])
    og_list = F.array_join(F.array_compact(F.array(*[F.when(c(f), F.lit(n)) for f, n in og])), ", ")
    geo = (c("f_city") != "") | (c("f_country") != "")
    typed = c("f_schema").rlike(r'"@type"\s*:\s*"(?:FAQPage|HowTo|Article|Service|Product)"')
    map_task = F.when(c("f_map_warning"), F.lit(fv.TEXTS["embed_google_maps_pin"])).otherwise(
        F.lit(fv.TEXTS["embed_google_maps_pin_and"]))
    return [
        seo("title", n_title.between(1, 60), fv.TEXTS["fix_title_include_main"]),
        seo("h1", n_h1.between(1, 70), fv.TEXTS["add_shorten_h1_and"]),
        seo("meta", n_meta.between(50, 160), fv.TEXTS["fix_meta_description_50"]),
        seo("words", wc >= 500, message(fv.TEXTS["add_more_copy_500"], n=wc.cast("string"))),
        seo("links", c("n_internal") >= 3, fv.TEXTS["add_3_internal_links"]),
        seo("https", c("f_https"), fv.TEXTS["enable_https_redirect_http"]),
        seo("viewport", ~c("f_viewport_missing"), fv.TEXTS["make_page_mobile_friendly"]),
        seo("alt", ~c("f_alt_missing"), fv.TEXTS["add_descriptive_alt_text"]),
        seo("open_graph", ~og_any, message(fv.TEXTS["add_open_graph_meta"], names=og_list)),
        aeo("answers", (wc >= 600) & (c("f_h1") != ""), fv.TEXTS["add_clear_q_a"]),
        aeo("jsonld", c("f_schema").contains('"@context"') & c("f_schema").contains('"@type"'),
            fv.TEXTS["add_json_ld_with"]),
        aeo("schema_type", typed, fv.TEXTS["add_relevant_schema_faqpage"]),
        aeo("place", geo, fv.TEXTS["mention_your_city_region"]),
        aeo("map", ~c("f_map_warning") & ~c("f_og_image_missing") & geo, map_task),
        aeo("reviews", c("f_reviews"), fv.TEXTS["show_2_3_short"]),
        aeo("previews", ~(c("f_og_title_missing") | c("f_og_description_missing")),
            fv.TEXTS["add_og_title_description"]),
        _pass("pillars", "GEO", "place", geo, 10, fv.TEXTS["mention_city_region_in"]),
        _pass("pillars", "GEO", "hreflang", F.size("hreflang") > 0, 5,
              fv.TEXTS["add_hreflang_alternates_for"]),
        _pass("pillars", "GEO", "country", c("f_country") != "", 5, fv.TEXTS["use_country_tld_or"]),
        _pass("pillars", "A11Y", "alt", c("f_images_missing_alt") == 0, 10, fv.TEXTS["add_descriptive_alt_text_to"]),
        _pass("pillars", "A11Y", "dimensions", c("f_images_no_dimensions") == 0, 5,
              fv.TEXTS["set_width_height_for"]),
        _pass("pillars", "A11Y", "lazy", c("f_images_lazy") >= 1, 5, fv.TEXTS["use_loading_lazy_for"]),
        _pass("pillars", "TECH", "https", c("f_https"), 5, fv.TEXTS["serve_over_https_and"]),
        _pass("pillars", "TECH", "canonical", F.coalesce("canonical", F.lit("")) != "", 5,
              fv.TEXTS["add_canonical_link_to"]),
        _pass("pillars", "TECH", "broken", c("f_broken") == 0, 5, fv.TEXTS["fix_broken_internal_links"]),
        _pass("pillars", "TECH", "indexable", ~c("f_blocked") & ~c("f_robots").contains("noindex"), 5,
              fv.TEXTS["ensure_important_pages_are"]),
    ]


# --- answer and geographic scores -------------------------------------------------------------------
def with_answer_flags(signals: DataFrame) -> DataFrame:
    n_img = F.size("images")
    share = F.size(F.filter("images", lambda i: i["alt"] != "")) / n_img * 100
    staged = signals.withColumn("_low", F.lower("text")).withColumn("_low_title", F.lower("title"))
    return staged.select(
        "*",
        F.coalesce("meta", F.lit("")).alias("f_meta"),
        F.array_join("jsonld", " ").alias("f_schema"),
        F.array_join("jsonld_types", " ").alias("f_types"),
        n_img.alias("f_images"),
        F.when(n_img == 0, F.lit(100.0)).otherwise(share).alias("f_alt_share"),
        F.size(F.filter("images", lambda i: i["alt"] == "")).alias("f_no_alt"),
        any_of("_low", fv.FAQ_WORDS).alias("f_faq_words"),
        any_of("text", fv.LIST_MARKERS).alias("f_lists"),
        any_of("_low", fv.CONTENT_QUESTION_PHRASES).alias("f_questions"),
        (any_of("_low", fv.GEO_WORDS) | any_of("_low_title", fv.GEO_WORDS)).alias("f_geo_words"),
        (any_of("_low", fv.LOCAL_WORDS) | any_of("_low_title", fv.LOCAL_WORDS)).alias("f_local_words"),
    ).drop("_low", "_low_title")


def answer_checks() -> list[Check]:
    """Answer-engine checks (maximum 100) and geographic checks (maximum 100) over ``with_answer_flags``."""
    def aeo(name, cond, points, task):
        return _pass("answers", "AEO", name, cond, points, task)

    def geo(name, cond, points, task):
        return _pass("answers", "GEO", name, cond, points, task)

    def gated(check: Check, gate: Column) -> Check:
        """No own task where the gate is closed: another check already reports the cause."""
        return check._replace(points=F.when(gate, check.points).otherwise(0), task=F.when(gate, check.task))

    meta, low_meta = c("f_meta"), F.lower("f_meta")
    has_meta, has_schema = meta != "", F.size("jsonld") > 0
    n_alt = c("f_no_alt").cast("string")
    share = c("f_alt_share")
    alt_points = F.when(share >= 90, 15).when(share >= 70, 10).otherwise(5)
    alt_task = F.when(share >= 90, F.lit(None)).when(
        share >= 70, message(fv.TEXTS["add_alt_text_to"], n=n_alt)).otherwise(
        message(fv.TEXTS["add_descriptive_alt_text_for_ai"], n=n_alt))
    n_lang = F.size("hreflang")
    lang_points = F.when(n_lang >= 2, 25).when(n_lang == 1, 15).otherwise(0)
    lang_task = F.when(n_lang == 0, F.lit(fv.TEXTS["implement_hreflang_tags_for"])).when(
        n_lang == 1, F.lit(fv.TEXTS["add_more_hreflang_tags"]))
    phone, address = c("phone") != "", c("address") != ""
    nap_points = F.when(phone & address, 20).when(phone | address, 10).otherwise(0)
    nap_task = F.when(phone & address, F.lit(None)).when(
        phone | address, F.lit(fv.TEXTS["complete_nap_information_add"])).otherwise(
        F.lit(fv.TEXTS["add_nap_name_address"]))
    return [
        aeo("faq_content", c("f_faq_words"), 15, fv.TEXTS["add_faq_section_with"]),
        aeo("faq_schema", c("f_schema").contains("FAQPage") | c("f_schema").contains("Question"), 10,
            fv.TEXTS["add_faq_schema_markup"]),
        aeo("meta_length", F.length(meta).between(150, 160), 10, F.when(
            has_meta, F.lit(fv.TEXTS["optimize_meta_description_length"])).otherwise(
            F.lit(fv.TEXTS["add_meta_description_optimized"]))),
        gated(aeo("meta_question", F.endswith(F.trim(meta), F.lit("?")), 5,
                  fv.TEXTS["consider_question_format_in"]), has_meta),
        gated(aeo("meta_words", any_of(low_meta, fv.META_QUESTION_WORDS), 5,
                  fv.TEXTS["include_question_words_how"]), has_meta),
        Check("answers", "AEO", "alt_text", alt_points, 15, share >= 90, alt_task),
        aeo("schema_organization", c("f_types").contains("Organization") | c("f_types").contains("WebSite"), 10,
            F.when(has_schema, F.lit(fv.TEXTS["add_organization_or_website"])).otherwise(
                F.lit(fv.TEXTS["add_json_ld_structured"]))),
        gated(aeo("schema_article", c("f_types").contains("Article") | c("f_types").contains("BlogPosting"), 5,
                  fv.TEXTS["consider_adding_article_or"]), has_schema),
        gated(aeo("schema_faq", c("f_types").contains("FAQPage") | c("f_types").contains("Question"), 5,
                  fv.TEXTS["add_faq_schema_markup_for"]), has_schema),
        aeo("structure_h1", F.size("h1") > 0, 5, fv.TEXTS["add_clear_h1_heading"]),
        aeo("structure_h2", F.size("h2") >= 2, 5, fv.TEXTS["add_more_h2_headings"]),
        aeo("structure_lists", c("f_lists"), 5,
            fv.TEXTS["use_bullet_points_or"]),
        aeo("structure_questions", c("f_questions"), 5,
            fv.TEXTS["include_question_answer_format"]),
        Check("answers", "GEO", "hreflang", lang_points, 25, n_lang > 0, lang_task),
        geo("local_schema", c("f_types").contains("LocalBusiness") | c("f_types").contains("Organization"), 20,
            fv.TEXTS["add_localbusiness_or_organization"]),
        Check("answers", "GEO", "nap", nap_points, 20, phone | address, nap_task),
        geo("geo_words", c("f_geo_words"), 20, fv.TEXTS["add_geographic_targeting_signals"]),
        geo("local_words", c("f_local_words"), 15, fv.TEXTS["include_local_business_keywords"]),
    ]


# --- signal breakdown ---------------------------------------------------------------------------------
def nap_consistency_score() -> Column:
    """Name, address and phone of the JSON-LD found again in the page: 33 + 33 + 34."""
    sname, saddr, sphone = c("f_sname"), c("f_saddress"), c("f_sphone")
    digits = lambda s: rx_sub(s, r"[^0-9]")
    name = (sname != "") & (c("title") != "") & F.contains(F.lower("title"), F.lower(sname))
    words = F.filter(F.split(F.lower(saddr), r"\s+"), lambda w: w != "")
    addr = (saddr != "") & (c("text_address") != "") & F.exists(
        words, lambda w: F.contains(F.lower("text_address"), w))
    phone = (digits(sphone) != "") & (digits(c("text_phone")) != "") & F.contains(digits(c("text_phone")), digits(sphone))
    return F.when(name, 33).otherwise(0) + F.when(addr, 33).otherwise(0) + F.when(phone, 34).otherwise(0)


def with_breakdown_flags(signals: DataFrame, lang: str = "en") -> DataFrame:
    staged = signals.select(
        "*",
        J.last_value("jsonld", "$.name").alias("f_sname"),
        J.last_value("jsonld", "$.address").alias("f_saddress"),
        J.last_value("jsonld", "$.telephone").alias("f_sphone"),
        F.size(section_pairs(c("markup"))).alias("f_faq"),
        F.size(F.filter("jsonld_types", lambda t: t == "FAQPage")).alias("f_faq_schemas"),
        F.size("jsonld_types").alias("f_schemas"),
        F.coalesce("meta_raw", F.lit("")).alias("f_meta"),
        snippet_score().alias("f_snippet"),
        F.size(question_headings_array(lang)).alias("f_question_headings"),
        F.size("hreflang").alias("f_hreflang"),
        F.exists("jsonld_types", lambda t: t.contains("LocalBusiness")).alias("f_local"),
        F.size(F.array_distinct(F.transform("geo_meta", lambda m: F.lower(m["name"])))).alias("f_geo_meta"),
        F.size("maps").alias("f_maps"),
    )
    return staged.withColumn("f_nap", nap_consistency_score())


def breakdown_checks() -> list[Check]:
    """Six answer signals and five geographic signals with partial points, over ``with_breakdown_flags``."""
    none = F.lit(None).cast("string")

    def row(pillar: str, name: str, points: Column, top: int, present: Column) -> Check:
        return Check("breakdown", pillar, name, points.cast("int"), top, present, none)

    faq, n_meta, snip = c("f_faq"), F.length("f_meta"), F.floor(c("f_snippet") / 10)
    nap = c("f_nap")
    nap_points = F.when(nap > 70, 25).otherwise(F.floor(nap / 4))
    return [
        row("AEO", "faq_content", F.when(faq > 0, 15 + F.least(F.lit(10), faq * 2)).otherwise(0), 25, faq > 0),
        row("AEO", "faq_schema", F.when(c("f_faq_schemas") > 0, 20).otherwise(0), 20, c("f_faq_schemas") > 0),
        row("AEO", "other_schemas", F.least(F.lit(15), c("f_schemas") * 3), 15, c("f_schemas") > 0),
        row("AEO", "meta_description", F.when(n_meta.between(150, 160), 20).when(n_meta > 0, 10).otherwise(0), 20,
            n_meta > 0),
        row("AEO", "snippet_suitability", F.least(F.lit(10), snip), 10, snip > 0),
        row("AEO", "question_headings", F.least(F.lit(10), c("f_question_headings") * 2), 10,
            c("f_question_headings") > 0),
        row("GEO", "hreflang_tags", F.least(F.lit(25), c("f_hreflang") * 5), 25, c("f_hreflang") > 0),
        row("GEO", "local_business_schema", F.when(c("f_local"), 25).otherwise(0), 25, c("f_local")),
        row("GEO", "nap_consistency", nap_points, 25, nap_points > 0),
        row("GEO", "geo_meta_tags", F.least(F.lit(15), c("f_geo_meta") * 5), 15, c("f_geo_meta") > 0),
        row("GEO", "map_embeds", F.when(c("f_maps") > 0, 10).otherwise(0), 10, c("f_maps") > 0),
    ]


SIGNAL_ORDER = [
    "faq_content", "faq_schema", "other_schemas", "meta_description", "snippet_suitability", "question_headings",
    "hreflang_tags", "local_business_schema", "nap_consistency", "geo_meta_tags", "map_embeds",
]

SCHEMES = {
    "pillars": (with_page_flags, pillar_checks),
    "answers": (with_answer_flags, answer_checks),
    "breakdown": (with_breakdown_flags, breakdown_checks),
}


# --- tables -------------------------------------------------------------------------------------------
def check_rows(signals: DataFrame, scheme: str) -> DataFrame:
    """Long table ``page_id, site, scheme, pillar, check, points, max_points, present, task``."""
    flags, checks = SCHEMES[scheme]
    flagged = flags(signals)
    rows = F.array(*[
        F.struct(F.lit(k.scheme).alias("scheme"), F.lit(k.pillar).alias("pillar"), F.lit(k.name).alias("check"),
                 k.points.cast("bigint").alias("points"), F.lit(k.max_points).cast("bigint").alias("max_points"),
                 k.present.alias("present"), k.task.alias("task"))
        for k in checks()
    ])
    return flagged.select("page_id", "site", F.explode(rows).alias("r")).select("page_id", "site", "r.*")


def page_points(signals: DataFrame, scheme: str) -> DataFrame:
    """Adds ``points_<pillar>`` columns: the sum of a page's points per pillar, without exploding the checks."""
    flags, checks = SCHEMES[scheme]
    flagged = flags(signals)
    sums: dict[str, Column] = {}
    for k in checks():
        sums[k.pillar] = k.points if k.pillar not in sums else sums[k.pillar] + k.points
    return flagged.select("*", *[v.cast("bigint").alias(f"points_{p}") for p, v in sums.items()])


def page_breakdown(signals: DataFrame, lang: str = "en") -> DataFrame:
    """Answer and geographic score of each page (capped at 100), signals present, and their mean."""
    flagged = with_breakdown_flags(signals, lang)
    by = {p: [k for k in breakdown_checks() if k.pillar == p] for p in ("AEO", "GEO")}

    def total(cols: list[Column]) -> Column:
        out = cols[0]
        for x in cols[1:]:
            out = out + x
        return out.cast("bigint")

    scored = flagged.select(
        "page_id", "site", "url",
        F.least(F.lit(100), total([k.points for k in by["AEO"]])).alias("aeo"),
        F.least(F.lit(100), total([k.points for k in by["GEO"]])).alias("geo"),
        total([k.present.cast("int") for k in by["AEO"]]).alias("aeo_present"),
        total([k.present.cast("int") for k in by["GEO"]]).alias("geo_present"),
    )
    return scored.withColumn("overall", (c("aeo") + c("geo")) / 2)


def nap_consistency(signals: DataFrame) -> DataFrame:
    return with_breakdown_flags(signals).select(
        "page_id", "site", c("f_nap").cast("bigint").alias("consistency"), (c("f_nap") > 70).alias("is_consistent"))


def site_health(probes: DataFrame) -> DataFrame:
    """Stored probe results → good things and issues, one row per message; issues have a priority."""
    def row(kind: str, name: str, message, cond: Column, priority: str | None = None) -> Column:
        text = message if isinstance(message, Column) else F.lit(message)
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), text.alias("message"), F.lit(priority).cast("string").alias("priority")))

    fast = (c("page_speed_ms") > 0) & (c("page_speed_ms") < 1000)
    speed = message(fv.TEXTS["page_loaded_in"], ms=c("page_speed_ms").cast("string"))
    rows = F.array_compact(F.array(
        row("good", fv.TEXTS["ai_instructions_file_2"], fv.TEXTS["llms_txt_file_found"], c("llms_txt")),
        row("issue", fv.TEXTS["ai_instructions_file_2"], fv.TEXTS["llms_txt_file_not_found"], ~c("llms_txt"), "high"),
        row("good", fv.TEXTS["ai_crawler_permissions_2"], fv.TEXTS["robots_txt_allows_ai"], c("robots_txt")),
        row("good", fv.TEXTS["security_certificate_2"], fv.TEXTS["ssl_certificate_active_2"], c("ssl")),
        row("good", fv.TEXTS["your_page_is_loading"], speed, fast),
        row("good", fv.TEXTS["mobile_optimization_2"], fv.TEXTS["site_appears_mobile_friendly"], c("mobile_friendly")),
        row("good", fv.TEXTS["structured_data"], fv.TEXTS["structured_data_found_2"], c("structured_data")),
    ))
    return probes.select("site", F.explode(rows).alias("r")).select("site", "r.*")
