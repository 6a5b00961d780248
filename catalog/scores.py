"""Check and score queries, site identity and roll-ups.  Site-level queries group by host."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.functions import fixed_values as fv
from pagelens.operators import checks as C
from pagelens.operators import page_rows as P
from pagelens.operators import recommend as R
from pagelens.operators import site as A
from pagelens.plans import jobs as JB

from . import sqlkit as K
from .inputs import signals, table
from .pages import ADDR, FAQ_SECTIONS, LAST, PRODUCTS, RECURSIVE, TOPICS, W, _phrases, _qh, _seg
from .registry import query

c = F.col


def host_signals(spark, d):
    return signals(spark, d).withColumn("site", c("host"))


def rows_sql(cte: str, checks: list[tuple]) -> str:
    """Long check rows: (pillar, check, points, max, present, task) per page of the flags CTE."""
    structs = ", ".join(
        f"{{'pillar': '{pl}', 'check': '{n}', 'points': CAST({pts} AS BIGINT), 'max_points': CAST({mx} AS BIGINT), "
        f"'present': {pres}, 'task': CAST({task} AS VARCHAR)}}" for pl, n, pts, mx, pres, task in checks)
    return f"rows0 AS (SELECT page_id, host, site, word_count, unnest([{structs}]) AS r FROM {cte})"


def passed(pillar, name, cond, pts, task, raw=False):
    task = task if raw else K.q(task)
    return (pillar, name, f"CASE WHEN {cond} THEN {pts} ELSE 0 END", pts, f"({cond})",
            f"CASE WHEN NOT ({cond}) THEN {task} END")


# --- pillar checks ----------------------------------------------------------------------------------
COUNTRY = "CASE lower(string_split(host, '.')[-1]) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in fv.EU_TLD_COUNTRY.items()) + " ELSE '' END"
PF = f"""pf0 AS (SELECT *, lower(array_to_string({K.WARNINGS}, ' | ')) AS warn, lower(concat_ws(' ', title, coalesce(meta, ''), '')) AS place,
    coalesce(list_filter(h1, lambda x: x <> '')[1], '') AS f_h1, coalesce(meta, '') AS f_meta, array_to_string(jsonld, ' ') AS f_schema FROM sig),
  pl AS (SELECT pf0.*, (SELECT count(*) FILTER (internal) FROM edges WHERE edges.page_id = pf0.page_id) AS n_internal,
    starts_with(lower(url), 'https://') AS https, coalesce(list_filter({K.lits(sorted(fv.EU_CITIES))}, lambda x: contains(place, x))[1], '') AS city,
    {COUNTRY} AS country, contains(warn, 'missing og:title') AS ogt, contains(warn, 'missing og:description') AS ogd, contains(warn, 'missing og:image') AS ogi,
    contains(warn, 'map') AS mapw FROM pf0)"""
GEO = "(city <> '' OR country <> '')"
OGM = "array_to_string(list_filter([CASE WHEN ogt THEN 'og:title' END, CASE WHEN ogd THEN 'og:description' END, CASE WHEN ogi THEN 'og:image' END], lambda x: x IS NOT NULL), ', ')"
PILLARS = [
    passed("SEO", "title", "length(title) BETWEEN 1 AND 60", 5, "Fix title: include main keyword, keep <=60 chars."),
    passed("SEO", "h1", "length(f_h1) BETWEEN 1 AND 70", 5, "Add/shorten H1 and include main keyword."),
    passed("SEO", "meta", "length(f_meta) BETWEEN 50 AND 160", 5, "Fix meta description: 50-160 chars, include keyword + city."),
    passed("SEO", "words", "word_count >= 500", 5, "concat('Add more copy (>=500 words). Current: ~', word_count, ' words.')", True),
    passed("SEO", "links", "n_internal >= 3", 5, "Add >=3 internal links to relevant pages."),
    passed("SEO", "https", "https", 5, "Enable HTTPS (redirect http -> https)."),
    passed("SEO", "viewport", "NOT (contains(warn, 'missing viewport') OR contains(warn, 'no viewport'))", 5, "Make page mobile-friendly (viewport, responsive css)."),
    passed("SEO", "alt", "NOT contains(warn, 'missing alt')", 5, "Add descriptive ALT text to images."),
    passed("SEO", "open_graph", "NOT (ogt OR ogd OR ogi)", 5, f"concat('Add Open Graph meta tags (', {OGM}, ').')", True),
    passed("AEO", "answers", "word_count >= 600 AND f_h1 <> ''", 5, "Add clear Q&A/FAQ or summary answers near the top."),
    passed("AEO", "jsonld", "contains(f_schema, '\"@context\"') AND contains(f_schema, '\"@type\"')", 5, "Add JSON-LD with @context and @type."),
    passed("AEO", "schema_type", K.has("f_schema", r'"@type"\s*:\s*"(?:FAQPage|HowTo|Article|Service|Product)"'), 5, "Add relevant schema (FAQPage/HowTo/Service/Product/Article)."),
    passed("AEO", "place", GEO, 5, "Mention your city/region in Title, H1, and copy."),
    passed("AEO", "map", f"NOT mapw AND NOT ogi AND {GEO}", 5, "CASE WHEN mapw THEN 'Embed Google Maps pin on contact/hero area.' ELSE 'Embed Google Maps pin and ensure NAP (name, address, phone) is visible.' END", True),
    passed("AEO", "reviews", K.any_of("warn", fv.REVIEW_WORDS), 5, "Show 2-3 short customer reviews/testimonials with stars."),
    passed("AEO", "previews", "NOT (ogt OR ogd)", 5, "Add OG title/description for better previews/snippets."),
    passed("GEO", "place", GEO, 10, "Mention city/region in Title, H1, and copy."),
    passed("GEO", "hreflang", "len(hreflang) > 0", 5, "Add hreflang alternates for language/region variants."),
    passed("GEO", "country", "country <> ''", 5, "Use country TLD or clarify location signals."),
    passed("A11Y", "alt", "len(list_filter(images, lambda i: i.alt = '')) = 0", 10, "Add descriptive ALT text to all images."),
    passed("A11Y", "dimensions", "len(list_filter(images, lambda i: coalesce(i.width, '') = '' OR coalesce(i.height, '') = '')) = 0", 5, "Set width/height for images to reduce layout shift."),
    passed("A11Y", "lazy", "len(list_filter(images, lambda i: i.loading = 'lazy')) >= 1", 5, "Use loading=lazy for below-the-fold images."),
    passed("TECH", "https", "https", 5, "Serve over HTTPS and redirect http -> https."),
    passed("TECH", "canonical", "coalesce(canonical, '') <> ''", 5, "Add canonical link to consolidate duplicates."),
    passed("TECH", "broken", "true", 5, "Fix broken internal links."),
    passed("TECH", "indexable", "NOT contains(lower(coalesce(meta_robots, '')), 'noindex')", 5, "Ensure important pages are not blocked or noindex."),
]
PROWS = f"{W}, {K.LINKS}, {PF}, {rows_sql('pl', PILLARS)}, ck AS (SELECT page_id, host AS site, word_count, r.* FROM rows0)"


@query("checks_pillars", f"{PROWS} SELECT page_id, site, 'pillars' AS scheme, pillar, \"check\", points, max_points, present, task FROM ck")
def checks_pillars(spark, d):
    return C.check_rows(host_signals(spark, d), "pillars")


SCORES = f"""pts AS (SELECT site, pillar, page_id, greatest(any_value(word_count), 1) AS w, sum(points) AS p FROM ck GROUP BY ALL),
  mx AS (SELECT * FROM (VALUES ('SEO', 40), ('AEO', 35), ('GEO', 20), ('A11Y', 20), ('TECH', 20)) v(pillar, m)),
  pc AS (SELECT site, pillar, count(*) AS pages, greatest(0, least(100, round_even(CAST(sum(p * w) AS DOUBLE) * 100.0 / (CAST(sum(w) AS DOUBLE) * CAST(any_value(m) AS DOUBLE)), 0))) AS pct FROM pts JOIN mx USING (pillar) GROUP BY site, pillar),
  wide AS (SELECT site, max(pages) AS pages, {", ".join(f"CAST(max(pct) FILTER (pillar = '{p}') AS BIGINT) AS {n}" for p, n in
    [("SEO", "seo"), ("AEO", "aeo"), ("GEO", "geo"), ("A11Y", "a11y"), ("TECH", "technical")])} FROM pc GROUP BY site),
  sc AS (SELECT *, CAST(round_even((seo + aeo + geo + a11y + technical) / 5.0, 0) AS BIGINT) AS overall, CAST(round_even((seo + aeo) / 2.0, 0) AS BIGINT) AS combined FROM wide)"""


@query("pillar_scores", f"{PROWS}, {SCORES} SELECT * FROM sc")
def pillar_scores(spark, d):
    return A.pillar_scores(host_signals(spark, d))


@query("score_requested", f"{PROWS}, {SCORES}, want AS (SELECT site FROM sc UNION SELECT concat('missing.', site) FROM sc) "
       "SELECT want.site AS site, pages, seo, aeo, geo, a11y, technical, overall, combined, CASE WHEN pages IS NULL THEN 'Audit has no pages' END AS error FROM want LEFT JOIN sc ON want.site = sc.site")
def score_requested(spark, d):
    s = host_signals(spark, d)
    want = s.select("site").distinct()
    return A.score_requested(want.union(want.select(F.concat(F.lit("missing."), c("site")))), s)


@query("task_top", f"{PROWS}, n AS (SELECT site, pillar, task, count(*) AS pages FROM ck WHERE task IS NOT NULL GROUP BY ALL), "
       f"r AS (SELECT *, row_number() OVER (PARTITION BY site, pillar ORDER BY pages DESC, task) AS rank FROM n QUALIFY rank <= {fv.MAX_SITE_TASKS}) "
       "SELECT site, pillar, task, pages, rank, concat(task, ' (x', pages, ')') AS label FROM r")
def task_top(spark, d):
    return A.task_counts(C.check_rows(host_signals(spark, d), "pillars"))


@query("pages_detail", f"""{PROWS}, tl AS (SELECT page_id, list_filter([{", ".join(x[5] for x in PILLARS if x[0] == "SEO")}], lambda x: x IS NOT NULL)[1:3] AS seo_list,
    list_filter([{", ".join(x[5] for x in PILLARS if x[0] == "AEO")}], lambda x: x IS NOT NULL)[1:3] AS aeo_list FROM pl)
  SELECT pl.page_id AS page_id, pl.host AS site, pl.url AS url, pl.title AS title, pl.word_count AS word_count,
    (SELECT CAST(sum(points) AS BIGINT) FROM ck WHERE ck.page_id = pl.page_id AND pillar = 'SEO') AS seo_points,
    (SELECT CAST(sum(points) AS BIGINT) FROM ck WHERE ck.page_id = pl.page_id AND pillar = 'AEO') AS aeo_points,
    {K.in_languages(K.tokens("concat_ws(' ', pl.title, pl.f_meta, '')"))} AS language, city, country,
    array_to_string(tl.seo_list, ' | ') AS top_seo_tasks, array_to_string(tl.aeo_list, ' | ') AS top_aeo_tasks FROM pl JOIN tl ON tl.page_id = pl.page_id""")
def pages_detail(spark, d):
    return A.pages_detail(host_signals(spark, d))


@query("detected_counts", f"""{W}, {K.LINKS}, {PF}, v AS (SELECT host AS site, 'language' AS kind, {K.in_languages(K.tokens("concat_ws(' ', title, f_meta, '')"))} AS value FROM pl
  UNION ALL SELECT host, 'city', city FROM pl UNION ALL SELECT host, 'country', country FROM pl) SELECT site, kind, value, count(*) AS pages FROM v WHERE value <> '' GROUP BY ALL""")
def detected_counts(spark, d):
    return A.detected_counts(host_signals(spark, d))


# --- answer checks ----------------------------------------------------------------------------------
AF = f"""al AS (SELECT *, lower(text) AS lt, lower(title) AS ltt, coalesce(meta, '') AS f_meta, array_to_string(jsonld, ' ') AS f_schema,
    array_to_string(jsonld_types, ' ') AS f_types, len(images) AS n_img, len(list_filter(images, lambda i: i.alt = '')) AS n_alt,
    CASE WHEN len(images) = 0 THEN 100.0 ELSE CAST(len(list_filter(images, lambda i: i.alt <> '')) AS DOUBLE) / len(images) * 100 END AS share FROM sig)"""


def gated(pillar, name, cond, pts, task, gate):
    return (pillar, name, f"CASE WHEN ({gate}) AND ({cond}) THEN {pts} ELSE 0 END", pts, f"({cond})",
            f"CASE WHEN ({gate}) AND NOT ({cond}) THEN {K.q(task)} END")


HM, HS = "f_meta <> ''", "len(jsonld) > 0"
ANSWERS = [
    passed("AEO", "faq_content", K.any_of("lt", fv.FAQ_WORDS), 15, "Add FAQ section with common questions and answers"),
    passed("AEO", "faq_schema", "contains(f_schema, 'FAQPage') OR contains(f_schema, 'Question')", 10, "Add FAQ schema markup (JSON-LD) for better AI understanding"),
    passed("AEO", "meta_length", "length(f_meta) BETWEEN 150 AND 160", 10, f"CASE WHEN {HM} THEN 'Optimize meta description length (150-160 characters) for featured snippets' ELSE 'Add meta description optimized for featured snippets' END", True),
    gated("AEO", "meta_question", "ends_with(trim(f_meta), '?')", 5, "Consider question format in meta descriptions for better featured snippet chances", HM),
    gated("AEO", "meta_words", K.any_of("lower(f_meta)", fv.META_QUESTION_WORDS), 5, "Include question words (how, what, why) in meta descriptions", HM),
    ("AEO", "alt_text", "CASE WHEN share >= 90 THEN 15 WHEN share >= 70 THEN 10 ELSE 5 END", 15, "share >= 90",
     "CASE WHEN share >= 90 THEN NULL WHEN share >= 70 THEN concat('Add alt text to ', n_alt, ' images') ELSE concat('Add descriptive alt text to ', n_alt, ' images for better AI understanding') END"),
    passed("AEO", "schema_organization", "contains(f_types, 'Organization') OR contains(f_types, 'WebSite')", 10, f"CASE WHEN {HS} THEN 'Add Organization or WebSite schema markup' ELSE 'Add JSON-LD structured data for better AI understanding' END", True),
    gated("AEO", "schema_article", "contains(f_types, 'Article') OR contains(f_types, 'BlogPosting')", 5, "Consider adding Article or BlogPosting schema for content pages", HS),
    gated("AEO", "schema_faq", "contains(f_types, 'FAQPage') OR contains(f_types, 'Question')", 5, "Add FAQ schema markup for question-answer content", HS),
    passed("AEO", "structure_h1", "len(h1) > 0", 5, "Add clear H1 heading for better content structure"),
    passed("AEO", "structure_h2", "len(h2) >= 2", 5, "Add more H2 headings to structure content for AI consumption"),
    passed("AEO", "structure_lists", K.any_of("text", fv.LIST_MARKERS), 5, "Use bullet points or numbered lists for better AI content parsing"),
    passed("AEO", "structure_questions", K.any_of("lt", fv.CONTENT_QUESTION_PHRASES), 5, "Include question-answer format in content for better AI understanding"),
    ("GEO", "hreflang", "CASE WHEN len(hreflang) >= 2 THEN 25 WHEN len(hreflang) = 1 THEN 15 ELSE 0 END", 25, "len(hreflang) > 0",
     "CASE WHEN len(hreflang) = 0 THEN 'Implement hreflang tags for multilingual targeting' WHEN len(hreflang) = 1 THEN 'Add more hreflang tags for complete multilingual coverage' END"),
    passed("GEO", "local_schema", "contains(f_types, 'LocalBusiness') OR contains(f_types, 'Organization')", 20, "Add LocalBusiness or Organization schema markup"),
    ("GEO", "nap", "CASE WHEN phone <> '' AND address <> '' THEN 20 WHEN phone <> '' OR address <> '' THEN 10 ELSE 0 END", 20, "phone <> '' OR address <> ''",
     "CASE WHEN phone <> '' AND address <> '' THEN NULL WHEN phone <> '' OR address <> '' THEN 'Complete NAP information - add missing phone or address' ELSE 'Add NAP (Name, Address, Phone) information for local SEO' END"),
    passed("GEO", "geo_words", f"{K.any_of('lt', fv.GEO_WORDS)} OR {K.any_of('ltt', fv.GEO_WORDS)}", 20, "Add geographic targeting signals in content and titles"),
    passed("GEO", "local_words", f"{K.any_of('lt', fv.LOCAL_WORDS)} OR {K.any_of('ltt', fv.LOCAL_WORDS)}", 15, "Include local business keywords in content and titles"),
]
AROWS = f"{W}, {AF}, {rows_sql('al', ANSWERS)}, ck AS (SELECT page_id, host AS site, word_count, r.* FROM rows0)"


@query("checks_answers", f"{AROWS} SELECT page_id, site, 'answers' AS scheme, pillar, \"check\", points, max_points, present, task FROM ck")
def checks_answers(spark, d):
    return C.check_rows(host_signals(spark, d), "answers")


AGS = f"""{AROWS}, s AS (SELECT site, count(DISTINCT page_id) AS pages, CAST(floor(sum(points) FILTER (pillar = 'AEO') / sum(max_points) FILTER (pillar = 'AEO') * 100) AS BIGINT) AS aeo,
  CAST(floor(sum(points) FILTER (pillar = 'GEO') / sum(max_points) FILTER (pillar = 'GEO') * 100) AS BIGINT) AS geo FROM ck GROUP BY site)
  SELECT *, aeo * CAST(0.6 AS DOUBLE) + geo * CAST(0.4 AS DOUBLE) AS overall FROM s"""


@query("aeo_geo_scores", AGS)
def aeo_geo_scores(spark, d):
    return A.answer_scores(host_signals(spark, d))


@query("site_tasks", f"{AROWS} SELECT DISTINCT site, pillar, task FROM ck WHERE task IS NOT NULL")
def site_tasks(spark, d):
    return A.site_tasks(C.check_rows(host_signals(spark, d), "answers"))


# --- breakdown --------------------------------------------------------------------------------------
DIG = lambda s: K.sub(s, "[^0-9]")
BF = f"""{FAQ_SECTIONS}, nf AS (SELECT page_id, count(*) AS n FROM faqsec GROUP BY ALL),
  b0 AS (SELECT sig.*, coalesce(nf.n, 0) AS faq, {LAST.format(e="json_extract_string(x, '$.name')")} AS sname, {LAST.format(e=ADDR)} AS saddr,
    {LAST.format(e="json_extract_string(x, '$.telephone')")} AS sphone, coalesce(meta_raw, '') AS mr,
    len(list_filter(jsonld_types, lambda x: x = 'FAQPage')) AS nfaqs, len(jsonld_types) AS nsch, least(100, n_lists * 10 + n_tables * 15 + n_short_p * 2) AS snip,
    len({_qh('en')}) AS nq, len(hreflang) AS nh, len(list_filter(jsonld_types, lambda x: contains(x, 'LocalBusiness'))) > 0 AS loc,
    len(list_distinct(list_transform(geo_meta, lambda m: lower(m.name)))) AS ngm,
    len(list_filter(frame_srcs, lambda x: contains(x, 'google.com/maps') OR contains(x, 'maps.google.com'))) + len(list_filter(frame_srcs, lambda x: contains(x, 'openstreetmap.org'))) AS nmap
    FROM sig LEFT JOIN nf USING (page_id)),
  bl AS (SELECT *, (CASE WHEN sname <> '' AND title <> '' AND contains(lower(title), lower(sname)) THEN 33 ELSE 0 END)
    + (CASE WHEN saddr <> '' AND text_address <> '' AND len(list_filter(string_split_regex(lower(saddr), '\\s+'), lambda w: w <> '' AND contains(lower(text_address), w))) > 0 THEN 33 ELSE 0 END)
    + (CASE WHEN {DIG('sphone')} <> '' AND {DIG('text_phone')} <> '' AND contains({DIG('text_phone')}, {DIG('sphone')}) THEN 34 ELSE 0 END) AS nap FROM b0)"""
NAPP = "(CASE WHEN nap > 70 THEN 25 ELSE nap // 4 END)"
BREAK = [
    ("AEO", "faq_content", "CASE WHEN faq > 0 THEN 15 + least(10, faq * 2) ELSE 0 END", 25, "faq > 0", "NULL"),
    ("AEO", "faq_schema", "CASE WHEN nfaqs > 0 THEN 20 ELSE 0 END", 20, "nfaqs > 0", "NULL"),
    ("AEO", "other_schemas", "least(15, nsch * 3)", 15, "nsch > 0", "NULL"),
    ("AEO", "meta_description", "CASE WHEN length(mr) BETWEEN 150 AND 160 THEN 20 WHEN length(mr) > 0 THEN 10 ELSE 0 END", 20, "length(mr) > 0", "NULL"),
    ("AEO", "snippet_suitability", "least(10, snip // 10)", 10, "snip // 10 > 0", "NULL"),
    ("AEO", "question_headings", "least(10, nq * 2)", 10, "nq > 0", "NULL"),
    ("GEO", "hreflang_tags", "least(25, nh * 5)", 25, "nh > 0", "NULL"),
    ("GEO", "local_business_schema", "CASE WHEN loc THEN 25 ELSE 0 END", 25, "loc", "NULL"),
    ("GEO", "nap_consistency", NAPP, 25, f"{NAPP} > 0", "NULL"),
    ("GEO", "geo_meta_tags", "least(15, ngm * 5)", 15, "ngm > 0", "NULL"),
    ("GEO", "map_embeds", "CASE WHEN nmap > 0 THEN 10 ELSE 0 END", 10, "nmap > 0", "NULL"),
]
BROWS = f"{RECURSIVE}, {BF}, {rows_sql('bl', BREAK)}, ck AS (SELECT page_id, host AS site, word_count, r.* FROM rows0)"
PAGEB = """pb AS (SELECT page_id, site, least(100, sum(points) FILTER (pillar = 'AEO')) AS aeo, least(100, sum(points) FILTER (pillar = 'GEO')) AS geo,
  count(*) FILTER (pillar = 'AEO' AND present) AS aeo_present, count(*) FILTER (pillar = 'GEO' AND present) AS geo_present FROM ck GROUP BY ALL)"""
COVER = """cv0 AS (SELECT site, pillar, "check", count(*) AS total_pages, count(*) FILTER (present) AS pages_with_signal, CAST(sum(points) AS BIGINT) AS total_score, any_value(max_points) AS max_points FROM ck GROUP BY ALL),
  cv1 AS (SELECT *, CAST(floor(pages_with_signal / total_pages * 100) AS BIGINT) AS coverage, CAST(floor(total_score / total_pages) AS BIGINT) AS average FROM cv0),
  cover AS (SELECT *, CASE WHEN coverage >= 80 THEN 'strong' WHEN coverage >= 50 THEN 'moderate' ELSE 'weak' END AS strength FROM cv1)"""
MEANS = """mean0 AS (SELECT site, count(*) AS pages, CAST(floor(sum(aeo) / count(*)) AS BIGINT) AS aeo, CAST(floor(sum(geo) / count(*)) AS BIGINT) AS geo FROM pb GROUP BY site),
  means AS (SELECT *, CAST(floor((aeo + geo) / 2) AS BIGINT) AS overall FROM mean0)"""


@query("checks_breakdown", f"{BROWS} SELECT page_id, site, 'breakdown' AS scheme, pillar, \"check\", points, max_points, present, task FROM ck")
def checks_breakdown(spark, d):
    return C.check_rows(host_signals(spark, d), "breakdown")


@query("page_breakdown", f"{BROWS}, {PAGEB} SELECT page_id, site, (SELECT url FROM pages p WHERE p.page_id = pb.page_id) AS url, CAST(aeo AS BIGINT) AS aeo, CAST(geo AS BIGINT) AS geo, aeo_present, geo_present, CAST((aeo + geo) / 2 AS DOUBLE) AS overall FROM pb")
def page_breakdown(spark, d):
    return C.page_breakdown(host_signals(spark, d))


@query("nap_consistency", f"{RECURSIVE}, {BF} SELECT page_id, host AS site, CAST(nap AS BIGINT) AS consistency, nap > 70 AS is_consistent FROM bl")
def nap_consistency(spark, d):
    return C.nap_consistency(host_signals(spark, d))


@query("site_mean_scores", f"{BROWS}, {PAGEB}, {MEANS} SELECT * FROM means")
def site_mean_scores(spark, d):
    return A.site_mean_scores(C.page_breakdown(host_signals(spark, d)))


@query("signal_coverage", f"{BROWS}, {COVER} SELECT * FROM cover")
def signal_coverage(spark, d):
    return A.signal_coverage(host_signals(spark, d))


ADV = "CASE \"check\" " + " ".join(f"WHEN '{k}' THEN {K.q(v)}" for k, v in fv.SITE_ADVICE.items()) + " END"
ORD = "CASE \"check\" " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(C.SIGNAL_ORDER)) + " END"


@query("site_recommendations", f"""{BROWS}, {PAGEB}, {MEANS}, {COVER},
  low AS (SELECT *, row_number() OVER (PARTITION BY site, pillar ORDER BY coverage, {ORD}) AS rn FROM cover)
  SELECT site, lower(pillar) AS kind, {ADV} AS advice FROM cover WHERE coverage < 50
  UNION ALL SELECT site, 'priority', concat('Priority: Improve ', replace("check", '_', ' '), ' (only ', coverage, '% coverage)') FROM low WHERE rn = 1 AND coverage < 30
  UNION ALL SELECT site, 'quick_win', unnest({K.lits(fv.QUICK_WINS['aeo'])}) FROM means WHERE aeo < 70
  UNION ALL SELECT site, 'quick_win', unnest({K.lits(fv.QUICK_WINS['geo'])}) FROM means WHERE geo < 70""")
def site_recommendations(spark, d):
    s = host_signals(spark, d)
    return R.site_recommendations(A.signal_coverage(s), A.site_mean_scores(C.page_breakdown(s)))


@query("page_recommendations", f"""{BROWS}, pa AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join(K.q(x) for x in row) + ")" for row in fv.PAGE_ADVICE)}) v(sig_name, category, priority, title, description, action))
  SELECT page_id, site, category, priority, title, description, action FROM ck JOIN pa ON ck."check" = pa.sig_name WHERE points * 2 < max_points""")
def page_recommendations(spark, d):
    return R.page_recommendations(C.check_rows(host_signals(spark, d), "breakdown"))


@query("site_health", f"""{W}, pr AS (SELECT host AS site, min(page_id) % 2 = 0 AS llms, min(page_id) % 3 = 0 AS robots, bool_and(starts_with(url, 'https://')) AS ssl, min(page_id) * 37 % 2000 AS ms, bool_or(viewport IS NOT NULL) AS mob, bool_or(len(jsonld) > 0) AS sd FROM sig GROUP BY host)
  SELECT site, 'good' AS kind, 'AI Instructions File' AS name, 'llms.txt file found' AS message, CAST(NULL AS VARCHAR) AS priority FROM pr WHERE llms
  UNION ALL SELECT site, 'issue', 'AI Instructions File', 'llms.txt file not found', 'high' FROM pr WHERE NOT llms
  UNION ALL SELECT site, 'good', 'AI Crawler Permissions', 'Robots.txt allows AI crawlers', NULL FROM pr WHERE robots
  UNION ALL SELECT site, 'good', 'Security Certificate', 'SSL certificate active', NULL FROM pr WHERE ssl
  UNION ALL SELECT site, 'good', 'Your page is loading fast', concat('Page loaded in ', ms, 'ms'), NULL FROM pr WHERE ms > 0 AND ms < 1000
  UNION ALL SELECT site, 'good', 'Mobile Optimization', 'Site appears mobile-friendly', NULL FROM pr WHERE mob
  UNION ALL SELECT site, 'good', 'Structured Data', 'Structured data found', NULL FROM pr WHERE sd""")
def site_health(spark, d):
    s = host_signals(spark, d)
    k = F.min("page_id")
    probes = s.groupBy("site").agg(
        (k % 2 == 0).alias("llms_txt"), (k % 3 == 0).alias("robots_txt"), F.min(F.startswith("url", F.lit("https://"))).alias("ssl"),
        (k * 37 % 2000).alias("page_speed_ms"), F.max(c("viewport").isNotNull()).alias("mobile_friendly"),
        F.max(F.size("jsonld") > 0).alias("structured_data"))
    return C.site_health(probes)


# --- site roll-ups ----------------------------------------------------------------------------------
@query("site_rollup", f"""{W} SELECT host AS site, count(*) AS pages, count(DISTINCT lang) AS n_languages, count(*) FILTER (coalesce(canonical, '') <> '') AS pages_with_canonical,
  count(*) FILTER (contains(lower(coalesce(meta_robots, '')), 'index')) AS index_pages, count(*) FILTER (contains(lower(coalesce(meta_robots, '')), 'noindex')) AS noindex_pages,
  count(*) FILTER (contains(lower(coalesce(meta_robots, '')), 'index') AND NOT contains(lower(coalesce(meta_robots, '')), 'noindex')) AS index_only_pages,
  CAST(0 AS BIGINT) AS pages_blocked_by_robots, CAST(sum(len(list_filter(images, lambda i: i.alt = ''))) AS BIGINT) AS images_missing_alt FROM sig GROUP BY host""")
def site_rollup(spark, d):
    return A.site_rollup(host_signals(spark, d))


@query("site_languages", f"{W} SELECT host AS site, lang, count(*) AS pages FROM sig WHERE lang IS NOT NULL GROUP BY ALL")
def site_languages(spark, d):
    return A.site_languages(host_signals(spark, d))


@query("site_language_mix", f"{W}, l AS (SELECT host AS site, {K.in_languages(K.tokens("concat_ws(' ', title, coalesce(meta, ''), '')"))} AS language FROM sig) SELECT site, language, count(*) AS pages FROM l WHERE language <> '' GROUP BY ALL")
def site_language_mix(spark, d):
    return A.site_language_mix(host_signals(spark, d))


PN = list(fv.PLATFORM_MARKERS)


@query("platform_site", f"""{W}, pfs AS (SELECT host AS site, {", ".join(f"CAST(sum(pf_{n}) AS BIGINT) AS {n}" for n in PN)} FROM sig GROUP BY host)
  SELECT site, CASE WHEN greatest({", ".join(PN)}) = 0 THEN 'custom' {" ".join(f"WHEN {n} = greatest({', '.join(PN)}) THEN '{n}'" for n in PN)} END AS platform, greatest({", ".join(PN)}) AS hits FROM pfs""")
def platform_site(spark, d):
    return A.platform(host_signals(spark, d))


@query("issue_counts", f"""{W} SELECT host AS site, count(*) AS pages, count(*) FILTER (title = '') AS missing_titles, count(*) FILTER (coalesce(meta, '') = '') AS missing_meta,
  count(*) FILTER (len(h1) = 0) AS missing_h1, CAST(sum(len(images)) AS BIGINT) AS total_images, bool_or(contains(lower(url), 'contact')) AS has_contact_info, bool_or(contains(lower(url), 'product')) AS has_products FROM sig GROUP BY host""")
def issue_counts(spark, d):
    return A.issue_counts(host_signals(spark, d))


@query("optimize_candidates", f"{W} SELECT host AS site, page_id, word_count, row_number() OVER (PARTITION BY host ORDER BY word_count DESC, page_id) AS rank FROM sig QUALIFY rank <= 10")
def optimize_candidates(spark, d):
    return A.optimize_candidates(host_signals(spark, d)).select("site", "page_id", "word_count", "rank")


@query("fetch_stats", """WITH f AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS site, CASE page_id % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'browser' ELSE 'unknown' END AS fetch_method,
    CASE WHEN page_id % 11 = 0 THEN 'blocked_by_protection' ELSE 'success' END AS st FROM pages),
  g AS (SELECT site, fetch_method, count(*) AS pages, count(*) FILTER (st = 'blocked_by_protection') AS blocked FROM f GROUP BY ALL)
  SELECT site, fetch_method, pages, blocked, CAST(sum(blocked) OVER (PARTITION BY site) AS BIGINT) AS site_blocked, CASE WHEN sum(blocked) OVER (PARTITION BY site) > 0 THEN 'blocked' ELSE 'accessible' END AS protection_status FROM g""")
def fetch_stats(spark, d):
    p = table(spark, d, "pages").select(
        F.regexp_extract("url", "://([^/]+)", 1).alias("site"), F.expr("CASE page_id % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'browser' END").alias("fetch_method"),
        F.expr("CASE WHEN page_id % 11 = 0 THEN 'blocked_by_protection' ELSE 'success' END").alias("fetch_status"))
    return A.fetch_stats(p)


# --- identity ---------------------------------------------------------------------------------------
OGSITE = "nullif(trim(list_filter(og, lambda o: lower(o.name) = 'og:site_name')[1].content), '')"
ORG = f"CASE WHEN {K.jtype('jsonld[1]')} = 'Organization' THEN nullif(json_extract_string(jsonld[1], '$.name'), '') END"
CLEAN = K.sub("title", r"\s*[-|]\s*(?:Home|Welcome|Official)[^\n]*$")
LABEL = f"string_split({K.sub('netloc', 'www[.]')}, '.')[1]"
TITLED = f"array_to_string(list_transform(string_split({LABEL}, '-'), lambda x: concat(upper(x[1:1]), x[2:])), '-')"
BRAND = f"coalesce({OGSITE}, {ORG}, CASE WHEN length({CLEAN}) > 3 THEN {CLEAN} END, {TITLED})"
BRANDS = f"brands AS (SELECT host AS site, arg_min({BRAND}, page_id) AS brand FROM sig WHERE coalesce({BRAND}, '') <> '' GROUP BY host)"


@query("brand_name", f"{W}, {BRANDS} SELECT * FROM brands")
def brand_name(spark, d):
    return A.brand_name(host_signals(spark, d))


HEAD = "trim(string_split(string_split(title, ' - ')[1], ' | ')[1])"


@query("brand_name_last", f"{W}, b2 AS (SELECT host AS site, page_id, coalesce({OGSITE}, {ORG}, {HEAD}) AS brand FROM sig) SELECT site, arg_max(brand, page_id) AS brand FROM b2 WHERE coalesce(brand, '') <> '' GROUP BY site")
def brand_name_last(spark, d):
    return A.brand_name(host_signals(spark, d), "last")


@query("brand_name_context", f"""{W}, b2 AS (SELECT host AS site, page_id, coalesce({OGSITE}, CASE WHEN has_title_tag THEN {K.sub('title', r'(?: - | \| )(?:Home|Official)$')} END, {ORG}, 'Unknown Brand') AS brand FROM sig)
  SELECT site, arg_min(brand, page_id) AS brand FROM b2 WHERE brand <> '' GROUP BY site""")
def brand_name_context(spark, d):
    return A.brand_name(host_signals(spark, d), "context")


GUESS = r"""guess AS (SELECT host AS site, arg_min(title, page_id) AS t FROM sig WHERE title <> '' GROUP BY host),
  guessed AS (SELECT site, CASE WHEN len(string_split_regex(t, '\s*[|\-–]\s*')) > 1 THEN trim(string_split_regex(t, '\s*[|\-–]\s*')[-1]) ELSE '' END AS brand FROM guess)"""


@query("brand_guess", f"{W}, {GUESS} SELECT * FROM guessed")
def brand_guess(spark, d):
    return A.brand_guess(host_signals(spark, d))


@query("site_description", f"{W} SELECT host AS site, arg_min(meta, page_id) AS description FROM sig WHERE coalesce(meta, '') <> '' GROUP BY host")
def site_description(spark, d):
    return A.description(host_signals(spark, d))


FIRSTP = f"substr({K.strip(K.ext(f'string_split_regex(mk, {K.rq(K.H.PARAGRAPH_START)})[2]', K.PARAGRAPH_REST))}, 1, 200)"


@query("site_description_context", f"""{W}, x AS (SELECT host AS site, page_id, coalesce(meta, nullif(trim(list_filter(og, lambda o: lower(o.name) = 'og:description')[1].content), ''), {FIRSTP}, '') AS description FROM sig)
  SELECT site, arg_min(description, page_id) AS description FROM x WHERE description <> '' GROUP BY site""")
def site_description_context(spark, d):
    return A.description(host_signals(spark, d), "context")


LOCAL = K.blocks("jsonld", "LocalBusiness")
LOCALITY = f"nullif(list_filter(list_transform({LOCAL}, lambda x: json_extract_string(x, '$.address.addressLocality')), lambda v: v IS NOT NULL)[1], '')"
INWORDS = f"nullif({K.ext('text', r'\sin\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)')}, '')"
LOCATIONS = f"locs AS (SELECT host AS site, coalesce(arg_min({LOCALITY}, page_id) FILTER ({LOCALITY} IS NOT NULL), arg_min({INWORDS}, page_id) FILTER ({INWORDS} IS NOT NULL), '') AS location FROM sig GROUP BY host)"


@query("site_location", f"{W}, {LOCATIONS} SELECT * FROM locs")
def site_location(spark, d):
    return A.location(host_signals(spark, d))


@query("site_location_text", f"""{W}, x AS (SELECT host AS site, page_id, coalesce({LOCALITY}, (list_filter({K.lits(fv.TEXT_COUNTRIES)}, lambda z: contains(lower(text), z)))[1], '') AS l FROM sig),
  y AS (SELECT site, page_id, concat(upper(l[1:1]), l[2:]) AS location FROM x) SELECT site, arg_min(location, page_id) AS location FROM y WHERE location <> '' GROUP BY site""")
def site_location_text(spark, d):
    return A.location(host_signals(spark, d), "text")


INDUSTRY = "(CASE " + " ".join(f"WHEN {K.any_of('lower(text)', ws)} THEN '{n}'" for n, ws in fv.INDUSTRY_FIRST_KEYWORDS.items()) + " ELSE 'General' END)"


@query("industry_first", f"{W} SELECT page_id, {INDUSTRY} AS industry FROM sig")
def industry_first(spark, d):
    return signals(spark, d).select("page_id", A.industry_first(c("text")).alias("industry"))


COUNTRYNAME = f"(list_filter({K.lits(fv.CONTEXT_COUNTRIES)}, lambda z: contains(lower(text), lower(z))))[1]"
LOCCOUNTRY = f"nullif(list_filter(list_transform({LOCAL}, lambda x: json_extract_string(x, '$.address.addressCountry')), lambda v: v IS NOT NULL)[1], '')"


@query("site_location_context", f"""{W}, x AS (SELECT host AS site, page_id, coalesce({COUNTRYNAME}, {LOCCOUNTRY}, '') AS l FROM sig) SELECT site, arg_max(l, page_id) AS location FROM x WHERE l <> '' GROUP BY site""")
def site_location_context(spark, d):
    return A.location(host_signals(spark, d), "context")


IND = "ib AS (SELECT host AS site, lower(concat(' ', title, ' ', coalesce(meta, ''), ' ', array_to_string(list_transform(h1, lambda x: concat(' ', x, ' ')), ''))) AS bl FROM sig), " \
      "iw AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{w}')" for i, (n, ws) in enumerate(fv.INDUSTRY_KEYWORDS.items()) for w in ws) + ") v(o, industry, kw)), " \
      "isc AS (SELECT site, o, industry, count(DISTINCT kw) FILTER (contains(bl, kw)) AS score FROM ib, iw GROUP BY ALL), " \
      "industries AS (SELECT site, CASE WHEN score = 0 THEN 'corporate' ELSE industry END AS industry, score FROM isc QUALIFY row_number() OVER (PARTITION BY site ORDER BY score DESC, o) = 1)"


@query("industry_best", f"{W}, {IND} SELECT * FROM industries")
def industry_best(spark, d):
    return A.industry_best(host_signals(spark, d))


@query("industry_best_short", f"{W}, {IND.replace(IND[IND.index('(VALUES'):IND.index(') v(o')], '(VALUES ' + ', '.join(f"({i}, '{n}', '{w}')" for i, (n, ws) in enumerate(fv.INDUSTRY_KEYWORDS_SHORT.items()) for w in ws))} SELECT * FROM industries")
def industry_best_short(spark, d):
    return A.industry_best(host_signals(spark, d), short=True)


PROFILE = f"""{BRANDS}, {LOCATIONS}, {IND}, descs AS (SELECT host AS site, arg_min(meta, page_id) AS description FROM sig WHERE coalesce(meta, '') <> '' GROUP BY host),
  prof AS (SELECT s.site AS site, pages, brand, description, location, industry FROM (SELECT host AS site, count(*) AS pages FROM sig GROUP BY host) s
    LEFT JOIN brands b ON b.site = s.site LEFT JOIN descs d ON d.site = s.site LEFT JOIN locs l ON l.site = s.site LEFT JOIN industries i ON i.site = s.site)"""


@query("site_profile", f"{W}, {PROFILE} SELECT * FROM prof")
def site_profile(spark, d):
    return JB.site_profile(host_signals(spark, d))


@query("site_signals", f"""{W}, {TOPICS}, u AS (SELECT host AS site, 'product' AS kind, unnest({PRODUCTS}) AS value FROM sig
  UNION ALL SELECT (SELECT any_value(host) FROM sig WHERE sig.page_id = topics.page_id), 'topic', topic FROM topics
  UNION ALL SELECT host, 'faq', r.question FROM (SELECT host, unnest({K.FAQ_ENTITIES}) AS r FROM sig)
  UNION ALL SELECT host, 'schema', unnest(jsonld_types) FROM sig
  UNION ALL SELECT host, 'competitor', unnest({_phrases("text")}) FROM sig
  UNION ALL SELECT host, 'alt_issue', concat_ws(' ', CASE WHEN i.alt = '' THEN 'missing' ELSE 'weak' END, i.src) FROM (SELECT host, unnest(images) AS i FROM sig) WHERE length(i.alt) < 3 OR lower(i.alt) IN {K.in_list(fv.WEAK_ALTS)}
  UNION ALL SELECT host, 'geo_signal', concat_ws(' ', 'hreflang', r.hreflang, r.href) FROM (SELECT host, unnest(hreflang) AS r FROM sig)
  UNION ALL SELECT host, 'geo_signal', concat_ws(' ', 'geo_meta', r.name, r.content) FROM (SELECT host, unnest(geo_meta) AS r FROM sig) WHERE contains(lower(r.name), 'geo.')
  UNION ALL SELECT host, 'geo_signal', concat_ws(' ', 'LocalBusiness_schema', coalesce(json_extract_string(x, '$.name'), ''), coalesce(json_extract_string(x, '$.address.addressLocality'), '')) FROM (SELECT host, unnest({LOCAL}) AS x FROM sig))
  SELECT DISTINCT site, kind, value FROM u""")
def site_signals(spark, d):
    return JB.site_signals(host_signals(spark, d))


@query("score_sites", f"""SELECT x.*, y.aeo AS answer_aeo, y.geo AS answer_geo, y.overall AS answer_overall FROM ({PROWS}, {SCORES} SELECT * FROM sc) x JOIN ({AGS}) y ON x.site = y.site""")
def score_sites(spark, d):
    return JB.score_sites(host_signals(spark, d))


KW = f"coalesce(nullif(trim(replace({_seg('url')}, '-', ' ')), ''), trim(string_split_regex(title, '\\s*[|\\-–]\\s*')[1]), '')"


@query("primary_keyword", f"{W} SELECT page_id, site, {KW} AS keyword FROM sig")
def primary_keyword(spark, d):
    return A.primary_keyword(signals(spark, d))
