"""Answers, templates and suggestions, sessions, links, stored files, streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelens.functions import fixed_values as fv
from pagelens.functions import urls as U
from pagelens.operators import domains as D
from pagelens.operators import languages as LG
from pagelens.operators import links as G
from pagelens.operators import recommend as R
from pagelens.operators import sessions as SE
from pagelens.operators import site as A
from pagelens.operators import visibility as V
from pagelens.plans import jobs as JB
from pagelens.sources import io
from pagelens.streaming import stream as ST

from . import sqlkit as K
from .inputs import answers, sessions, signals, table
from .pages import PRODUCTS, TEXT_PAIRS, W, _phrases, _seg
from .registry import query
from .scores import BRANDS, COUNTRYNAME, GUESS, KW, LOCCOUNTRY, PF, PILLARS, PROFILE, PROWS, SCORES, host_signals, passed, rows_sql

c = F.col

# --- answers ----------------------------------------------------------------------------------------
ANS = """ans AS (SELECT concat('s', conv_id % 7) AS site, conv_id * 1000 + turn AS query_id,
    CASE conv_id % 6 WHEN 0 THEN 'brand' WHEN 1 THEN 'service_product' WHEN 2 THEN 'competitor' WHEN 3 THEN 'local_geo' WHEN 4 THEN 'problem_solving' ELSE 'custom' END AS category,
    CASE conv_id % 7 WHEN 0 THEN 'The' WHEN 1 THEN 'Of the' WHEN 2 THEN 'De' WHEN 3 THEN 'En Que' WHEN 4 THEN 'Der' WHEN 5 THEN 'La Paz' ELSE 'Acme' END AS brand,
    concat(text, CASE conv_id % 5 WHEN 0 THEN ' The best options such as Blue Lamp, Acme and IBM are recommended.' WHEN 1 THEN ' Alternatives: Red Desk or Northwind Traders, besides Acme.'
      WHEN 2 THEN ' Acme vs Contoso is also a choice.' ELSE '' END) AS response FROM conversations WHERE role = 'assistant')"""


def _near(ind: str) -> str:
    at = f"instr(lower(response), '{ind}')"
    win = f"CASE WHEN {at} > 0 THEN substr(response, greatest({at} - 100, 1), {at} + 200 - greatest({at} - 100, 1)) ELSE '' END"
    return K.names(f"({win})")


NEAR = "[]"
for _ind in fv.COMPETITOR_INDICATORS:
    NEAR = f"list_concat({NEAR}, {_near(_ind)})"
STRONG_N, WEAK_N = K.count_of("lower(response)", fv.STRONG_WORDS), K.count_of("lower(response)", fv.WEAK_WORDS)
EVAL = f"""ev0 AS (SELECT *, {K.occurrences('lower(response)', 'lower(brand)')} AS exact_mentions,
    {K.occurrences('lower(response)', "string_split(lower(brand), ' ')[1]")} AS partial_mentions,
    list_sort(list_filter(list_distinct({NEAR}), lambda w: lower(w) <> lower(brand) AND length(w) > 2))[1:5] AS competitors,
    {STRONG_N} AS strong_n, {WEAK_N} AS weak_n FROM ans),
  ev AS (SELECT *, CASE WHEN exact_mentions >= 2 THEN 'Strong' WHEN exact_mentions >= 1 THEN 'Medium' WHEN partial_mentions >= 1 THEN 'Weak' ELSE 'None' END AS strength,
    exact_mentions > 0 OR partial_mentions > 0 AS is_mentioned, CASE WHEN NOT contains(lower(response), lower(brand)) THEN 'Not mentioned'
    WHEN strong_n > weak_n THEN 'Best option' ELSE 'One of many' END AS recommendation FROM ev0)"""
WA = f"WITH {ANS}, {EVAL}"


@query("brand_detection", f"{WA} SELECT site, query_id, exact_mentions, partial_mentions, strength, is_mentioned FROM ev")
def brand_detection(spark, d):
    return V.brand_detection(answers(spark, d)).select(
        "site", "query_id", "exact_mentions", "partial_mentions", "strength", "is_mentioned")


@query("brand_fuzzy", f"""WITH {ANS} SELECT site, query_id, contains(lower(response), lower(brand)) OR (len(string_split(lower(brand), ' ')) > 1 AND
  len(list_filter(string_split(lower(brand), ' '), lambda w: contains(lower(response), w))) >= len(string_split(lower(brand), ' ')) * 0.7) AS mentioned FROM ans""")
def brand_fuzzy(spark, d):
    return answers(spark, d).select("site", "query_id", V.brand_mentioned_fuzzy("response", "brand").alias("mentioned"))


@query("answer_competitors", f"{WA} SELECT site, query_id, array_to_string(competitors, '|') AS competitors FROM ev")
def answer_competitors(spark, d):
    return answers(spark, d).select("site", "query_id", F.array_join(V.answer_competitors("response", "brand"), "|").alias("competitors"))


ACR = f"list_filter({K.ext_all('response', r'[\p{L}\p{N}_]+')}, lambda w: {K.has('w', '^[A-Z]{2,}$')})"
NAMES = (f"list_sort(list_filter(list_distinct(list_concat({K.names('response')}, {ACR})), lambda w: lower(w) <> lower(brand) AND length(w) > 2 "
         f"AND lower(w) NOT IN {K.in_list(fv.NAME_STOP_WORDS)}))[1:5]")


@query("answer_names", f"WITH {ANS} SELECT site, query_id, array_to_string({NAMES}, '|') AS names FROM ans")
def answer_names(spark, d):
    return answers(spark, d).select("site", "query_id", F.array_join(V.answer_names("response", "brand"), "|").alias("names"))


@query("recommendation_strength", f"{WA} SELECT site, query_id, recommendation FROM ev")
def recommendation_strength(spark, d):
    return answers(spark, d).select("site", "query_id", V.recommendation_strength("response", "brand").alias("recommendation"))


WEIGHT = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fv.CATEGORY_WEIGHTS.items()) + " ELSE 1.0 END"


@query("visibility_summary", f"""{WA}, p AS (SELECT site, CAST({WEIGHT} AS DOUBLE) AS w, is_mentioned AS m, len(competitors) AS k, CASE WHEN is_mentioned THEN CASE strength WHEN 'Strong' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Weak' THEN 1 END END AS s FROM ev),
  g AS (SELECT site, count(*) AS total_queries, count(*) FILTER (m) AS brand_mentions, CAST(sum(k) AS BIGINT) AS competitor_mentions, sum(w) AS total_weight, sum(CASE WHEN m THEN w ELSE 0 END) AS weighted_score, avg(s) AS s FROM p GROUP BY site)
  SELECT site, round_even(weighted_score / total_weight * 100, 1) AS visibility_score, CASE WHEN brand_mentions + competitor_mentions = 0 THEN 0 ELSE round_even(brand_mentions / (brand_mentions + competitor_mentions) * 100, 1) END AS share_of_ai_voice,
    round_even(coalesce(s, 0), 1) AS strength_score, total_queries, brand_mentions, competitor_mentions, total_weight, weighted_score FROM g""")
def visibility_summary(spark, d):
    return V.visibility_summary(V.evaluate_answers(answers(spark, d)))


@query("top_competitors", f"""{WA}, n AS (SELECT site, name, count(*) AS mentions FROM (SELECT site, unnest(competitors) AS name FROM ev) GROUP BY ALL)
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY mentions DESC, name) AS rank FROM n QUALIFY rank <= 5""")
def top_competitors(spark, d):
    return V.top_competitors(V.evaluate_answers(answers(spark, d)))


@query("simple_visibility", f"{WA} SELECT site, CAST(floor(count(*) FILTER (is_mentioned) * 100 / count(*) + 0.5) AS BIGINT) AS visibility FROM ev GROUP BY site")
def simple_visibility(spark, d):
    return V.simple_visibility(V.brand_detection(answers(spark, d)))


VS = "Brand is mentioned but competitors dominate. Create comparison content: ''Why "


@query("answer_advice", f"""WITH {ANS}, m AS (SELECT site, query_id, brand, concat('query ', query_id) AS query, contains(lower(response), lower(brand)) OR (len(string_split(lower(brand), ' ')) > 1 AND
    len(list_filter(string_split(lower(brand), ' '), lambda w: contains(lower(response), w))) >= len(string_split(lower(brand), ' ')) * 0.7) AS brand_mentioned, coalesce({NAMES}[1], '') AS first_competitor FROM ans)
  SELECT site, query_id, query, brand, brand_mentioned, first_competitor, CASE WHEN brand_mentioned AND first_competitor = '' THEN 'No action needed - brand is well represented.'
    WHEN brand_mentioned THEN concat('{VS}', brand, ' > ', first_competitor, '''.') WHEN first_competitor <> '' THEN concat('Brand missing from answer. Create FAQ schema and blog content targeting: ''', query, '''.')
    ELSE concat('Brand not visible. Create comprehensive content strategy targeting: ''', query, ''' with FAQ schema and blog posts.') END AS recommendation FROM m""")
def answer_advice(spark, d):
    return V.answer_report(answers(spark, d).withColumn("query", F.concat(F.lit("query "), c("query_id").cast("string"))))


NEXTW = "list_filter(string_split_regex(response, '\\s+'), lambda w: w <> '')"
FIRSTNEXT = (f"coalesce(list_filter(list_transform(range(1, len({NEXTW})), lambda i: CASE WHEN lower({NEXTW}[i]) IN {K.in_list(fv.COMPARISON_WORDS)} THEN {NEXTW}[i + 1] END), "
             "lambda x: x IS NOT NULL)[1], '')")


@query("answer_advice_stored", f"""WITH {ANS}, m AS (SELECT site, query_id, brand, concat('query ', query_id) AS query, contains(lower(response), lower(brand)) AS brand_mentioned, {FIRSTNEXT} AS first_competitor FROM ans)
  SELECT site, query_id, query, brand, brand_mentioned, first_competitor, CASE WHEN brand_mentioned AND first_competitor = '' THEN 'Excellent! Brand is mentioned without competitors. Maintain this visibility.'
    WHEN brand_mentioned THEN concat('{VS}', brand, ' > ', first_competitor, '''.') ELSE concat('Brand is missing from AI responses. Create content targeting: ''', query, ''' with clear ', brand, ' positioning.') END AS recommendation FROM m""")
def answer_advice_stored(spark, d):
    return V.answer_report(answers(spark, d).withColumn("query", F.concat(F.lit("query "), c("query_id").cast("string"))), stored=True)


@query("category_counts", f"WITH {ANS} SELECT site, category, count(*) AS queries FROM ans GROUP BY ALL")
def category_counts(spark, d):
    return V.category_counts(answers(spark, d))


@query("select_queries", f"""WITH {ANS}, ch AS (SELECT site, query_id, category, row_number() OVER (PARTITION BY site ORDER BY query_id) AS k FROM ans),
  few AS (SELECT * FROM ch WHERE k <= 4 + CAST(substr(site, 2) AS INT))
  SELECT site, query_id, category FROM few WHERE site IN (SELECT site FROM few GROUP BY site HAVING count(*) <= 8)""")
def select_queries(spark, d):
    """Sites choose 4 to 10 queries each; those that choose more than 8 are refused."""
    a = answers(spark, d)
    k = F.row_number().over(Window.partitionBy("site").orderBy("query_id"))
    chosen = a.withColumn("k", k).where(c("k") <= 4 + F.substring("site", 2, 1).cast("int"))
    return V.select_queries(a, chosen)[0].select("site", "query_id", "category")


@query("select_queries_errors", f"""WITH {ANS}, ch AS (SELECT site, query_id + (CASE WHEN site = 's3' AND query_id % 2 = 0 THEN 1000000000 ELSE 0 END) AS query_id FROM ans WHERE site IN ('s1', 's3') OR query_id % 1000 > 3),
  n AS (SELECT site, count(DISTINCT query_id) AS k, count(DISTINCT query_id) FILTER (query_id >= 1000000000) AS miss FROM ch GROUP BY site)
  SELECT site, CASE WHEN k > 8 THEN 'Maximum 8 queries allowed' ELSE 'Some selected queries not found' END AS error FROM n WHERE k > 8 OR miss > 0""")
def select_queries_errors(spark, d):
    a = answers(spark, d)
    chosen = a.where(c("site").isin("s1", "s3") | (c("query_id") % 1000 > 3)).select("site", (
        c("query_id") + F.when((c("site") == "s3") & (c("query_id") % 2 == 0), 1_000_000_000).otherwise(0)).alias("query_id"))
    return V.select_queries(a, chosen)[1]


PV = f"""{BRANDS}, pv0 AS (SELECT page_id, host AS site, brand, {K.occurrences('lower(text)', 'lower(brand)')} AS nt, {K.occurrences('lower(title)', 'lower(brand)')} AS ntt,
    {K.occurrences("lower(coalesce(meta, ''))", 'lower(brand)')} AS nm FROM sig JOIN brands ON brands.site = sig.host),
  pv AS (SELECT page_id, site, brand, nt > 0 AS mentioned, CAST(least(100, nt * 10 + ntt * 20 + nm * 15) AS BIGINT) AS visibility FROM pv0)"""


@query("page_visibility", f"""{W}, {PV} SELECT page_id, site, brand, mentioned, visibility, visibility > 50 AS snippet_potential, unnest([concat('What is ', brand, '?'), concat('What services does ', brand, ' offer?'),
  concat('How can I contact ', brand, '?'), concat('Where is ', brand, ' located?'), concat('What are ', brand, '''s main products?')]) AS query FROM pv""")
def page_visibility(spark, d):
    s = host_signals(spark, d)
    return V.page_visibility(s, A.brand_name(s))


@query("visibility_advice", f"""{W}, {PV} SELECT page_id, site, brand, visibility, unnest(CASE WHEN visibility < 30 THEN {K.lits(fv.VISIBILITY_ADVICE['low'])} WHEN visibility < 60 THEN {K.lits(fv.VISIBILITY_ADVICE['middle'])}
  ELSE {K.lits(fv.VISIBILITY_ADVICE['high'])} END) AS advice FROM pv""")
def visibility_advice(spark, d):
    s = host_signals(spark, d)
    return V.visibility_advice(V.page_visibility(s, A.brand_name(s)))


# --- templates --------------------------------------------------------------------------------------
def profile(spark, d):
    return JB.profile_for_keywords(host_signals(spark, d))


FULLPROF = f"""{PROFILE}, prods AS (SELECT site, list_sort(list_distinct(list(product)))[1:3] AS products FROM (SELECT host AS site, unnest({PRODUCTS}) AS product FROM sig) GROUP BY site),
  comps AS (SELECT site, min(x) AS competitor FROM (SELECT host AS site, unnest({_phrases('text')}) AS x FROM sig) GROUP BY site),
  fp AS (SELECT prof.site AS site, coalesce(brand, '') AS brand, coalesce(location, '') AS location, coalesce(industry, '') AS industry, coalesce(products, CAST([] AS VARCHAR[])) AS products, coalesce(competitor, '') AS competitor
    FROM prof LEFT JOIN prods ON prods.site = prof.site LEFT JOIN comps ON comps.site = prof.site)"""


def _sqlfill(t: str, slots: dict[str, str]) -> str:
    parts, rest = [], t
    while "{" in rest:
        b, r = rest.split("{", 1)
        n, rest = r.split("}", 1)
        if b:
            parts.append(K.q(b))
        parts.append(slots[n])
    if rest:
        parts.append(K.q(rest))
    return f"concat({', '.join(parts)})"


FQS = {"brand": "brand", "location": "location", "industry": "industry", "product": "coalesce(products[1], 'services')"}
FQ = "fq AS (SELECT site, unnest(list_filter([" + ", ".join(
    f"CASE WHEN {'true' if lo is None else ('location <> ' + K.q('') if lo else 'location = ' + K.q(''))} THEN {{'query_id': CAST({i} AS BIGINT), 'category': '{cat}', 'text': {_sqlfill(t, FQS)}}} END"
    for i, cat, lo, t in fv.QUERY_TEMPLATES) + "], lambda x: x IS NOT NULL)) AS r FROM fp)"


def fallback(spark, d):
    return R.fallback_queries(profile(spark, d).withColumn("product", F.get("products", F.lit(0))))


@query("fallback_queries", f"{W}, {FULLPROF}, {FQ} SELECT site, r.query_id AS query_id, r.category AS category, r.text AS text FROM fq")
def fallback_queries(spark, d):
    return fallback(spark, d)


@query("custom_queries", f"""{W}, {FULLPROF}, {FQ}, cu AS (SELECT site, r.query_id AS o, r.category AS category, r.text AS text FROM fq WHERE site NOT LIKE 'b%' OR r.query_id <= 18
  UNION ALL SELECT host, 1000000 + page_id, 'custom', title FROM sig) SELECT site, category, text, row_number() OVER (PARTITION BY site ORDER BY o) AS query_id FROM cu QUALIFY query_id <= 20""")
def custom_queries(spark, d):
    gen = fallback(spark, d).where(~c("site").like("b%") | (c("query_id") <= 18))
    own = host_signals(spark, d).select("site", c("page_id").alias("pos"), c("title").alias("text"))
    return R.custom_queries(gen, own)


@query("default_queries", f"{W}, {FULLPROF} SELECT site, CAST(i - 1 AS BIGINT) AS pos, q AS query FROM (SELECT site, unnest([{', '.join(_sqlfill(t, FQS) for t in fv.DEFAULT_QUERIES['brand'])}]) AS q, generate_subscripts([1, 2, 3, 4, 5], 1) AS i FROM fp)")
def default_queries(spark, d):
    return R.default_queries(profile(spark, d))


def _idea_rows(templates, kind: str) -> str:
    """Entries in the order they are generated: per product all templates of that group, then the next product."""
    out, done = [], set()
    for t in [x for x in templates if x[0] == kind]:
        if t[2] == 0:
            out.append((t, None))
        elif t[2] not in done:
            done.add(t[2])
            group = [x for x in templates if x[0] == kind and x[2] == t[2]]
            out += [(g, i) for i in range(t[2]) for g in group]
    rows = []
    for t, i in out:
        slots = {"brand": "brand", "location": "location", "industry": "industry", "competitor": "competitor", "product": f"products[{(i or 0) + 1}]"}
        conds = [f"{n} <> ''" for n in (t[3] or "").split("+") if n] + ([f"len(products) > {i}"] if i is not None else [])
        names = ("type", "search_volume", "difficulty", "intent", "potential", "category")
        body = ", ".join(f"'{n}': '{v}'" for n, v in zip(names, t[5:]))
        rows.append(f"CASE WHEN {' AND '.join(conds) or 'true'} THEN {{'text': {_sqlfill(t[4], slots)}, {body}}} END")
    return f"list_filter([{', '.join(rows)}], lambda x: x IS NOT NULL)"


def _ideas_sql(templates, mode: str) -> str:
    sel = "r.text AS text, r.type AS type, r.search_volume AS search_volume, r.difficulty AS difficulty, r.intent AS intent, r.potential AS potential, r.category AS category"
    part = lambda kind, n: (f"SELECT site, '{mode}' AS mode, CAST(i AS BIGINT) AS rank, '{kind}' AS kind, {sel} FROM (SELECT site, unnest(l) AS r, generate_subscripts(l, 1) AS i FROM "  # noqa: E731
                            f"(SELECT site, {_idea_rows(templates, kind)}[1:{n}] AS l FROM fp))")
    return f"{W}, {FULLPROF} {part('keyword', fv.MAX_KEYWORDS)} UNION ALL {part('question', fv.MAX_QUESTIONS)}"


@query("aeo_keywords", _ideas_sql(fv.AEO_TEMPLATES, "AEO"))
def aeo_keywords(spark, d):
    return R.keyword_ideas(profile(spark, d), "AEO")


@query("geo_keywords", _ideas_sql(fv.GEO_TEMPLATES, "GEO"))
def geo_keywords(spark, d):
    return R.keyword_ideas(profile(spark, d), "GEO")


# --- advice and suggestions -------------------------------------------------------------------------
ST0 = f"""st AS (SELECT page_id, site, host, title, url, coalesce(meta, '') AS m, images, {K.any_of('lower(text)', fv.FAQ_WORDS_WIDE)} AS hf, len({TEXT_PAIRS}) AS np,
    contains(array_to_string(jsonld, ' '), 'FAQPage') OR contains(array_to_string(jsonld, ' '), 'Question') AS hs, len(images) AS ni, len(list_filter(images, lambda i: i.alt = '')) AS nm,
    lower(string_split(host, '.')[-1]) AS tld, len(hreflang) AS nh, contains(array_to_string(jsonld, ' '), 'LocalBusiness') OR contains(array_to_string(jsonld, ' '), 'Organization') AS hl,
    (CAST(phone <> '' AS INT) + CAST(address <> '' AS INT)) * CAST(50.0 AS DOUBLE) AS nc, {K.any_of('lower(text)', fv.GEO_WORDS)} OR {K.any_of('lower(title)', fv.GEO_WORDS)} AS hg FROM sig)"""
MQ, MW = "ends_with(trim(m), '?')", K.any_of("lower(m)", fv.META_QUESTION_WORDS)
META_ADV = [("m = ''", "Add meta description optimized for featured snippets"), ("m <> '' AND NOT length(m) BETWEEN 150 AND 160", "Optimize meta description length (150-160 characters)"),
            (f"m <> '' AND NOT {MQ}", "Consider question format for better featured snippet chances"), (f"m <> '' AND NOT {MW}", "Include question words (how, what, why) for AI optimization")]
ADVICE = [("faq", "NOT hf", "Add FAQ section with common customer questions"), ("faq", "NOT hf", "Include questions like 'What services do you offer?' and 'How can I contact you?'"),
          ("faq", "np < 3", "Add more Q&A pairs (aim for 5-10 common questions)"), ("faq", "NOT hs", "Add FAQ schema markup (JSON-LD) for better AI understanding"),
          ("faq", "np > 0", "Optimize existing Q&A for featured snippets (keep answers under 160 characters)"),
          ("alt", "nm > 0", "#Add descriptive alt text to "), ("alt", "nm > 0", "Use specific, descriptive alt text that explains the image content"),
          ("alt", "nm > 0", "Avoid generic alt text like 'image' or 'photo'"), ("alt", "nm > 0", "Include relevant keywords in alt text for better AI understanding"),
          *[("meta", a, b) for a, b in META_ADV],
          ("geo", "nh < 2", "Implement hreflang tags for multilingual targeting"), ("geo", "NOT hl", "Add LocalBusiness or Organization schema markup"),
          ("geo", "nc < 100", "Complete NAP (Name, Address, Phone) information"), ("geo", "NOT hg", "Add geographic targeting signals in content and titles"), ("geo", "NOT hg", "Include location-specific keywords"),
          ("aeo", "NOT hf", "Add FAQ section with common customer questions"), ("aeo", "NOT hs", "Add FAQ schema markup (JSON-LD) for better AI understanding"), ("aeo", "nm > 0", "#Add alt text to "),
          *[("aeo", a, b) for a, b in META_ADV]]


@query("page_advice", f"{W}, {ST0} " + " UNION ALL ".join(
    f"SELECT page_id, site, '{k}' AS kind, " + (f"concat({K.q(t[1:])}, nm, ' images')" if t.startswith("#") else K.q(t)) + f" AS advice FROM st WHERE {cond}" for k, cond, t in ADVICE))
def page_advice(spark, d):
    return R.page_advice(signals(spark, d))


@query("image_analysis", f"{W}, {ST0} SELECT page_id, site, ni AS total_images, nm AS images_without_alt, ni - nm AS images_with_alt FROM st")
def image_analysis(spark, d):
    return R.image_analysis(signals(spark, d))


@query("geo_analysis", f"{W}, {ST0} SELECT page_id, site, tld, nh AS n_hreflang, hl AS has_local_schema, nc AS nap_completeness, hg AS has_geo_content FROM st")
def geo_analysis(spark, d):
    return R.geo_analysis(signals(spark, d))


@query("optimize_meta", f"""{W}, {ST0} SELECT page_id, CASE WHEN m = '' THEN '' WHEN NOT {MQ} AND NOT {MW} AND contains(lower(m), 'service') THEN concat('What services do we offer? ', m)
  WHEN NOT {MQ} AND NOT {MW} AND contains(lower(m), 'about') THEN concat('What is ', replace(lower(m), 'about', ''), '?') WHEN length(m) < 150 THEN concat(m, ' Learn more about our services and solutions.')
  WHEN length(m) > 160 THEN concat(substr(m, 1, 157), '...') ELSE m END AS optimized FROM st""")
def optimize_meta(spark, d):
    return signals(spark, d).select("page_id", R.optimize_meta(F.coalesce("meta", F.lit(""))).alias("optimized"))


def _shorten(s: str, n: int) -> str:
    return f"CASE WHEN length({s}) <= {n} THEN {s} ELSE concat(rtrim(substr({s}, 1, {n - 3})), '...') END"


def _branded(s: str) -> str:
    return f"CASE WHEN brand <> '' AND NOT contains(lower({s}), lower(brand)) THEN concat({s}, ' | ', brand) ELSE {s} END"


SUG = f"""{GUESS}, s0 AS (SELECT page_id, host AS site, url, title, coalesce(meta, '') AS m, coalesce(list_filter(h1, lambda x: x <> '')[1], '') AS hd, images, phone, address, {KW} AS keyword,
    coalesce(nullif({K.in_languages(K.tokens("concat_ws(' ', title, coalesce(meta, ''))"))}, ''), 'en') AS language FROM sig),
  s1 AS (SELECT s0.*, coalesce(brand, '') AS brand FROM s0 LEFT JOIN guessed ON guessed.site = s0.site),
  s2 AS (SELECT *, coalesce(nullif(keyword, ''), nullif(title, ''), nullif(brand, ''), 'Home') AS bs FROM s1),
  s3 AS (SELECT *, {_branded('bs')} AS bt FROM s2),
  s4 AS (SELECT *, CASE WHEN length(title) BETWEEN 1 AND 60 THEN title ELSE {_shorten('bt', 60)} END AS new_title FROM s3),
  s5 AS (SELECT *, coalesce(nullif(title, ''), new_title) AS tl FROM s4),
  s6 AS (SELECT *, CASE WHEN length(m) < 50 THEN trim(concat(m, ' ', tl)) ELSE m END AS pm, CASE WHEN brand <> '' THEN concat(tl, ' - ', brand) ELSE tl END AS pn FROM s5),
  s7 AS (SELECT *, CASE WHEN length(pn) < 50 THEN concat(pn, '.') ELSE pn END AS md, coalesce(nullif(keyword, ''), trim(string_split_regex(tl, '\\s*[|\\-–]\\s*')[1])) AS hh FROM s6),
  s8 AS (SELECT *, CASE WHEN length(m) BETWEEN 50 AND 160 THEN m WHEN m <> '' THEN {_shorten('pm', 160)} ELSE {_shorten('md', 160)} END AS new_meta, CASE WHEN length(hd) BETWEEN 1 AND 70 THEN hd ELSE {_shorten('hh', 70)} END AS new_h1 FROM s7),
  sug AS (SELECT *, coalesce(nullif(keyword, ''), nullif(new_h1, ''), new_title) AS topic FROM s8)"""


def suggested(spark, d):
    s = host_signals(spark, d)
    return R.page_suggestions(s, A.brand_guess(s))


@query("title_suggestions", f"{W}, {SUG} SELECT page_id, site, new_title, new_meta, new_h1 FROM sug")
def title_suggestions(spark, d):
    return R.title_suggestions(suggested(spark, d))


POOR = f"({_seg('url')} <> '' AND (length({_seg('url')}) > 60 OR {K.has(_seg('url'), '[?&=,]')} OR len(regexp_extract_all({_seg('url')}, '[0-9]')) > greatest(6, length({_seg('url')}) // 3)))"
SLUG = f"substr(lower({K.sub(K.sub(K.sub(K.sub('trim(topic)', r'[^A-Za-z0-9\-\s]'), r'\s+', '-'), '-+', '-'), '^-+|-+$')}), 1, 80)"


@query("slug_suggestions", f"{W}, {SUG} SELECT page_id, site, url, {SLUG} AS new_slug FROM sug WHERE {POOR}")
def slug_suggestions(spark, d):
    return R.slug_suggestions(suggested(spark, d))


STEM = "trim(translate(" + K.sub(K.sub(K.sub("i.src", r"(?s)[?#].*$"), r"(?s)^.*/"), r"\.[^.]*$") + ", '-_', '  '))"


@query("alt_suggestions", f"""{W}, {SUG}, ai AS (SELECT page_id, site, brand, keyword, new_h1, unnest(list_filter(images, lambda x: x.alt = '')) AS i FROM sug),
  ak AS (SELECT page_id, site, brand, i.src AS src, coalesce(nullif(trim(keyword), ''), nullif(trim(new_h1), ''), nullif({STEM}, '')) AS k FROM ai), ab AS (SELECT *, {_branded('k')} AS kb FROM ak)
  SELECT page_id, site, src, CASE WHEN k IS NULL THEN 'Descriptive image of the page topic.' ELSE {_shorten('kb', 100)} END AS suggested_alt FROM ab""")
def alt_suggestions(spark, d):
    return R.alt_suggestions(suggested(spark, d))


@query("alt_suggestions_by_name", f"""{W}, x AS (SELECT page_id, site, title, unnest(list_filter(images, lambda z: z.alt = '')).src AS src FROM sig)
  SELECT page_id, site, src, CASE WHEN contains(lower(src), 'logo') THEN concat('Logo for ', coalesce(nullif(title, ''), 'the website')) WHEN contains(lower(src), 'product') THEN concat('Product image for ', coalesce(nullif(title, ''), 'the product'))
    WHEN contains(lower(src), 'team') OR contains(lower(src), 'staff') THEN 'Team member photo' WHEN contains(lower(src), 'office') OR contains(lower(src), 'building') THEN 'Office or building image'
    ELSE concat('Image related to ', coalesce(nullif(title, ''), 'the content')) END AS suggested_alt FROM x""")
def alt_suggestions_by_name(spark, d):
    return R.alt_suggestions_by_name(signals(spark, d))


FP = "CASE substr(language, 1, 2) " + " ".join(
    f"WHEN '{k}' THEN [{_sqlfill(a, {'x': 'topic'})}, {_sqlfill(b, {'x': 'topic'})}]" for k, (a, b) in fv.FAQ_PROMPTS.items()) + " END"


@query("faq_prompts", f"""{W}, {SUG}, fpr AS (SELECT page_id, site, language, unnest({FP}) AS q, generate_subscripts({FP}, 1) AS i FROM sug)
  SELECT page_id, site, language, CAST(i - 1 AS BIGINT) AS pos, q, {K.lits(fv.FAQ_ANSWER_HINTS)}[i] AS a FROM fpr""")
def faq_prompts(spark, d):
    return R.faq_prompts(suggested(spark, d))


@query("faq_jsonld", f"""{W}, x AS (SELECT page_id, {K.FAQ_ENTITIES} AS e FROM sig) SELECT page_id, CASE WHEN len(e) = 0 THEN '' ELSE concat('{{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[',
  array_to_string(list_transform(e, lambda z: concat('{{"@type":"Question","name":', to_json(z.question), ',"acceptedAnswer":{{"@type":"Answer","text":', to_json(z.answer), '}}}}')), ','), ']}}') END AS jsonld FROM x""")
def faq_jsonld(spark, d):
    from pagelens.functions import structured as J

    return signals(spark, d).select("page_id", R.faq_jsonld(J.faq_entities("jsonld")).alias("jsonld"))


@query("page_jsonld", f"""{W}, {SUG}, x AS (SELECT *, coalesce(nullif(brand, ''), nullif(new_h1, ''), new_title) AS nm FROM sug)
  SELECT page_id, site, CASE WHEN phone <> '' OR address <> '' THEN concat('{{"@context":"https://schema.org","@type":"LocalBusiness","name":', to_json(nm), ',"telephone":', to_json(phone), ',"address":{{"@type":"PostalAddress","streetAddress":', to_json(address), '}},"url":', to_json(url), '}}') END AS business_jsonld,
    CASE WHEN {K.any_of('lower(url)', fv.PRODUCT_URL_WORDS)} THEN concat('{{"@context":"https://schema.org","@type":"Product","name":', to_json(topic), ',"brand":', to_json(brand), ',"description":', to_json(new_meta), ',"offers":{{"@type":"Offer","priceCurrency":"EUR","price":"0.00","availability":"https://schema.org/InStock"}}}}') END AS product_jsonld,
    concat('{{"@context":"https://schema.org","@type":"Organization","name":', to_json(brand), '}}') AS org_jsonld FROM x""")
def page_jsonld(spark, d):
    return R.page_jsonld(suggested(spark, d))


@query("prioritized", """WITH r AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS impact, CASE page_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' END AS effort FROM pages)
  SELECT page_id, impact, effort, CASE WHEN impact = 'high' AND effort = 'low' THEN 'critical' WHEN impact = 'high' AND effort = 'high' THEN 'high' WHEN impact = 'low' AND effort = 'low' THEN 'medium' ELSE 'low' END AS priority FROM r""")
def prioritized(spark, d):
    return R.prioritize(table(spark, d, "pages").select(
        "page_id", F.expr("CASE page_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END").alias("impact"),
        F.expr("CASE page_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' END").alias("effort")))


@query("site_context", f"""{W}, few AS (SELECT * REPLACE (CASE WHEN page_id % 3 = 0 THEN concat(url, '/contact') ELSE url END AS url) FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rn FROM sig) WHERE rn <= 5),
  u AS (SELECT host AS site, 'product' AS kind, unnest(list_distinct(list_filter(list_concat(list_transform({K.blocks('jsonld', 'Product')}, lambda x: coalesce(json_extract_string(x, '$.name'), '')),
      list_filter(list_transform(list_filter(headings, lambda h: h.level <= 3), lambda h: h.text), lambda t: length(t) < 100)), lambda p: length(p) >= 1))) AS value FROM few WHERE {K.any_of('lower(url)', ['product', 'shop', 'catalog'])}
    UNION SELECT host, 'faq_topic', unnest(list_concat(list_filter(list_transform(list_filter(headings, lambda h: h.level <= 4 AND contains(h.text, '?')), lambda h: trim(replace(h.text, '?', ''))), lambda t: length(t) > 5 AND length(t) < 100),
      list_filter(list_transform({K.FAQ_ENTITIES}, lambda e: e.question), lambda x: x <> ''))) FROM few
    UNION SELECT host, 'location', arg_max(l, page_id) FROM (SELECT host, page_id, coalesce({COUNTRYNAME}, {LOCCOUNTRY}, '') AS l FROM few WHERE {K.any_of('lower(url)', ['contact', 'about', 'location'])}) WHERE l <> '' GROUP BY host)
  SELECT site, kind, value, row_number() OVER (PARTITION BY site, kind ORDER BY value) AS rank FROM u QUALIFY rank <= (CASE kind WHEN 'product' THEN 10 WHEN 'faq_topic' THEN 5 ELSE 1 END)""")
def site_context(spark, d):
    """Addresses of every third page are taken for contact pages, as the given ones name no role."""
    role = F.when(c("page_id") % 3 == 0, F.concat("url", F.lit("/contact"))).otherwise(c("url"))
    return JB.site_context(host_signals(spark, d).withColumn("url", role))


# --- sessions ---------------------------------------------------------------------------------------
AS_OF = "2024-01-31 00:00:00"
STEPS = ["view", "click", "signup", "purchase"]
SESS = """ss AS (SELECT concat(user_id, '-', strftime(date_trunc('day', ts), '%Y%m%d')) AS id, CAST(user_id % 10 AS VARCHAR) AS site_id, min(ts) AS created_at, max(ts) AS updated_at,
    arg_max(event_type, {'t': ts, 'e': event_id}) AS current_step, max(ts) FILTER (event_type = 'purchase') AS completed_at FROM events GROUP BY user_id, date_trunc('day', ts)),
  sess AS (SELECT *, CASE WHEN completed_at IS NOT NULL THEN 'completed' ELSE 'started' END AS status FROM ss)"""


@query("funnel", f"""WITH {SESS}, g AS (SELECT current_step, count(*) AS sessions FROM sess WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY GROUP BY ALL)
  SELECT current_step, sessions, CAST(sessions * 100.0 / sum(sessions) OVER () AS DOUBLE) AS percentage, CAST(CASE current_step WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS BIGINT) AS step_order FROM g""")
def funnel(spark, d):
    return SE.funnel(sessions(spark, d), AS_OF, STEPS, days=20)


SECS = "(epoch_us(completed_at) / 1e6 - epoch_us(created_at) / 1e6)"


@query("completion_metrics", f"""WITH {SESS} SELECT count(*) AS total_started, count(*) FILTER (status = 'completed') AS total_completed, count(*) FILTER (status = 'completed') * CAST(100.0 AS DOUBLE) / count(*) AS completion_rate,
  round(avg({SECS}) FILTER (status = 'completed') / 60, 6) AS avg_minutes_to_complete FROM sess""")
def completion_metrics(spark, d):
    return SE.completion_metrics(sessions(spark, d)).withColumn("avg_minutes_to_complete", F.round("avg_minutes_to_complete", 6))


@query("abandoned", f"WITH {SESS} SELECT id, site_id, current_step, created_at FROM sess WHERE status = 'started' AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND completed_at IS NULL")
def abandoned(spark, d):
    return SE.abandoned(sessions(spark, d), AS_OF).select("id", "site_id", "current_step", "created_at")


@query("avg_time_to_complete", f"WITH {SESS} SELECT round(avg({SECS}), 3) AS avg_seconds FROM sess WHERE status = 'completed'")
def avg_time_to_complete(spark, d):
    return SE.avg_time_to_complete(sessions(spark, d)).withColumn("avg_seconds", F.round("avg_seconds", 3))


@query("sessions_for_site", f"WITH {SESS} SELECT id, site_id, status, current_step, created_at FROM sess WHERE site_id = '3'")
def sessions_for_site(spark, d):
    return SE.sessions_for_site(sessions(spark, d), "3").select("id", "site_id", "status", "current_step", "created_at")


@query("completed_sessions", f"WITH {SESS} SELECT id, completed_at FROM sess WHERE status = 'completed'")
def completed_sessions(spark, d):
    return SE.completed_desc(sessions(spark, d)).select("id", "completed_at")


@query("retention_cleanup", f"WITH {SESS} SELECT id, status, created_at FROM sess WHERE NOT (status = 'started' AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND completed_at IS NULL)")
def retention_cleanup(spark, d):
    return SE.retention_cleanup(sessions(spark, d), AS_OF).select("id", "status", "created_at")


@query("current_state", "SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def current_state(spark, d):
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "ts", "event_type")
    return SE.current_state(e, "user_id", "at").select("user_id", "event_type", "ts")


# --- stored files and graph -------------------------------------------------------------------------
ROBOTS_EXPR = ("concat('# robots', chr(10), 'User-agent: *', chr(10), CASE k % 4 WHEN 0 THEN 'Disallow: /en/' WHEN 1 THEN 'Disallow: /*.html' WHEN 2 THEN 'Disallow: /' ELSE 'disallow: /fr/*' END, chr(10), 'Disallow:', chr(10), "
               "'Sitemap: https://', host, '/sitemap.xml', chr(10), CASE WHEN k % 3 = 0 THEN concat('User-agent: GPTBot', chr(10), 'User-agent: Other', chr(10), 'Disallow: /') WHEN k % 3 = 1 THEN concat('User-agent: GPTBot', chr(10), 'Disallow: /x') ELSE '' END)")
HOSTS = "hosts AS (SELECT lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host, min(page_id) AS k FROM pages GROUP BY 1)"


def hosts(spark, d):
    return table(spark, d, "pages").groupBy(F.lower(F.regexp_extract("url", "://([^/?#:]+)", 1)).alias("host")).agg(F.min("page_id").alias("k"))


def robots(spark, d):
    return hosts(spark, d).select("host", F.expr(ROBOTS_EXPR).alias("raw"))


RULES = f"""{HOSTS}, rob AS (SELECT host, {ROBOTS_EXPR} AS raw FROM hosts), rl AS (SELECT host, trim(l) AS l, i FROM (SELECT host, unnest(string_split(raw, chr(10))) AS l, generate_subscripts(string_split(raw, chr(10)), 1) AS i FROM rob)),
  rules AS (SELECT host, CAST(i - 1 AS BIGINT) AS line, CASE WHEN starts_with(lower(l), 'disallow:') THEN 'disallow' ELSE 'sitemap' END AS kind, trim(substr(l, strpos(l, ':') + 1)) AS value FROM rl WHERE starts_with(lower(l), 'disallow:') OR starts_with(lower(l), 'sitemap:'))"""


@query("robots_rules", f"WITH {RULES} SELECT * FROM rules")
def robots_rules(spark, d):
    return io.robots_rules(robots(spark, d))


@query("ai_crawler_access", f"WITH {HOSTS} SELECT host, k % 3 <> 0 AS ai_allowed FROM hosts")
def ai_crawler_access(spark, d):
    return io.ai_crawler_access(robots(spark, d))


@query("robots_blocked", f"""WITH {RULES}, pg AS (SELECT page_id, url, {K.host('url')} AS host, coalesce(nullif({K.ext('url', K.U.PATH)}, ''), '/') AS path FROM pages)
  SELECT page_id, url, host, path FROM pg WHERE EXISTS (SELECT 1 FROM rules r WHERE r.host = pg.host AND r.kind = 'disallow' AND r.value NOT IN ('', '/') AND
    CASE WHEN contains(r.value, '*') THEN regexp_matches(pg.path, concat('^', replace(replace(r.value, '.', '\\.'), '*', '.*'), '$')) ELSE starts_with(pg.path, r.value) END)""")
def robots_blocked(spark, d):
    return G.robots_blocked(table(spark, d, "pages"), io.robots_rules(robots(spark, d)))


SITEMAPS = """SELECT host, '/sitemap.xml' AS path, CASE WHEN k % 3 = 0 THEN '' ELSE concat('<urlset xmlns="x"><url><loc> https://', host, '/a?x=1&amp;y=2#f </loc></url><url><loc>/rel/', k, '</loc></url><url><loc>https://other.test/z</loc></url></urlset') END AS body FROM {hosts}
  UNION ALL SELECT host, '/sitemap_index.xml', concat('<sitemapindex><sitemap><loc>https://', host, '/s', k, '.xml</loc></sitemap></sitemapindex>') FROM {hosts}
  UNION ALL SELECT host, '/urls.txt', concat('https://', host, '/t', k, chr(10), chr(10), 'https://', host, '/t2#q') FROM {hosts}"""


@query("sitemap_urls", f"""WITH {HOSTS} SELECT host, concat('https://', host, '/a?x=1&y=2') AS url FROM hosts WHERE k % 3 <> 0 UNION ALL SELECT host, concat('https://', host, '/rel/', k) FROM hosts WHERE k % 3 <> 0
  UNION ALL SELECT host, concat('https://', host, '/s', k, '.xml') FROM hosts WHERE k % 3 = 0 UNION SELECT host, concat('https://', host, '/t', k) FROM hosts UNION SELECT host, concat('https://', host, '/t2') FROM hosts""")
def sitemap_urls(spark, d):
    return io.sitemap_urls(spark.sql(SITEMAPS, hosts=hosts(spark, d)))


STATUS = "st AS (SELECT DISTINCT url, CASE length(url) % 5 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 500 WHEN 3 THEN 200 END AS status FROM edges)"


def edges(spark, d):
    return G.link_edges(host_signals(spark, d))


def url_status(spark, d):
    return edges(spark, d).select(c("dst_url").alias("url")).distinct().withColumn(
        "status", F.expr("CASE length(url) % 5 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 500 WHEN 3 THEN 200 END"))


@query("broken_links", f"{W}, {K.LINKS}, {STATUS} SELECT DISTINCT regexp_extract(page_url, '://([^/?#:]+)', 1) AS site, edges.url AS dst_url, CAST(status AS BIGINT) AS status FROM edges JOIN st ON st.url = edges.url WHERE internal AND status >= 400")
def broken_links(spark, d):
    return G.broken_links(edges(spark, d), url_status(spark, d))


@query("page_broken_links", f"{W}, {K.LINKS}, {STATUS} SELECT page_id AS src_page_id, count(DISTINCT edges.url) AS n_broken FROM edges JOIN st ON st.url = edges.url WHERE internal AND status >= 400 GROUP BY ALL")
def page_broken_links(spark, d):
    return G.page_broken_links(edges(spark, d), url_status(spark, d))


@query("frontier", f"""{W}, {K.LINKS}, he AS (SELECT edges.*, regexp_extract(page_url, '://([^/?#:]+)', 1) AS host FROM edges WHERE internal), f0 AS (SELECT host AS site, url, min(page_id) AS first_seen_on FROM he GROUP BY ALL),
  seen AS (SELECT DISTINCT host AS site, url FROM he WHERE length(url) % 4 = 0), u AS (SELECT site, count(*) AS n FROM seen GROUP BY site),
  f1 AS (SELECT f0.*, CASE WHEN contains(lower(f0.url), 'sitemap') OR ends_with(f0.url, '.xml') THEN 1 ELSE 0 END AS priority FROM f0 ANTI JOIN seen ON seen.site = f0.site AND seen.url = f0.url),
  f2 AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY priority, first_seen_on, url) AS rank FROM f1)
  SELECT f2.site AS site, f2.url AS url, first_seen_on, CAST(priority AS BIGINT) AS priority, rank FROM f2 LEFT JOIN u ON u.site = f2.site WHERE rank <= 20 - coalesce(n, 0)""")
def frontier(spark, d):
    e = edges(spark, d)
    seen = e.where("internal").where(F.length("dst_url") % 4 == 0).select("site", c("dst_url").alias("url"))
    return G.frontier(e, seen, max_pages=20)


DEPTH_EDGES = """pairs AS (SELECT a.page_id AS page_id, a.url AS src, b.url AS dst FROM pages a JOIN pages b ON b.page_id IN (a.page_id * 2 + 1, a.page_id * 2 + 2))"""


@query("crawl_depth", f"""WITH RECURSIVE {DEPTH_EDGES}, clean AS (SELECT regexp_replace(src, '#.*$', '') AS src, regexp_replace(dst, '#.*$', '') AS dst FROM pairs),
  walk(url, depth) AS (SELECT regexp_replace(url, '#.*$', ''), 0 FROM pages WHERE page_id = 0 UNION SELECT c.dst, w.depth + 1 FROM walk w JOIN clean c ON c.src = w.url WHERE w.depth < 40)
  SELECT 'all' AS site, url, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY url""")
def crawl_depth(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    kids = p.select(F.explode(F.array((c("page_id") - 1) / 2, (c("page_id") - 2) / 2)).alias("k"), "url", "page_id").where(
        (c("k") >= 0) & (c("k") == F.floor("k"))).select(c("k").cast("bigint").alias("page_id"), F.regexp_replace("url", "#.*$", "").alias("dst_url"))
    e = p.join(kids, "page_id").select(F.lit("all").alias("site"), c("url").alias("src_url"), "dst_url", F.lit(True).alias("internal"))
    seeds = p.where(c("page_id") == 0).select(F.lit("all").alias("site"), "url")
    return G.crawl_depth(e, seeds, max_pages=None)


@query("technical_only_sites", f"""WITH t AS (SELECT {K.host('url')} AS site, CASE WHEN starts_with({K.host('url')}, 'm.') THEN concat(regexp_replace(url, '[?#].*$', ''), '/sitemap.xml') ELSE url END AS url FROM pages)
  SELECT site, count(*) AS pages, CAST(0 AS BIGINT) AS content_pages, min(concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), '/')) AS root_url FROM t GROUP BY site
  HAVING count(*) FILTER (NOT {K.any_of('lower(url)', ['.xml', '.txt', '.rss', '.atom', 'sitemap'])}) = 0""")
def technical_only_sites(spark, d):
    s = host_signals(spark, d).select("site", F.when(F.startswith("site", F.lit("m.")), F.concat(
        F.regexp_replace("url", "[?#].*$", ""), F.lit("/sitemap.xml"))).otherwise(c("url")).alias("url"))
    return G.technical_only_sites(s)


def cms_pages(spark, d):
    return table(spark, d, "pages").select(
        c("page_id").alias("cms_id"), F.expr("CASE WHEN page_id % 3 = 0 THEN url ELSE '' END").alias("link"),
        F.expr("CASE WHEN page_id % 3 = 1 THEN concat(substr(cast(page_id as string), -1), '.html') WHEN page_id % 3 = 2 THEN regexp_extract(url, '/([0-9]+)$', 1) ELSE '' END").alias("slug"),
        F.concat(F.lit("<p>"), c("page_id").cast("string"), F.lit("</p>")).alias("content"))


CMS = "cms AS (SELECT page_id AS cms_id, CASE WHEN page_id % 3 = 0 THEN url ELSE '' END AS link, CASE page_id % 3 WHEN 1 THEN concat(right(CAST(page_id AS VARCHAR), 1), '.html') WHEN 2 THEN regexp_extract(url, '/([0-9]+)$', 1) ELSE '' END AS slug, concat('<p>', page_id, '</p>') AS content FROM pages)"
MATCH = "cm AS (SELECT p.url AS url, min(cms_id) AS cms_id FROM pages p JOIN cms ON (cms.link <> '' AND cms.link = p.url) OR (cms.slug <> '' AND ends_with(p.url, cms.slug)) GROUP BY p.url)"


@query("cms_match", f"WITH {CMS}, {MATCH} SELECT * FROM cm")
def cms_match(spark, d):
    return G.cms_match(table(spark, d, "pages").select("url"), cms_pages(spark, d))


@query("cms_payload", f"""WITH {CMS}, {MATCH}, s AS (SELECT url, concat('T', page_id) AS t, CASE WHEN page_id % 2 = 0 THEN 'H' ELSE '' END AS h, page_id FROM pages)
  SELECT s.url AS url, cm.cms_id AS cms_id, t AS title, nullif('', '') AS meta_description, CASE WHEN h <> '' OR page_id % 5 = 0 THEN concat(CASE WHEN h <> '' THEN concat('<h1>', h, '</h1>', chr(10), content) ELSE content END,
    CASE WHEN page_id % 5 = 0 THEN concat(chr(10), '<div class="faq-section"><h2>Frequently Asked Questions</h2><div class="faq-item"><h3>Q1</h3><p>A1</p></div></div>') ELSE '' END) END AS content FROM s JOIN cm ON cm.url = s.url JOIN cms ON cms.cms_id = cm.cms_id""")
def cms_payload(spark, d):
    sug = table(spark, d, "pages").select(
        "url", F.concat(F.lit("T"), c("page_id").cast("string")).alias("new_title"), F.lit("").alias("new_meta"),
        F.when(c("page_id") % 2 == 0, "H").otherwise("").alias("new_h1"),
        F.expr("CASE WHEN page_id % 5 = 0 THEN array(struct('Q1' AS q, 'A1' AS a)) ELSE cast(array() as array<struct<q:string,a:string>>) END").alias("faq"))
    return JB.cms_updates(sug, cms_pages(spark, d))["payload"]


@query("stored_replies", """WITH r AS (SELECT conv_id, turn, conv_id % 5 AS k, text FROM conversations)
  SELECT conv_id, turn, k IN (0, 1, 2) AS valid, CASE WHEN k IN (0, 1, 2) THEN concat('id', conv_id) ELSE '' END AS title FROM r""")
def stored_replies(spark, d):
    raw = F.expr("""CASE conv_id % 5 WHEN 0 THEN concat('{"title":"id', conv_id, '"}') WHEN 1 THEN concat('```json', chr(10), '{"title":"id', conv_id, '"}', chr(10), '```')
      WHEN 2 THEN concat('Sure, here it is: {"title":"id', conv_id, '"} Anything else?') WHEN 3 THEN '{broken' ELSE text END""")
    r = table(spark, d, "conversations").select("conv_id", "turn", raw.alias("raw"))
    return io.ingest_replies(r, "struct<title:string>").select(
        "conv_id", "turn", "valid", F.coalesce("parsed.title", F.lit("")).alias("title"))


@query("latest_audit", "SELECT CAST(user_id AS VARCHAR) AS site, arg_max(event_id, {'t': ts, 'e': event_id}) AS audit_id, arg_max(event_type, {'t': ts, 'e': event_id}) AS result, max(ts) AS created_at FROM events GROUP BY ALL")
def latest_audit(spark, d):
    return io.latest_audit(table(spark, d, "events").select(
        c("user_id").cast("string").alias("site"), c("event_id").alias("audit_id"), c("event_type").alias("result"), c("ts").alias("created_at")))


@query("sample_pages", f"SELECT {K.host('url')} AS site, page_id, url FROM pages QUALIFY row_number() OVER (PARTITION BY {K.host('url')} ORDER BY page_id) <= 10")
def sample_pages(spark, d):
    return io.sample_pages(host_signals(spark, d).select("site", "page_id", "url"))


SITES_SQL = "sites AS (SELECT CAST(user_id AS VARCHAR) AS site, min(ts) AS created_at FROM events GROUP BY ALL)"


def stored_sites(spark, d):
    return table(spark, d, "events").groupBy(c("user_id").cast("string").alias("site")).agg(F.min("ts").alias("created_at"))


@query("list_sites", f"WITH {SITES_SQL} SELECT site, created_at FROM sites ORDER BY created_at DESC, site LIMIT 10")
def list_sites(spark, d):
    return io.list_sites(stored_sites(spark, d))


@query("site_bundle", f"""{W}, n AS (SELECT host AS site, count(*) AS pages_count, min(page_id) AS first_page, max(url) AS created_at FROM sig GROUP BY host), f AS (SELECT host AS site, page_id, title FROM sig QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) <= 10)
  SELECT n.site AS site, pages_count, (SELECT string_agg(concat(page_id, ':', title), ' | ' ORDER BY page_id) FROM f WHERE f.site = n.site) AS pages, (SELECT max(page_id) FROM sig WHERE sig.host = n.site) AS audit_id FROM n""")
def site_bundle(spark, d):
    s = host_signals(spark, d).select("site", "page_id", "url", "title")
    audits = s.select("site", c("page_id").alias("audit_id"), c("page_id").alias("created_at"))
    b = io.site_bundle(s.select("site").distinct(), s, audits)
    return b.select("site", "pages_count", F.array_join(F.transform("pages", lambda p: F.concat(
        p["page_id"].cast("string"), F.lit(":"), p["title"])), " | ").alias("pages"), c("audit.audit_id").alias("audit_id"))


@query("cms_unmatched", f"WITH {CMS}, {MATCH} SELECT url FROM pages WHERE url NOT IN (SELECT url FROM cm)")
def cms_unmatched(spark, d):
    sug = table(spark, d, "pages").select("url", F.lit("T").alias("new_title"), F.lit("").alias("new_meta"), F.lit("").alias("new_h1"),
                                          F.expr("cast(array() as array<struct<q:string,a:string>>)").alias("faq"))
    return JB.cms_updates(sug, cms_pages(spark, d))["unmatched"].select("url")


AUDIT = f"""{W}, {K.LINKS}, {STATUS}, {RULES}, bad AS (SELECT page_id, count(DISTINCT edges.url) AS n_broken FROM edges JOIN st ON st.url = edges.url WHERE internal AND status >= 400 GROUP BY ALL),
  blk AS (SELECT page_id FROM sig WHERE EXISTS (SELECT 1 FROM rules r WHERE r.host = sig.host AND r.kind = 'disallow' AND r.value NOT IN ('', '/') AND
    CASE WHEN contains(r.value, '*') THEN regexp_matches(coalesce(nullif(sig.path, ''), '/'), concat('^', replace(replace(r.value, '.', '\\.'), '*', '.*'), '$')) ELSE starts_with(coalesce(nullif(sig.path, ''), '/'), r.value) END))"""


@query("audit_full_pages", f"{AUDIT} SELECT sig.page_id AS page_id, sig.url AS url, title, word_count, coalesce(n_broken, 0) AS n_broken, blk.page_id IS NOT NULL AS blocked_by_robots FROM sig LEFT JOIN bad ON bad.page_id = sig.page_id LEFT JOIN blk ON blk.page_id = sig.page_id")
def audit_full_pages(spark, d):
    from .inputs import aug_pages

    out = JB.audit_full(aug_pages(spark, d), robots(spark, d), url_status(spark, d))
    return out["pages"].select("page_id", "url", "title", "word_count", "n_broken", "blocked_by_robots")


# --- registrable domains by a table of suffixes -----------------------------------------------------
SUFFIXES = ["com", "uk", "co.uk", "*.ck", "!www.ck", "io", "github.io", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "example", "shop.example"]
HOST_EXPR = """CASE page_id % 14 WHEN 0 THEN concat('w', page_id, '.shop.co.uk') WHEN 1 THEN 'co.uk' WHEN 2 THEN concat('a.b', page_id, '.ck') WHEN 3 THEN 'www.ck' WHEN 4 THEN concat('x', page_id, '.www.ck')
  WHEN 5 THEN concat('pages.user', page_id, '.github.io') WHEN 6 THEN 'github.io' WHEN 7 THEN concat('x', page_id, '.y.kawasaki.jp') WHEN 8 THEN concat('a', page_id, '.city.kawasaki.jp') WHEN 9 THEN concat('WWW.Example', page_id, '.COM.')
  WHEN 10 THEN 'localhost' WHEN 11 THEN concat('10.0.0.', page_id) WHEN 12 THEN concat('s', page_id, '.unknown.zz') ELSE 'ck' END"""


def suffix_sql(hosts: str) -> str:
    """``dom(host, suffix, domain)`` of ``hosts``, each rule tried on each host."""
    return f"""{hosts}, hl AS (SELECT host, regexp_replace(lower(host), '\\.$', '') AS h, regexp_matches(host, '^([0-9]+\\.){{3}}[0-9]+$') AS number FROM (SELECT DISTINCT host FROM hosts0)),
  sr AS (SELECT unnest({K.lits(SUFFIXES)}) AS r),
  sm AS (SELECT host, arg_max(len(string_split(r, '.')) - starts_with(r, '!')::INT, 1000 * starts_with(r, '!')::INT + len(string_split(r, '.'))) AS n FROM hl JOIN sr ON
    CASE WHEN starts_with(r, '!') THEN h = substr(r, 2) OR ends_with(h, concat('.', substr(r, 2))) WHEN starts_with(r, '*.') THEN regexp_matches(h, concat('(^|\\.)[^.]+\\.', replace(substr(r, 3), '.', '\\.'), '$')) ELSE h = r OR ends_with(h, concat('.', r)) END GROUP BY host),
  dl AS (SELECT hl.host, number, string_split(h, '.') AS l, coalesce(n, 1) AS n FROM hl LEFT JOIN sm USING (host)),
  dom AS (SELECT host, CASE WHEN NOT number THEN array_to_string(l[-n:], '.') END AS suffix, CASE WHEN number THEN host WHEN len(l) > n THEN array_to_string(l[-(n + 1):], '.') END AS domain FROM dl)"""


def suffixes(spark):
    lines = spark.createDataFrame([(x,) for x in ["// a comment", "", *SUFFIXES]], "line string")
    return D.suffix_rules(lines)


@query("registrable_domains", "WITH " + suffix_sql(f"hosts0 AS (SELECT {HOST_EXPR} AS host FROM pages UNION ALL SELECT {K.host('url')} FROM pages)") + " SELECT * FROM dom")
def registrable_domains(spark, d):
    pages = table(spark, d, "pages")
    hosts = pages.select(F.expr(HOST_EXPR).alias("host")).unionByName(pages.select(U.host_of("url").alias("host")))
    return D.registrable_domains(hosts, suffixes(spark))


@query("links_by_domain", f"""{W}, {K.LINKS}, he AS (SELECT page_id, url, {K.host('page_url')} AS src, {K.host('url')} AS dst FROM edges),
  {suffix_sql('hosts0 AS (SELECT src AS host FROM he UNION ALL SELECT dst FROM he)')}
  SELECT coalesce(s.domain, s.host) AS site, page_id AS src_page_id, he.url AS dst_url, coalesce(s.domain, s.host) = coalesce(t.domain, t.host) AS internal FROM he JOIN dom s ON s.host = he.src JOIN dom t ON t.host = he.dst""")
def links_by_domain(spark, d):
    return D.edges_by_domain(host_signals(spark, d), suffixes(spark)).select("site", "src_page_id", "dst_url", "internal")


# --- languages by learned profiles -------------------------------------------------------------------
def grams_sql(name: str, source: str, keys: str) -> str:
    return f"""{name}w AS (SELECT {keys}, unnest(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g'), ' ')) AS w FROM {source}),
  {name} AS (SELECT {keys}, substr(concat(' ', w, ' '), i, 3) AS gram, count(*) AS n FROM (SELECT {keys}, w, unnest(range(1, length(w) + 1)) AS i FROM {name}w WHERE w <> '') GROUP BY ALL)"""


LANGS = f"""WITH {grams_sql('tr', '(SELECT lang, text FROM documents WHERE doc_id % 5 <> 0)', 'lang')},
  tot AS (SELECT lang, sum(n) AS total, (SELECT count(DISTINCT gram) FROM tr) AS kinds FROM tr GROUP BY lang),
  pro AS (SELECT tr.lang, gram, CAST(round(1000 * ln((n + 0.5) / (total + 0.5 * kinds))) AS BIGINT) AS score FROM tr JOIN tot USING (lang)
    UNION ALL SELECT lang, NULL, CAST(round(1000 * ln(0.5 / (total + 0.5 * kinds))) AS BIGINT) FROM tot)"""


def profiles(spark, d):
    return LG.language_profiles(table(spark, d, "documents").where("doc_id % 5 <> 0").select("lang", "text"))


@query("language_profiles", f"{LANGS} SELECT * FROM pro")
def language_profiles(spark, d):
    return profiles(spark, d)


@query("detected_languages", f"""{LANGS}, {grams_sql('te', 'documents', 'doc_id')},
  al AS (SELECT doc_id, gram, n, lang FROM te CROSS JOIN tot), fl AS (SELECT lang, score AS f FROM pro WHERE gram IS NULL),
  lk AS (SELECT doc_id, al.lang, sum(n * coalesce(score, f)) AS s, sum(n) AS g FROM al JOIN fl ON fl.lang = al.lang LEFT JOIN pro ON pro.lang = al.lang AND pro.gram = al.gram GROUP BY ALL),
  be AS (SELECT doc_id, lang FROM lk WHERE g >= 20 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) = 1)
  SELECT doc_id, be.lang AS lang_found FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN be USING (doc_id)""")
def detected_languages(spark, d):
    return LG.detect_languages(table(spark, d, "documents").select("doc_id", "text"), profiles(spark, d), "doc_id")


# Scores on the audited record: link health and robots rules count, so "broken" and "indexable" pass or fail.
AUDITED = [x for x in PILLARS if x[:2] not in (("TECH", "broken"), ("TECH", "indexable"))] + [
    passed("TECH", "broken", "n_broken = 0", 5, "Fix broken internal links."),
    passed("TECH", "indexable", "NOT blocked AND NOT contains(lower(coalesce(meta_robots, '')), 'noindex')", 5, "Ensure important pages are not blocked or noindex.")]
RECORD = f"""{AUDIT}, {PF}, pa AS (SELECT pl.*, coalesce(bad.n_broken, 0) AS n_broken, blk.page_id IS NOT NULL AS blocked FROM pl LEFT JOIN bad ON bad.page_id = pl.page_id LEFT JOIN blk ON blk.page_id = pl.page_id),
  {rows_sql("pa", AUDITED)}, ck AS (SELECT page_id, host AS site, word_count, r.* FROM rows0)"""


def audited(spark, d):
    """The record of all pages, extracted and stored once under the shared folder; sites are hosts, as in the other audits.

    The statuses belong to the pages' own links, which are read from the stored signals and not extracted anew.
    """
    import uuid

    from pagelens.session import checkpoint_ready

    from .inputs import aug_pages

    checkpoint_ready(spark)
    name = f"record_{uuid.uuid4().hex}"
    kept = {"buckets": 8, "folder": spark.sparkContext.getCheckpointDir()}
    stored = JB.stored_signals(aug_pages(spark, d), name, **kept)
    record = JB.stored_health(stored, name, robots(spark, d), audited_statuses(stored), **kept)
    return record.withColumn("site", c("host"))


def audited_statuses(record):
    return G.link_edges(record).select(c("dst_url").alias("url")).distinct().withColumn(
        "status", F.expr("CASE length(url) % 5 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 500 WHEN 3 THEN 200 END"))


@query("audit_scores", f"{RECORD}, {SCORES} SELECT * FROM sc")
def audit_scores(spark, d):
    record = audited(spark, d)
    return JB.score_audit(record, audited_statuses(record))["scores"]


@query("audit_technical_checks", f"{RECORD} SELECT page_id, site, \"check\", points, present, task FROM ck WHERE pillar = 'TECH'")
def audit_technical_checks(spark, d):
    record = audited(spark, d)
    rows = JB.score_audit(record, audited_statuses(record))["checks"]
    return rows.where("pillar = 'TECH'").select("page_id", "site", "check", "points", "present", "task")


@query("audit_rollup", f"""{AUDIT}, bu AS (SELECT host, count(DISTINCT edges.url) AS n FROM edges JOIN st ON st.url = edges.url JOIN sig ON sig.page_id = edges.page_id WHERE internal AND status >= 400 GROUP BY host),
  ro AS (SELECT host, count(*) AS n FROM sig JOIN blk USING (page_id) GROUP BY host)
  SELECT sig.host AS site, count(*) AS pages, count(DISTINCT lang) AS n_languages, count(*) FILTER (coalesce(canonical, '') <> '') AS pages_with_canonical,
  count(*) FILTER (contains(lower(coalesce(meta_robots, '')), 'index')) AS index_pages, count(*) FILTER (contains(lower(coalesce(meta_robots, '')), 'noindex')) AS noindex_pages,
  count(*) FILTER (contains(lower(coalesce(meta_robots, '')), 'index') AND NOT contains(lower(coalesce(meta_robots, '')), 'noindex')) AS index_only_pages,
  coalesce(any_value(ro.n), 0) AS pages_blocked_by_robots, CAST(sum(len(list_filter(images, lambda i: i.alt = ''))) AS BIGINT) AS images_missing_alt,
  coalesce(any_value(bu.n), 0) AS broken_unique FROM sig LEFT JOIN bu ON bu.host = sig.host LEFT JOIN ro ON ro.host = sig.host GROUP BY sig.host""")
def audit_rollup(spark, d):
    record = audited(spark, d)
    return JB.score_audit(record, audited_statuses(record))["rollup"]


# --- streams ----------------------------------------------------------------------------------------
def _drain(spark, df, mode: str = "append"):
    """Run a stream over all stored rows into a table in the shared folder and read it back."""
    import uuid

    from pagelens.session import checkpoint_ready

    checkpoint_ready(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4()}"
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(
        availableNow=True).start(f"{root}/rows")
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/rows"), (q.lastProgress or {}).get("eventTime", {}).get("watermark")


def _with_open(spark, d, form, end: str):
    """All windows: those the stream closed, and those still open when the stored rows end, in batch form."""
    closed, watermark = _drain(spark, form(event_stream(spark, d)))
    batch = form(table(spark, d, "events"))
    return closed.unionByName(ST.still_open(batch, end, watermark))


def event_stream(spark, d):
    return ST.read_stream(spark, f"{d}/events*.parquet", table(spark, d, "events").schema)


@query("stream_funnel", """WITH w AS (SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL)
  SELECT * FROM w""")
def stream_funnel(spark, d):
    return _with_open(spark, d, ST.stream_funnel, "window_end")


@query("stream_page_audit", f"{PROWS} SELECT page_id, site, pillar, \"check\", points, max_points, present FROM ck".replace("page_id, host AS site, word_count, r.*", "page_id, site, word_count, r.*"))
def stream_page_audit(spark, d):
    from .inputs import AUGMENT

    raw = ST.read_stream(spark, f"{d}/pages*.parquet", table(spark, d, "pages").schema)
    pages = raw.select("page_id", "url", F.expr(AUGMENT).alias("html"))
    return _drain(spark, ST.stream_page_audit(pages))[0].drop("scheme", "task")


@query("stream_frontier_dedup", "SELECT DISTINCT user_id * 10 + event_id % 7 AS url FROM events")
def stream_frontier_dedup(spark, d):
    e = event_stream(spark, d).select((c("user_id") * 10 + c("event_id") % 7).alias("url"), "ts")
    return _drain(spark, ST.stream_frontier_dedup(e, "60 days"))[0].select("url")


@query("stream_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events),
  s AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), g AS (SELECT user_id, k, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY ALL)
  SELECT user_id, session_start, session_end, n FROM g""")
def stream_sessions(spark, d):
    return _with_open(spark, d, ST.stream_sessions, "session_end")
