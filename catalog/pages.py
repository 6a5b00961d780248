"""Page queries: text, tags, structured data, questions, topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelens.functions import fixed_values as fv
from pagelens.functions import text as T
from pagelens.functions import urls as U
from pagelens.operators import grams as GR
from pagelens.operators import links as G
from pagelens.operators import page_rows as P
from pagelens.operators import recommend as R
from pagelens.operators import site as A

from . import sqlkit as K
from .inputs import signals, table
from .registry import query

c = F.col
W = f"WITH {K.SIG}"
STOP = ["the", "of", "and", "to", "in", "is", "it", "that", "for", "on", "with", "as", "at", "this", "are", "or"]


# --- scan, text, url ------------------------------------------------------------------------------
@query("page_titles", f"{W} SELECT page_id, title, has_title_tag FROM sig")
def page_titles(spark, d):
    return signals(spark, d).select("page_id", "title", "has_title_tag")


@query("page_headings", f"{W} SELECT page_id, site, r.level AS level, r.text AS text FROM (SELECT page_id, site, unnest(headings) AS r FROM sig)")
def page_headings(spark, d):
    return P.heading_rows(signals(spark, d))


@query("page_head_tags", f"{W} SELECT page_id, coalesce(lang, '') AS lang, coalesce(canonical, '') AS canonical, "
       "coalesce(meta_robots, '') AS meta_robots, coalesce(meta, '') AS meta FROM sig")
def page_head_tags(spark, d):
    e = lambda n: F.coalesce(n, F.lit("")).alias(n)
    return signals(spark, d).select("page_id", e("lang"), e("canonical"), e("meta_robots"), e("meta"))


@query("page_links", f"{W}, {K.LINKS} SELECT page_id, site, url, internal FROM edges")
def page_links(spark, d):
    return P.page_links(signals(spark, d))


@query("page_links_netloc", f"{W}, {K.LINKS} SELECT DISTINCT page_id, site, full_url AS url FROM lk WHERE {K.netloc('full_url')} = netloc")
def page_links_netloc(spark, d):
    return P.page_links(signals(spark, d), "netloc")


@query("page_links_path_only", f"{W}, {K.LINKS} SELECT DISTINCT page_id, site, {K.sub('full_url', r'(?s)[?#].*$')} AS url FROM lk "
       f"WHERE {K.netloc('full_url')} = netloc AND NOT {K.has('href', r'^(?:javascript:|mailto:|tel:|#|data:)')}")
def page_links_path_only(spark, d):
    return P.page_links(signals(spark, d), "path_only")


@query("page_links_no_images", f"{W}, {K.LINKS} SELECT DISTINCT page_id, site, {K.sub('trim(full_url)', r'(?s)#.*$')} AS url FROM lk "
       f"WHERE (contains(href, netloc) OR NOT contains(href, ':')) AND NOT {K.has('full_url', r'\.(?:img|png|jpg|jpeg|gif|bmp|svg|webp|avif)$')}")
def page_links_no_images(spark, d):
    return P.page_links(signals(spark, d), "no_images")


@query("link_counts", f"{W}, {K.LINKS} SELECT page_id, site, count(*) FILTER (internal) AS n_internal, count(*) FILTER (NOT internal) AS n_external FROM edges GROUP BY ALL")
def link_counts(spark, d):
    return G.link_counts(signals(spark, d))


@query("word_counts", f"{W} SELECT page_id, word_count, html_bytes, {K.word_count('text')} AS words_again, "
       f"CAST(len({K.tokens('text')}) AS BIGINT) AS n_tokens FROM sig")
def word_counts(spark, d):
    return signals(spark, d).select("page_id", "word_count", "html_bytes", T.word_count("text").alias("words_again"),
                                    F.size(T.tokens("text")).alias("n_tokens"))


@query("content_hash", f"{W} SELECT page_id, sha1(html) AS content_hash FROM sig")
def content_hash(spark, d):
    return signals(spark, d).select("page_id", "content_hash")


def _seg(u: str) -> str:
    behind = K.sub(u, r"(?s)^.*?://")
    rest = f"(CASE WHEN contains({behind}, '/') THEN {K.sub(behind, '(?s)^[^/]*/')} ELSE {behind} END)"
    return f"string_split(trim({K.sub(rest, '^/+|/+$')}), '/')[-1]"


@query("url_parts", f"""{W} SELECT page_id, host, path, {K.ext('url', U.QUERY)} AS query, site,
  starts_with(lower(url), 'https://') AS https, lower(string_split(host, '.')[-1]) AS tld,
  CASE lower(string_split(host, '.')[-1]) WHEN 'lt' THEN 'lt' WHEN 'de' THEN 'de' WHEN 'fr' THEN 'fr' WHEN 'es' THEN 'es' WHEN 'it' THEN 'it' WHEN 'pl' THEN 'pl' ELSE 'en' END AS url_language,
  trim(replace({_seg('url')}, '-', ' ')) AS slug_keyword,
  ({_seg('url')} <> '' AND (length({_seg('url')}) > 60 OR {K.has(_seg('url'), '[?&=,]')} OR
   len(regexp_extract_all({_seg('url')}, '[0-9]')) > greatest(6, length({_seg('url')}) // 3))) AS slug_is_poor,
  concat(upper({_seg('host')}[1:1]), '') AS initial, {K.sub('trim(url)', '(?s)#.*$')} AS plain_url FROM sig""")
def url_parts(spark, d):
    s = signals(spark, d)
    return s.select("page_id", "host", "path", U.query_of("url").alias("query"), "site", U.is_https("url").alias("https"),
                    U.tld("host").alias("tld"), U.url_language("url").alias("url_language"),
                    U.slug_keyword("url").alias("slug_keyword"), U.slug_is_poor("url").alias("slug_is_poor"),
                    F.upper(F.substring("host", 1, 1)).alias("initial"), U.strip_fragment("url").alias("plain_url"))


@query("https_share", f"{W} SELECT host AS site, count(*) AS pages, count(*) FILTER (starts_with(lower(url), 'https://')) AS https_pages FROM sig GROUP BY ALL")
def https_share(spark, d):
    return signals(spark, d).groupBy(c("host").alias("site")).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(U.is_https("url")).alias("https_pages"))


# --- head, images, structured data ------------------------------------------------------------------
@query("social_tags", f"{W} SELECT page_id, site, CAST(len(og) AS BIGINT) AS n_og, {K.og_has('og:title')} AS has_og_title, "
       f"{K.og_has('og:description')} AS has_og_description, {K.og_has('og:image')} AS has_og_image, viewport IS NOT NULL AS has_viewport, "
       "coalesce(charset, '') AS charset FROM sig")
def social_tags(spark, d):
    return P.social_and_device_tags(signals(spark, d))


@query("image_rows", f"{W} SELECT page_id, site, i.src AS src, i.alt AS alt, i.loading AS loading, coalesce(i.width, '') AS width, "
       "coalesce(i.height, '') AS height FROM (SELECT page_id, site, unnest(images) AS i FROM sig)")
def image_rows(spark, d):
    return P.image_rows(signals(spark, d)).withColumn("width", F.coalesce("width", F.lit(""))).withColumn(
        "height", F.coalesce("height", F.lit("")))


@query("image_alt_issues", f"{W} SELECT page_id, site, i.src AS src, i.alt AS alt, CASE WHEN i.alt = '' THEN 'missing' ELSE 'weak' END AS issue "
       f"FROM (SELECT page_id, site, unnest(images) AS i FROM sig) WHERE length(i.alt) < 3 OR lower(i.alt) IN {K.in_list(fv.WEAK_ALTS)}")
def image_alt_issues(spark, d):
    return P.alt_issues(signals(spark, d))


@query("image_alt_issues_short", f"{W} SELECT page_id, site, i.src AS src, i.alt AS alt, CASE WHEN i.alt = '' THEN 'missing' ELSE 'weak' END AS issue "
       "FROM (SELECT page_id, site, unnest(images) AS i FROM sig) WHERE length(i.alt) < 5")
def image_alt_issues_short(spark, d):
    return P.alt_issues(signals(spark, d), "short")


@query("performance_hints", f"{W} SELECT page_id, site, html_bytes, CAST(len(images) AS BIGINT) AS n_images, "
       "CAST(len(list_filter(images, lambda i: i.loading = 'lazy')) AS BIGINT) AS images_lazy, "
       "CAST(len(list_filter(images, lambda i: coalesce(i.width, '') = '' OR coalesce(i.height, '') = '')) AS BIGINT) AS images_no_dimensions, "
       "CAST(len(list_filter(images, lambda i: i.alt = '')) AS BIGINT) AS images_missing_alt FROM sig")
def performance_hints(spark, d):
    return P.performance_hints(signals(spark, d))


@query("jsonld_types", f"{W} SELECT page_id, site, type, count(*) AS n FROM (SELECT page_id, site, unnest(jsonld_types) AS type FROM sig) GROUP BY ALL")
def jsonld_types(spark, d):
    return P.jsonld_type_rows(signals(spark, d))


@query("hreflang_rows", f"{W} SELECT page_id, site, url, r.hreflang AS hreflang, r.href AS href FROM (SELECT page_id, site, url, unnest(hreflang) AS r FROM sig)")
def hreflang_rows(spark, d):
    return P.hreflang_pairs(signals(spark, d))


@query("geo_signal_rows", f"""{W} SELECT page_id, site, 'hreflang' AS type, r.hreflang AS name, r.href AS value FROM (SELECT page_id, site, unnest(hreflang) AS r FROM sig)
  UNION ALL SELECT page_id, site, 'geo_meta', r.name, r.content FROM (SELECT page_id, site, unnest(geo_meta) AS r FROM sig) WHERE contains(lower(r.name), 'geo.')
  UNION ALL SELECT page_id, site, 'LocalBusiness_schema', coalesce(json_extract_string(x, '$.name'), ''), coalesce(json_extract_string(x, '$.address.addressLocality'), '')
  FROM (SELECT page_id, site, unnest({K.blocks('jsonld', 'LocalBusiness')}) AS x FROM sig)""")
def geo_signal_rows(spark, d):
    return P.geo_signal_rows(signals(spark, d))


@query("map_embeds", f"""{W} SELECT page_id, site, CASE WHEN contains(x, 'openstreetmap.org') THEN 'openstreetmap' ELSE 'google_maps' END AS type, x AS src
  FROM (SELECT page_id, site, unnest(frame_srcs) AS x FROM sig) WHERE contains(x, 'google.com/maps') OR contains(x, 'maps.google.com') OR contains(x, 'openstreetmap.org')""")
def map_embeds(spark, d):
    return P.map_embeds(signals(spark, d))


@query("meta_profile", f"""{W} SELECT page_id, site, coalesce(meta_raw, '') <> '' AS present, length(coalesce(meta_raw, '')) AS length,
  length(coalesce(meta_raw, '')) BETWEEN 150 AND 160 AS optimal_length,
  (coalesce(meta_raw, '') <> '' AND (ends_with(trim(coalesce(meta_raw, '')), '?') OR {K.any_of("coalesce(meta_raw, '')", fv.SNIPPET_MARKERS)})) AS snippet_suitable FROM sig""")
def meta_profile(spark, d):
    return P.meta_profile(signals(spark, d))


@query("snippet_score", f"{W} SELECT page_id, site, n_lists, n_tables, n_short_p, least(100, n_lists * 10 + n_tables * 15 + n_short_p * 2) AS snippet_score FROM sig")
def snippet_score(spark, d):
    return P.snippet_profile(signals(spark, d))


LAST = "coalesce(list_filter(list_transform(jsonld, lambda x: {e}), lambda v: v IS NOT NULL)[-1], '')"
ADDR = "CASE WHEN json_type(x, '$.address') = 'OBJECT' THEN CAST(json_extract(x, '$.address') AS VARCHAR) ELSE json_extract_string(x, '$.address') END"


@query("nap_page", f"""{W} SELECT page_id, site, phone, address, title, text_phone, text_address,
  {LAST.format(e="json_extract_string(x, '$.name')")} AS schema_name, {LAST.format(e=ADDR)} AS schema_address,
  {LAST.format(e="json_extract_string(x, '$.telephone')")} AS schema_phone FROM sig""")
def nap_page(spark, d):
    return P.nap(signals(spark, d))


@query("page_warnings", f"{W} SELECT page_id, site, warning FROM (SELECT page_id, site, unnest({K.WARNINGS}) AS warning FROM sig)")
def page_warnings(spark, d):
    return P.page_warnings(signals(spark, d)).drop("pos")


@query("blocked_pages", f"""{W} SELECT page_id, length(html) < 200 OR {K.any_of('low', fv.BLOCK_PHRASES)} AS blocked,
  length(html) < 500 OR {K.any_of('low', fv.BLOCK_PHRASES_STRICT)} AS blocked_strict FROM sig""")
def blocked_pages(spark, d):
    return signals(spark, d).select("page_id", "blocked", "blocked_strict")


TECHNICAL = f"({K.any_of('lower(url)', fv.TECHNICAL_PATTERNS)} OR ends_with(lower(url), '.txt'))"
LENIENT = "NOT (contains(lower(url), '.xml') OR contains(lower(url), '.txt') OR contains(lower(url), '.rss') OR contains(lower(url), '.atom') OR contains(lower(url), 'sitemap'))"
CONTENT = f"SELECT page_id, url FROM pgs WHERE NOT {TECHNICAL} OR ({LENIENT} AND site NOT IN (SELECT site FROM pgs WHERE NOT {TECHNICAL}))"


@query("content_pages", f"{W}, pgs AS (SELECT page_id, site, url FROM sig) {CONTENT}")
def content_pages(spark, d):
    return P.content_pages(signals(spark, d)).select("page_id", "url")


# All pages of some sites are feeds, and one in three of these ends in .xml.
FEEDS = "CASE WHEN length(site) % 2 = 0 THEN concat(url, '/feed', CASE WHEN page_id % 3 = 0 THEN '.xml' ELSE '' END) ELSE url END"


@query("content_pages_of_feeds", f"{W}, pgs AS (SELECT page_id, site, {FEEDS} AS url FROM sig) {CONTENT}")
def content_pages_of_feeds(spark, d):
    return P.content_pages(signals(spark, d).select("page_id", "site", F.expr(FEEDS).alias("url"))).select("page_id", "url")


@query("empty_page_default", f"""{W}, want AS (SELECT url FROM pages UNION SELECT concat(url, '/gone') FROM pages)
  SELECT want.url AS url, page_id, coalesce(title, '') AS title, coalesce(word_count, 0) AS word_count, coalesce(len(images), 0) AS n_images FROM want LEFT JOIN sig ON want.url = sig.url""")
def empty_page_default(spark, d):
    from pagelens.operators.page_signals import with_page_defaults

    pages = table(spark, d, "pages")
    want = pages.select("url").union(pages.select(F.concat("url", F.lit("/gone"))))
    return with_page_defaults(want, signals(spark, d)).select(
        "url", "page_id", "title", "word_count", F.size("images").alias("n_images"))


# --- questions, products, topics --------------------------------------------------------------------
@query("faq_pairs", f"{W} SELECT page_id, site, r.question AS question, r.answer AS answer FROM (SELECT page_id, site, unnest({K.FAQ_ENTITIES}) AS r FROM sig)")
def faq_pairs(spark, d):
    return P.faq_schema_pairs(signals(spark, d))


def _marked(t: str, qm: str, am: str) -> str:
    pieces = f"string_split({K.sub(t, f'(?i){qm}', chr(1))}, {K.q(chr(1))})[2:]"
    rows = (f"list_transform({pieces}, lambda p: {{'question': trim({K.ext('p', rf'(?is)^(.*?){am}')}), "
            f"'answer': trim({K.ext('p', rf'(?is)^.*?{am}(.*)$')})}})")
    return f"list_filter({rows}, lambda r: r.question <> '' AND r.answer <> '')"


SENTENCE = (f"CASE WHEN {K.has('text', r'(?s)^.[^?]*\?\s*\S')} THEN [{{'question': trim({K.ext('text', r'(?s)^(.[^?]*)\?')}), "
            f"'answer': {K.squeeze(K.ext('text', r'(?s)^.[^?]*\?(.*)$'))}}}] ELSE [] END")
TEXT_PAIRS = f"list_concat(list_concat({_marked('text', 'Q:', 'A:')}, {_marked('text', 'Question:', 'Answer:')}), {SENTENCE})"


@query("faq_text_pairs", f"{W} SELECT page_id, site, r.question AS question, r.answer AS answer FROM (SELECT page_id, site, unnest({TEXT_PAIRS}) AS r FROM sig)")
def faq_text_pairs(spark, d):
    return P.faq_text_pairs(signals(spark, d))


ASKS = lambda s: f"({K.has(f'lower({s})', P.QUESTION_LINE)} OR {K.has(s, P.QUESTION_PREFIX)})"


@query("faq_headings", f"""{W}, hd AS (SELECT page_id, site, unnest(list_concat(h2, h3)) AS s, generate_subscripts(list_concat(h2, h3), 1) AS i FROM sig),
  ln0 AS (SELECT page_id, site, list_filter(list_transform(string_split(block_text, chr(10)), lambda x: {K.squeeze('x')}), lambda x: x <> '') AS l FROM sig),
  ln AS (SELECT page_id, site, unnest(l) AS s, generate_subscripts(l, 1) AS i, l FROM ln0),
  cand AS (SELECT page_id, site, 0 AS src, i, s AS question, '' AS answer FROM hd WHERE {ASKS('s')}
    UNION ALL SELECT page_id, site, 1, i, trim({K.sub('s', P.QUESTION_PREFIX)}), trim({K.sub("coalesce(l[i + 1], '')", P.ANSWER_PREFIX)}) FROM ln WHERE {ASKS('s')}),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY page_id, lower(question) ORDER BY src, i) AS rn FROM cand WHERE question <> ''),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY src, i) - 1 AS pos FROM firsts WHERE rn = 1)
  SELECT page_id, site, CAST(pos AS BIGINT) AS pos, question, answer FROM ranked WHERE pos < {fv.MAX_FAQ_PER_PAGE}""")
def faq_headings(spark, d):
    return P.faq_headings(signals(spark, d))


# Elements by a recursive query over the tags of each page: a stack of open elements, and those closed so far.
NESTED = """CASE page_id % 6 WHEN 0 THEN '<div><section><div><h3>What is nested?</h3><p>Inner <b>answer</b></p></div><div>FAQ<h4>How deep is it?</h4><ul><li>Three</li><li>levels</li></ul></div></section></div>'
  WHEN 1 THEN '<article>Questions<h2>Why so?</h2>text between<p>Because <i>it is</i></p><h2>When &amp; where</h2></article><p>no sibling</p>' WHEN 2 THEN '<div>faq<h3>Who?</h3><img src="x.png"><p>after a picture</p></div></div></section>'
  WHEN 3 THEN '<section>Frequently asked<h3>What now</h3><div><div>long ' || repeat('word ', 60) || '</div></div><h3>How open?<p>never closed' WHEN 4 THEN '<div>answers <h5>Is it plain?</h5><p title="a > b">yes</p><h6>Where</h6><p> </p></div>' ELSE '' END"""


def faq_sections_sql(mk: str) -> str:
    tag, word = r"""<(?:[^>"']|"[^"]*"|'[^']*')*>""", lambda s: K.any_of(s, fv.FAQ_WORDS)
    text = lambda i, j: (f"{K.decode(f'array_to_string(list_filter(x[{i} + 1:{j} - 1], lambda y: y[1] <> {K.q(chr(60))} OR y = {K.q(chr(60))}), {K.q(str())})')}")
    edges = lambda s: f"regexp_replace(regexp_replace({s}, '^\\s+', ''), '\\s+$', '')"
    return f"""fx AS (SELECT page_id, site, regexp_extract_all({mk}, {K.q(tag + '|[^<]+|<')}) AS x FROM sig),
  ft AS (SELECT page_id, list_transform(list_filter(list_transform(range(1, len(x) + 1), lambda i: {{'i': i, 't': x[i]}}), lambda e: regexp_matches(e.t, '^</?[a-zA-Z]')),
    lambda e: {{'i': e.i, 'name': lower(regexp_extract(e.t, '^</?([a-zA-Z][^\\s/>]*)', 1)), 'ends': starts_with(e.t, '</'), 'closed': ends_with(e.t, '/>')}}) AS g FROM fx),
  fr AS (SELECT page_id, 0 AS k, CAST([] AS STRUCT(name VARCHAR, i BIGINT, after BIGINT)[]) AS stack, CAST([] AS STRUCT(name VARCHAR, i BIGINT, j BIGINT, after BIGINT)[]) AS done, CAST(NULL AS BIGINT) AS after FROM ft
    UNION ALL SELECT page_id, k + 1,
      CASE WHEN e.ends THEN CASE WHEN p > 0 THEN stack[:p - 1] ELSE stack END
        WHEN e.closed OR e.name IN {K.in_list("area base br col embed hr img input link meta param source track wbr".split())} THEN stack
        ELSE list_append(stack, {{'name': e.name, 'i': e.i, 'after': after}}) END,
      CASE WHEN e.ends AND p > 0 THEN list_concat(done, list_transform(stack[p:], lambda y: {{'name': y.name, 'i': y.i, 'j': e.i, 'after': y.after}})) ELSE done END,
      CASE WHEN e.ends AND p > 0 AND e.name IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') THEN stack[p].i END
    FROM (SELECT fr.*, g[k + 1] AS e, CASE WHEN list_contains(list_transform(stack, lambda y: y.name), g[k + 1].name)
        THEN len(stack) + 1 - list_position(list_reverse(list_transform(stack, lambda y: y.name)), g[k + 1].name) ELSE 0 END AS p
      FROM fr JOIN ft USING (page_id) WHERE k < len(g))),
  fe AS (SELECT page_id, unnest(list_concat(done, list_transform(stack, lambda y: {{'name': y.name, 'i': y.i, 'j': len(x) + 1, 'after': y.after}}))) AS e
    FROM fr JOIN ft USING (page_id) JOIN fx USING (page_id) WHERE k = len(g)),
  fs AS (SELECT page_id, e.i AS i, e.j AS j FROM fe JOIN fx USING (page_id) WHERE e.name IN ('div', 'section', 'article') AND {word(f"lower({text('e.i', 'e.j')})")}),
  fh AS (SELECT h.page_id, site, h.e.i AS i, h.e.j AS j, {edges(text('h.e.i', 'h.e.j'))} AS question, {edges(text('a.e.i', 'a.e.j'))} AS ans
    FROM fe h JOIN fe a ON a.page_id = h.page_id AND a.e.after = h.e.i JOIN fx ON fx.page_id = h.page_id WHERE h.e.name IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6')),
  faqsec AS (SELECT page_id, site, question, CASE WHEN length(ans) > 200 THEN concat(substr(ans, 1, 200), '...') ELSE ans END AS answer
    FROM fh JOIN fs USING (page_id) WHERE fh.i > fs.i AND fh.j <= fs.j AND ans <> '' AND (ends_with(question, '?') OR {K.any_of('lower(question)', fv.SECTION_QUESTION_WORDS)}))"""


FAQ_SECTIONS = faq_sections_sql("mk")
RECURSIVE = W.replace("WITH ", "WITH RECURSIVE ", 1)


@query("faq_sections", f"{RECURSIVE}, {FAQ_SECTIONS} SELECT page_id, site, question, answer FROM faqsec")
def faq_sections(spark, d):
    return P.faq_sections(signals(spark, d))


@query("faq_sections_nested", f"{RECURSIVE}, {faq_sections_sql(f'concat(mk, {NESTED})')} SELECT page_id, site, question, answer FROM faqsec")
def faq_sections_nested(spark, d):
    return P.faq_sections(signals(spark, d).withColumn("markup", F.concat("markup", F.expr(NESTED))))


@query("faq_questions", f"""{W} SELECT page_id, site, unnest(list_concat(list_transform({K.FAQ_ENTITIES}, lambda e: e.question),
  regexp_extract_all(text, {K.q(P.SENTENCE_QUESTION)})[1:5])) AS question FROM sig""")
def faq_questions(spark, d):
    return P.faq_questions(signals(spark, d))


@query("faq_topics", f"""{W} SELECT page_id, site, unnest(list_concat(list_filter(list_transform(list_filter(headings, lambda h: h.level <= 4 AND contains(h.text, '?')),
  lambda h: trim(replace(h.text, '?', ''))), lambda t: length(t) > 5 AND length(t) < 100), list_filter(list_transform({K.FAQ_ENTITIES}, lambda e: e.question), lambda x: x <> ''))) AS topic FROM sig""")
def faq_topics(spark, d):
    return P.faq_topics(signals(spark, d))


def _qh(lang: str) -> str:
    return (f"list_filter(headings, lambda h: {K.any_of('lower(h.text)', fv.QUESTION_WORDS_BY_LANG[lang])} OR ends_with(h.text, '?'))")


@query("question_headings", f"{W} SELECT page_id, site, r.level AS level, r.text AS text FROM (SELECT page_id, site, unnest({_qh('en')}) AS r FROM sig)")
def question_headings(spark, d):
    return P.question_headings(signals(spark, d))


@query("question_headings_de", f"{W} SELECT page_id, site, r.level AS level, r.text AS text FROM (SELECT page_id, site, unnest({_qh('de')}) AS r FROM sig)")
def question_headings_de(spark, d):
    return P.question_headings(signals(spark, d), "de")


PNAMES = "list_transform(" + K.blocks("jsonld", "Product") + ", lambda x: coalesce(json_extract_string(x, '$.name'), ''))"
HTEXTS = "list_transform(list_filter(headings, lambda h: h.level <= 3), lambda h: h.text)"
PRODUCTS = f"list_distinct(list_filter(list_concat({PNAMES}, list_filter({HTEXTS}, lambda t: length(t) < 50)), lambda p: length(p) >= 3))"


@query("products", f"{W} SELECT page_id, site, unnest({PRODUCTS}) AS product FROM sig")
def products(spark, d):
    return P.products(signals(spark, d))


@query("products_worded", f"{W} SELECT page_id, site, unnest(list_distinct(list_concat({PNAMES}, list_filter({HTEXTS}, "
       f"lambda t: {K.any_of('lower(t)', fv.PRODUCT_HEADING_WORDS)})))) AS product FROM sig")
def products_worded(spark, d):
    return P.products(signals(spark, d), "worded")


@query("products_long", f"{W} SELECT page_id, site, unnest(list_distinct(list_filter(list_concat({PNAMES}, list_filter({HTEXTS}, lambda t: length(t) < 100)), lambda p: length(p) >= 1))) AS product FROM sig")
def products_long(spark, d):
    return P.products(signals(spark, d), "long")


def _topic_words(s: str) -> str:
    return f"list_filter({K.ext_all(f'lower({s})', r'[\p{L}\p{N}_]+')}, lambda t: {K.has('t', '^[a-z]{4,}$')})"


TOPICS = f"""tw AS (SELECT page_id, site, unnest(list_concat(list_filter({_topic_words('text')}, lambda t: t NOT IN {K.in_list(fv.TOPIC_STOP_WORDS)}), {_topic_words('title')})) AS topic FROM sig),
  tn AS (SELECT page_id, site, topic, count(*) AS n FROM tw GROUP BY ALL),
  topics AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, topic) AS rank FROM tn QUALIFY rank <= 10)"""


@query("topics_per_page", f"{W}, {TOPICS} SELECT page_id, site, topic, n, rank FROM topics")
def topics_per_page(spark, d):
    return P.page_topics(signals(spark, d))


@query("heading_topics", f"{W} SELECT page_id, site, unnest(list_distinct(list_filter(list_transform({HTEXTS}, lambda t: lower(t)), lambda t: length(t) < 50)[1:10])) AS topic FROM sig")
def heading_topics(spark, d):
    return P.heading_topics(signals(spark, d))


def _phrases(t: str) -> str:
    out = "[]"
    for k in fv.COMPARISON_KEYWORDS:
        out = f"list_concat({out}, {K.ext_all(f'lower({t})', rf'{P.WORD}+\s+{k}\s+{P.WORD}+')})"
    return f"list_distinct({out})"


@query("competitor_phrases", f"WITH dv AS (SELECT doc_id, source, concat(text, CASE WHEN doc_id % 5 = 0 THEN ' Blue Lamp vs Red Desk, similar to chairs such as stools' ELSE '' END) AS text FROM documents) "
       f"SELECT doc_id AS page_id, source AS site, unnest({_phrases('text')}) AS competitor FROM dv")
def competitor_phrases(spark, d):
    docs = table(spark, d, "documents").select(
        c("doc_id").alias("page_id"), c("source").alias("site"), F.concat("text", F.expr(
            "CASE WHEN doc_id % 5 = 0 THEN ' Blue Lamp vs Red Desk, similar to chairs such as stools' ELSE '' END")).alias("text"))
    return P.competitor_phrases(docs)


def _after(t: str) -> str:
    out = "[]"
    for k in fv.COMPARISON_MARKERS:
        out = f"list_concat({out}, {K.ext_all(f'lower({t})', k.replace(' ', chr(92) + 's+') + rf'{chr(92)}s+({P.WORD}+)', 1)})"
    return f"list_distinct({out})"


COMPARED = "CASE WHEN doc_id % 4 = 0 THEN ' Blue Lamp vs Red Desk, better than chairs, compared to Stools' ELSE '' END"


@query("competitors_after_marker", f"WITH dv AS (SELECT doc_id, source, concat(text, {COMPARED}) AS text FROM documents) SELECT doc_id AS page_id, source AS site, unnest({_after('text')}) AS competitor FROM dv")
def competitors_after_marker(spark, d):
    return P.competitor_phrases(_compared(spark, d), "after")


def _compared(spark, d):
    return table(spark, d, "documents").select(
        c("doc_id").alias("page_id"), c("source").alias("site"), F.concat("text", F.expr(COMPARED)).alias("text"))


NEXT = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"


@query("competitors_next_word", f"""WITH dv AS (SELECT doc_id, source, concat(text, {COMPARED}) AS text FROM documents), w AS (SELECT doc_id, source, unnest({NEXT}) AS w, generate_subscripts({NEXT}, 1) AS i FROM dv),
  n AS (SELECT doc_id, source, i, w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM w),
  h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM n WHERE lower(w) IN {K.in_list(fv.COMPARISON_WORDS)} AND nx IS NOT NULL)
  SELECT doc_id AS page_id, source AS site, nx AS competitor FROM h WHERE rn <= 3""")
def competitors_next_word(spark, d):
    return P.competitor_phrases(_compared(spark, d), "next")


@query("text_heading_lines", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))[1:20]) AS s, generate_subscripts(string_split(text, chr(10))[1:20], 1) AS i FROM
    (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('# Heading ', doc_id, chr(10), 'OUR NEW PRODUCTS', chr(10), text) ELSE text END AS text FROM documents)),
  n AS (SELECT doc_id, trim(s) AS heading, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rank FROM l WHERE starts_with(trim(s), '#') OR (length(trim(s)) > 10 AND trim(s) = upper(trim(s)) AND trim(s) <> lower(trim(s))))
  SELECT doc_id, heading, rank FROM n WHERE rank <= 10""")
def text_heading_lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.expr(
        "CASE WHEN doc_id % 3 = 0 THEN concat('# Heading ', doc_id, chr(10), 'OUR NEW PRODUCTS', chr(10), text) ELSE text END").alias("text"),
        c("doc_id").alias("o"))
    return P.text_headings(docs, "doc_id", order="o").select("doc_id", "heading", "rank")


@query("product_lines", f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN concat('Mūsų produktas ', doc_id, chr(10), 'Nauja prekė', chr(10), text) ELSE text END AS text FROM documents),
  l AS (SELECT doc_id, unnest(string_split(text, chr(10))[1:10]) AS s, generate_subscripts(string_split(text, chr(10))[1:10], 1) AS i FROM x WHERE {K.any_of('lower(text)', fv.PRODUCT_LINE_GATE)}),
  n AS (SELECT doc_id, trim(s) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rank FROM l WHERE {K.any_of('lower(trim(s))', fv.PRODUCT_LINE_WORDS)})
  SELECT doc_id, line, rank FROM n WHERE rank <= 5""")
def product_lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.expr(
        "CASE WHEN doc_id % 4 = 0 THEN concat('Mūsų produktas ', doc_id, chr(10), 'Nauja prekė', chr(10), text) ELSE text END").alias("text"),
        c("doc_id").alias("o"))
    return P.product_lines(docs, "doc_id", order="o").select("doc_id", "line", "rank")


# --- tokens and grams -------------------------------------------------------------------------------
TOK = f"tok AS (SELECT lang, doc_id, unnest({K.tokens('text')}) AS token, generate_subscripts({K.tokens('text')}, 1) AS i FROM documents)"


@query("token_counts", f"WITH {TOK} SELECT lang, token, count(*) AS n FROM tok WHERE token NOT IN {K.in_list(STOP)} GROUP BY ALL")
def token_counts(spark, d):
    return GR.token_counts(table(spark, d, "documents"), "lang", stop_words=STOP)


LEADS = ("gr AS (SELECT lang, token, lead(token, 1) OVER w AS t2, lead(token, 2) OVER w AS t3 FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY i))")


@query("bigram_top", f"WITH {TOK}, {LEADS} SELECT lang, concat(token, ' ', t2) AS gram, count(*) AS n FROM gr WHERE t2 IS NOT NULL GROUP BY ALL HAVING count(*) > 4")
def bigram_top(spark, d):
    return GR.gram_counts(table(spark, d, "documents"), "lang", 2, min_count=5)


@query("trigram_top", f"WITH {TOK}, {LEADS} SELECT lang, concat(token, ' ', t2, ' ', t3) AS gram, count(*) AS n FROM gr WHERE t3 IS NOT NULL GROUP BY ALL HAVING count(*) > 4")
def trigram_top(spark, d):
    return GR.gram_counts(table(spark, d, "documents"), "lang", 3, min_count=5)


def _stem_ctes(src: str) -> str:
    """Porter steps as nested selects over ``src(token, ...)``."""
    def cut(n):
        return f"substr(w, 1, length(w) - {n})"

    def table_step(prev, name, table, pattern):
        case = " ".join(f"WHEN {K.q(k)} THEN {K.q(v)}" for k, v in table.items())
        return (f"{name} AS (SELECT * REPLACE (CASE WHEN {K.ext('w', pattern, 2)} <> '' AND {K.has(K.ext('w', pattern), T.M_GT_0)} "
                f"THEN concat({K.ext('w', pattern)}, CASE {K.ext('w', pattern, 2)} {case} END) ELSE w END AS w) FROM {prev})")

    s = K.ext("w", "^(.*)(?:ed|ing)$")
    fix = (f"CASE WHEN {s} IN ('at', 'bl', 'iz') THEN concat({s}, 'e') WHEN length({s}) = 2 AND substr({s}, 1, 1) = substr({s}, 2, 1) AND "
           f"{K.has(s, '^[^aeiouylsz]')} THEN substr({s}, 1, 1) WHEN {K.has(s, T.CVC)} THEN concat({s}, 'e') ELSE {s} END")
    e2, e3 = T._ending(T.STEM_STEP2), T._ending(T.STEM_STEP3)
    e4, e4b = T._ending(T.STEM_STEP4), "^(.+?[st])ion$"
    s4 = f"(CASE WHEN {K.has('w', e4)} THEN {K.ext('w', e4)} ELSE {K.ext('w', e4b)} END)"
    s5 = K.ext("w", "^(.+?)e$")
    return ", ".join([
        f"z0 AS (SELECT *, CASE WHEN starts_with(token, 'y') THEN concat('Y', substr(token, 2)) ELSE token END AS w FROM {src})",
        f"z1 AS (SELECT * REPLACE (CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut(2)} WHEN {K.has('w', '[^s]s$')} THEN {cut(1)} ELSE w END AS w) FROM z0)",
        f"z2 AS (SELECT * REPLACE (CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {K.has(cut(3), T.M_GT_0)} THEN {cut(1)} ELSE w END WHEN {K.has('w', '(?:ed|ing)$')} AND {K.has(s, T.HAS_VOWEL)} THEN {fix} ELSE w END AS w) FROM z1)",
        f"z3 AS (SELECT * REPLACE (CASE WHEN ends_with(w, 'y') AND {K.has(cut(1), T.HAS_VOWEL)} THEN concat({cut(1)}, 'i') ELSE w END AS w) FROM z2)",
        table_step("z3", "z4", T.STEM_STEP2, e2), table_step("z4", "z5", T.STEM_STEP3, e3),
        f"z6 AS (SELECT * REPLACE (CASE WHEN {s4} <> '' AND {K.has(s4, T.M_GT_1)} THEN {s4} ELSE w END AS w) FROM z5)",
        f"z7 AS (SELECT * REPLACE (CASE WHEN {s5} <> '' AND ({K.has(s5, T.M_GT_1)} OR ({K.has(s5, T.M_EQ_1)} AND NOT {K.has(s5, T.CVC)})) THEN {s5} ELSE w END AS w) FROM z6)",
        f"z8 AS (SELECT * REPLACE (CASE WHEN ends_with(w, 'll') AND {K.has('w', T.M_GT_1)} THEN {cut(1)} ELSE w END AS w) FROM z7)",
        "stems AS (SELECT * EXCLUDE (w), CASE WHEN length(token) < 3 THEN token WHEN starts_with(token, 'y') THEN concat('y', substr(w, 2)) ELSE w END AS stem FROM z8)",
    ])


@query("stem_counts", f"""WITH {TOK}, cnt AS (SELECT lang, token, count(*) AS n, min({{'d': doc_id, 'i': i}}) AS first_at FROM tok WHERE token NOT IN {K.in_list(STOP)} GROUP BY ALL),
  {_stem_ctes('cnt')} SELECT lang, stem, arg_min(token, first_at) AS word, CAST(sum(n) AS BIGINT) AS n FROM stems GROUP BY ALL""")
def stem_counts(spark, d):
    return GR.stem_counts(table(spark, d, "documents"), "lang", "doc_id", stop_words=STOP)


# Stop words as a table: the tokens of at least a twentieth of the documents.
STOPS = "st AS (SELECT token AS word, count(DISTINCT doc_id) AS members FROM tok GROUP BY token HAVING count(DISTINCT doc_id) >= CAST(0.05 AS DOUBLE) * (SELECT count(DISTINCT doc_id) FROM documents))"


@query("frequent_words", f"WITH {TOK}, {STOPS} SELECT * FROM st")
def frequent_words(spark, d):
    return GR.frequent_words(table(spark, d, "documents"), "doc_id", 0.05)


@query("stem_counts_stop_table", f"""WITH {TOK}, {STOPS}, cnt AS (SELECT lang, token, count(*) AS n, min({{'d': doc_id, 'i': i}}) AS first_at FROM tok WHERE token NOT IN (SELECT word FROM st) GROUP BY ALL),
  {_stem_ctes('cnt')} SELECT lang, stem, arg_min(token, first_at) AS word, CAST(sum(n) AS BIGINT) AS n FROM stems GROUP BY ALL""")
def stem_counts_stop_table(spark, d):
    docs = table(spark, d, "documents")
    return GR.stem_counts(docs, "lang", "doc_id", stop_words=GR.frequent_words(docs, "doc_id", 0.05))


PTOK = f"ptok AS (SELECT host AS site, page_id, unnest({K.tokens('text')}) AS token, generate_subscripts({K.tokens('text')}, 1) AS i FROM sig)"


@query("page_keywords", f"""{W}, {PTOK}, cnt AS (SELECT page_id, token, count(*) AS n, min(i) AS first_at FROM ptok WHERE token NOT IN {K.in_list(STOP)} GROUP BY ALL),
  {_stem_ctes('cnt')} SELECT page_id, stem, arg_min(token, first_at) AS word, CAST(sum(n) AS BIGINT) AS n FROM stems GROUP BY ALL HAVING sum(n) >= 5""")
def page_keywords(spark, d):
    return GR.page_keywords(signals(spark, d), STOP)


@query("site_keywords", f"""{W}, {PTOK}, pgr AS (SELECT site, token, lead(token, 1) OVER w AS t2, lead(token, 2) OVER w AS t3 FROM ptok WINDOW w AS (PARTITION BY page_id ORDER BY i)),
  cnt AS (SELECT site, token, count(*) AS n FROM ptok WHERE token NOT IN {K.in_list(STOP)} GROUP BY ALL), {_stem_ctes('cnt')}
  SELECT site, 'stem' AS kind, stem AS gram, CAST(sum(n) AS BIGINT) AS n FROM stems GROUP BY ALL HAVING sum(n) > 4
  UNION ALL SELECT site, 'bigram', concat(token, ' ', t2), count(*) FROM pgr WHERE t2 IS NOT NULL GROUP BY ALL HAVING count(*) > 4
  UNION ALL SELECT site, 'trigram', concat(token, ' ', t2, ' ', t3), count(*) FROM pgr WHERE t3 IS NOT NULL GROUP BY ALL HAVING count(*) > 4""")
def site_keywords(spark, d):
    s = signals(spark, d).select(c("host").alias("site"), "page_id", "text")
    return GR.site_keywords(s, "site", "page_id", stop_words=STOP)


@query("site_keywords_stop_table", f"""{W}, {TOK}, {STOPS}, {PTOK}, pgr AS (SELECT site, token, lead(token, 1) OVER w AS t2, lead(token, 2) OVER w AS t3 FROM ptok WINDOW w AS (PARTITION BY page_id ORDER BY i)),
  cnt AS (SELECT site, token, count(*) AS n FROM ptok WHERE token NOT IN (SELECT word FROM st) GROUP BY ALL), {_stem_ctes('cnt')}
  SELECT site, 'stem' AS kind, stem AS gram, CAST(sum(n) AS BIGINT) AS n FROM stems GROUP BY ALL HAVING sum(n) > 4
  UNION ALL SELECT site, 'bigram', concat(token, ' ', t2), count(*) FROM pgr WHERE t2 IS NOT NULL GROUP BY ALL HAVING count(*) > 4
  UNION ALL SELECT site, 'trigram', concat(token, ' ', t2, ' ', t3), count(*) FROM pgr WHERE t3 IS NOT NULL GROUP BY ALL HAVING count(*) > 4""")
def site_keywords_stop_table(spark, d):
    s = signals(spark, d).select(c("host").alias("site"), "page_id", "text")
    return GR.site_keywords(s, "site", "page_id", stop_words=GR.frequent_words(table(spark, d, "documents"), "doc_id", 0.05))


@query("duplicate_documents", """WITH h AS (SELECT doc_id, sha1(text) AS content_hash FROM documents)
  SELECT content_hash, doc_id, count(*) OVER (PARTITION BY content_hash) AS copies, min(doc_id) OVER (PARTITION BY content_hash) AS first_member FROM h
  QUALIFY count(*) OVER (PARTITION BY content_hash) > 1""")
def duplicate_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha1("text").alias("content_hash"))
    return GR.duplicate_pages(docs, "content_hash", "doc_id")


@query("lang_markers", f"""WITH m AS (SELECT doc_id, {K.count_of('lower(text)', fv.LT_MARKERS)} AS lt, {K.count_of('lower(text)', fv.EN_MARKERS)} AS en FROM documents)
  SELECT doc_id, CASE WHEN lt > en THEN 'lt' WHEN en > lt THEN 'en' ELSE 'unknown' END AS language FROM m""")
def lang_markers(spark, d):
    return table(spark, d, "documents").select("doc_id", T.marker_language("text").alias("language"))


@query("document_language", f"SELECT doc_id, {K.in_languages(K.tokens('text'))} AS language FROM documents")
def document_language(spark, d):
    pre = table(spark, d, "documents").select("doc_id", T.tokens("text").alias("t"))
    return pre.select("doc_id", T.guess_language("t").alias("language"))


@query("faq_analysis", f"""{W} SELECT page_id, site, {K.any_of('lower(text)', fv.FAQ_WORDS_WIDE)} AS has_faq_content, CAST(len({TEXT_PAIRS}) AS BIGINT) AS n_pairs,
  contains(array_to_string(jsonld, ' '), 'FAQPage') OR contains(array_to_string(jsonld, ' '), 'Question') AS has_faq_schema FROM sig""")
def faq_analysis(spark, d):
    return R.faq_analysis(signals(spark, d))


@query("page_languages", f"{W} SELECT page_id, site, {K.in_languages(K.tokens("concat_ws(' ', title, coalesce(meta, ''), '')"))} AS language FROM sig")
def page_languages(spark, d):
    return A.page_languages(signals(spark, d))
