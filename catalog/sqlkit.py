"""DuckDB text helpers and the shared common table expressions of the oracle queries."""

from __future__ import annotations

from pagelens.functions import fixed_values as fv
from pagelens.functions import html as H
from pagelens.functions import urls as U
from pagelens.operators import page_rows as P
from pagelens.operators import page_signals as S

from .inputs import AUGMENT


# RE2 has no possessive repeats and needs none.
INSIDE = r"""[^>=]*(?:=\s*(?:"[^"]*"|'[^']*')?[^>=]*)*"""
ANCHOR_REST = rf"(?is)^{INSIDE}>(.*?)(?:</a|\z)"
# Entities that the pages hold, and what is to come of them.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "),
    ("&#160;", " "), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&eacute;", "\u00e9"), ("&#8217;", "\u2019"), ("&#x2014;", "\u2014"),
    ("&#38;", "&"), ("&amp;", "&"),
]
PARAGRAPH_REST = r"(?is)^(.*?)(?:</p|\z)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rq(pattern: str) -> str:
    """A pattern for RE2, quoted."""
    return q(pattern.replace(H.INSIDE, INSIDE))


def sub(s: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({s}, {rq(pattern)}, {q(by)}, 'g')"


def ext(s: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({s}, {rq(pattern)}, {group})"


def ext_all(s: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({s}, {rq(pattern)}, {group})"


def has(s: str, pattern: str) -> str:
    return f"regexp_matches({s}, {rq(pattern)})"


def any_of(s: str, words) -> str:
    return "(" + " OR ".join(f"contains({s}, {q(w)})" for w in words) + ")"


def count_of(s: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({s}, {q(w)}) AS BIGINT)" for w in words) + ")"


def lits(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def decode(s: str) -> str:
    for name, char in ENTITIES:
        s = f"replace({s}, {q(name)}, {q(char)})"
    return s


def squeeze(s: str) -> str:
    return f"trim({sub(s, r'\s+', ' ')})"


def strip(s: str, by: str = "") -> str:
    return squeeze(decode(sub(s, H.ANY_TAG, by)))


def attr(t: str, name: str) -> str:
    raw = f"nullif({ext(t, H.ATTRIBUTE.replace('{name}', name))}, '')"
    value = sub(raw, r"^[\"']|[\"']$")
    return decode(value) if name in H.TEXT_ATTRIBUTES else value


def host(u: str) -> str:
    return f"lower({ext(u, U.HOST)})"


def netloc(u: str) -> str:
    return f"lower({ext(u, U.NETLOC)})"


def site(h: str) -> str:
    """Registrable domain by list slicing (the Spark side uses a regex)."""
    labels = f"string_split({h}, '.')"
    two = f"array_to_string({labels}[-2:], '.')"
    three = f"array_to_string({labels}[-3:], '.')"
    return f"CASE WHEN {two} IN {in_list(fv.TWO_LABEL_SUFFIXES)} THEN {three} ELSE {two} END"


def dots(p: str) -> str:
    fold = (f"list_reduce(list_transform(string_split({p}, '/'), lambda z: [z]), lambda acc, x: CASE WHEN x[1] = '..' THEN "
            f"acc[1:greatest(len(acc) - 1, 1)] WHEN x[1] = '.' THEN acc ELSE list_concat(acc, x) END, CAST([] AS VARCHAR[]))")
    last = f"string_split({p}, '/')[-1]"
    return f"array_to_string(CASE WHEN {last} IN ('.', '..') THEN list_concat({fold}, ['']) ELSE {fold} END, '/')"


def resolve(base: str, href: str) -> str:
    h = f"trim({href})"
    root = ext(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)")
    d = f"coalesce(nullif({ext(ext(base, U.PATH), r'(?s)^(.*/)')}, ''), '/')"
    full = f"(CASE WHEN starts_with({h}, '/') THEN {h} ELSE concat({d}, {h}) END)"
    only, tail = sub(full, r"(?s)[?#].*$"), ext(full, r"(?s)^[^?#]*(.*)$")
    nofrag = sub(f"trim({base})", r"(?s)#.*$")
    return (f"CASE WHEN {has(h, U.SCHEME)} THEN {h} WHEN {h} = '' THEN {nofrag} "
            f"WHEN starts_with({h}, '//') THEN concat({ext(base, U.SCHEME)}, ':', {h}) "
            f"WHEN starts_with({h}, '?') THEN concat({sub(base, r'(?s)[?#].*$')}, {h}) "
            f"WHEN starts_with({h}, '#') THEN concat({nofrag}, {h}) "
            f"WHEN {has(only, U.HAS_DOTS)} THEN concat({root}, {dots(only)}, {tail}) "
            f"ELSE concat({root}, {full}) END")


def named(tags: str, name: str) -> str:
    return f"list_filter({tags}, lambda x: {has('x', rf'(?i)^<{name}[\s/>]')})"


def jtype(b: str) -> str:
    return f"json_extract_string({b}, '$.\"@type\"')"


def blocks(b: str, name: str) -> str:
    return f"list_filter({b}, lambda x: {jtype('x')} = '{name}')"


def word_count(t: str) -> str:
    return f"CAST(len(list_filter(string_split_regex({t}, '\\s+'), lambda x: x <> '')) AS BIGINT)"


def names(t: str) -> str:
    spaced = sub(t, r"[^\p{L}\p{N}_\s]", " | ")
    marked = (f"list_transform(string_split_regex({spaced}, '\\s+'), "
              f"lambda w: CASE WHEN {has('w', '^[A-Z][a-z]+$')} THEN w ELSE '|' END)")
    return (f"list_filter(list_transform(string_split(array_to_string({marked}, ' '), '|'), lambda w: trim(w)), "
            f"lambda w: w <> '')")


def occurrences(s: str, part: str) -> str:
    return (f"CAST(CASE WHEN {part} = '' THEN 0 ELSE (length({s}) - length(replace({s}, {part}, ''))) / "
            f"length({part}) END AS BIGINT)")


def in_languages(t: str) -> str:
    """Most frequent-word hits over the languages, ties by code."""
    rows = ", ".join(
        f"{{'n': len(list_filter({t}, lambda w: w IN {in_list(ws)})), 'code': '{code}'}}"
        for code, ws in sorted(fv.LANGUAGE_WORDS.items()))
    return (f"list_reduce([{rows}], lambda a, b: CASE WHEN b.n > a.n THEN b ELSE a END, "
            f"{{'n': CAST(0 AS BIGINT), 'code': ''}}).code")


def tokens(t: str) -> str:
    return ext_all(f"lower({t})", r"[\p{L}\p{N}_]{2,}")


def platform_cols() -> str:
    return ", ".join(f"{count_of('low', marks)} AS pf_{name}" for name, marks in fv.PLATFORM_MARKERS.items())


FAQ_ENTITIES = (
    "flatten(list_transform(" + blocks("jsonld", "FAQPage") + ", lambda x: list_transform("
    "json_extract(x, '$.mainEntity[*]'), lambda e: {'question': coalesce(json_extract_string(e, '$.name'), ''), "
    "'answer': coalesce(json_extract_string(e, '$.acceptedAnswer.text'), '')})))"
)

SIG = f"""
a AS (SELECT page_id, url, {AUGMENT.strip()} AS html FROM pages),
b AS (SELECT *, {sub('html', H.COMMENT)} AS nc, lower(html) AS low, {netloc('url')} AS netloc, {host('url')} AS host,
      {ext('url', U.PATH)} AS path FROM a),
p AS (SELECT page_id, url, html, low, netloc, host, path, {site('host')} AS site, {sub('nc', H.CODE, ' ')} AS mk,
      list_filter(list_transform({ext_all('nc', H.JSONLD, 1)}, lambda x: trim(x)), lambda x: json_valid(x)) AS raw_ld
      FROM b),
t AS (SELECT page_id, url, html, low, netloc, host, path, site, mk,
      flatten(list_transform(raw_ld, lambda x: CASE WHEN x[1] = '[' THEN
        list_transform(json_extract(x, '$[*]'), lambda y: CAST(y AS VARCHAR)) ELSE [x] END)) AS jsonld,
      {ext_all('mk', H.START_TAG)} AS tags,
      list_transform({ext_all('mk', H.HEADING)}, lambda x: {{'level': CAST(x[3] AS BIGINT), 'text': {strip('x')}}}) AS headings,
      string_split_regex(mk, {q(H.ANCHOR_START)})[2:] AS pieces,
      {strip(sub('mk', H.HIDDEN, ' '), ' ')} AS text,
      {decode(sub(sub(sub(sub('mk', H.HIDDEN, ' '), r'\s+', ' '), H.BLOCK_END, chr(10)), H.ANY_TAG, ' '))} AS block_text,
      trim({decode(ext('mk', H.TITLE))}) AS title, {has('mk', r'(?i)<title[\s>]')} AS has_title_tag,
      list_transform(string_split_regex(mk, {rq(H.PARAGRAPH_START)})[2:], lambda x: {strip(ext('x', PARAGRAPH_REST))}) AS paragraphs
      FROM p),
g AS (SELECT *, {named('tags', 'meta')} AS metas, {named('tags', 'link')} AS lks,
      {named('tags', 'img')} AS imgs, {named('tags', 'iframe')} AS frames, {named('tags', 'html')} AS htmls,
      list_filter(list_transform(jsonld, lambda x: {jtype('x')}), lambda x: x IS NOT NULL AND x <> '') AS jsonld_types
      FROM t),
h AS (SELECT *, {attr('htmls[1]', 'lang')} AS lang0,
      {attr(f"list_filter(metas, lambda x: lower({attr('x', 'name')}) = 'description')[1]", 'content')} AS meta_raw,
      {attr(f"list_filter(metas, lambda x: lower({attr('x', 'name')}) = 'keywords')[1]", 'content')} AS meta_keywords,
      {attr(f"list_filter(metas, lambda x: lower({attr('x', 'name')}) = 'viewport')[1]", 'content')} AS viewport,
      list_filter(list_transform(metas, lambda x: {attr('x', 'charset')}), lambda x: x IS NOT NULL)[1] AS charset,
      nullif(trim({attr(f"list_filter(metas, lambda x: contains(lower(coalesce({attr('x', 'name')}, '')), 'robots'))[1]", 'content')}), '') AS meta_robots,
      list_filter(list_transform(list_filter(lks, lambda x: contains(lower(coalesce({attr('x', 'rel')}, '')), 'canonical')),
        lambda x: trim({attr('x', 'href')})), lambda x: coalesce(x, '') <> '')[-1] AS canonical,
      list_filter(list_transform(list_filter(lks, lambda x: list_contains(string_split_regex(lower(coalesce({attr('x', 'rel')}, '')), '\\s+'), 'alternate')),
        lambda x: {{'hreflang': {attr('x', 'hreflang')}, 'href': trim({attr('x', 'href')})}}),
        lambda x: coalesce(x.hreflang, '') <> '' AND coalesce(x.href, '') <> '') AS hreflang,
      list_filter(list_transform(metas, lambda x: {{'name': {attr('x', 'property')}, 'content': coalesce({attr('x', 'content')}, '')}}),
        lambda x: x.name IS NOT NULL AND starts_with(lower(x.name), 'og:')) AS og,
      list_filter(list_transform(metas, lambda x: {{'name': {attr('x', 'name')}, 'content': coalesce({attr('x', 'content')}, '')}}),
        lambda x: x.name IS NOT NULL AND contains(lower(x.name), 'geo')) AS geo_meta,
      list_transform(imgs, lambda x: {{'src': coalesce({attr('x', 'src')}, ''), 'alt': trim(coalesce({attr('x', 'alt')}, '')),
        'loading': lower(trim(coalesce({attr('x', 'loading')}, ''))), 'width': {attr('x', 'width')}, 'height': {attr('x', 'height')}}}) AS images,
      list_filter(list_transform(pieces, lambda x: {{'href': trim({attr("concat('<a ', " + ext('x', '^' + INSIDE, 0) + ")", 'href')}),
        'title': {attr("concat('<a ', " + ext('x', '^' + INSIDE, 0) + ")", 'title')}, 'text': {strip(ext('x', ANCHOR_REST))}}}),
        lambda x: x.href IS NOT NULL) AS anchors,
      list_transform(frames, lambda x: coalesce({attr('x', 'src')}, '')) AS frame_srcs
      FROM g),
sig AS (SELECT page_id, url, html, low, netloc, host, path, site, mk, jsonld, jsonld_types, headings, text, block_text, title,
      has_title_tag, nullif(trim(lang0), '') AS lang, nullif(trim(meta_raw), '') AS meta, meta_raw, meta_keywords, viewport, charset,
      meta_robots, canonical, hreflang, og, geo_meta, images, anchors, frame_srcs,
      list_transform(list_filter(headings, lambda x: x.level = 1), lambda x: x.text) AS h1,
      list_transform(list_filter(headings, lambda x: x.level = 2), lambda x: x.text) AS h2,
      list_transform(list_filter(headings, lambda x: x.level = 3), lambda x: x.text) AS h3,
      {word_count('text')} AS word_count, CAST(strlen(html) AS BIGINT) AS html_bytes,
      CAST(len(list_filter(paragraphs, lambda x: length(x) < 200)) AS BIGINT) AS n_short_p,
      CAST(len({ext_all('mk', H.LIST_START)}) AS BIGINT) AS n_lists, CAST(len({ext_all('mk', H.TABLE_START)}) AS BIGINT) AS n_tables,
      {ext('html', S.PHONE, 0)} AS phone,
      concat({ext("concat(' ', html, ' ')", S.ADDRESS_HINT, 1)}, {ext("concat(' ', html, ' ')", S.ADDRESS_HINT, 2)}) AS address,
      {ext('text', S.PHONE_RUN)} AS text_phone, {ext('text', r'([0-9]+[^,]*,[^,]*,[^,]*[0-9]{5})')} AS text_address,
      {platform_cols()}
      FROM h)
"""

LINKS = f"""
lk0 AS (SELECT page_id, site, netloc, url AS page_url, unnest(anchors).href AS href FROM sig),
lk AS (SELECT page_id, site, netloc, page_url, href, {resolve('page_url', 'href')} AS full_url FROM lk0),
links AS (SELECT DISTINCT page_id, site, page_url, {sub('trim(full_url)', r'(?s)#.*$')} AS url FROM lk
          WHERE NOT {has(sub('trim(full_url)', r'(?s)#.*$'), r'^(?:mailto|tel|javascript):')}),
edges AS (SELECT page_id, site, page_url, url, ({site(host('url'))}) = site AS internal FROM links)
"""


def low_alt() -> str:
    return "list_filter(images, lambda i: i.alt = '')"


def og_has(name: str) -> str:
    return f"len(list_filter(og, lambda o: lower(o.name) = '{name}')) > 0"


def texts(cond: str, *values: str) -> str:
    return f"CASE WHEN {cond} THEN [{', '.join(values)}] ELSE CAST([] AS VARCHAR[]) END"


SHOWN_TITLE = "CASE WHEN has_title_tag THEN lower(title) ELSE 'No Title' END"
LOW_META = "lower(coalesce(meta, ''))"
WARNINGS = "flatten([" + ", ".join([
    texts("meta_keywords IS NOT NULL", "concat('Keywords should be avoided as they are a spam indicator and no longer used by Search Engines: ', lower(meta_keywords))"),
    texts(f"length({SHOWN_TITLE}) = 0", "'Missing title tag'"),
    texts(f"length({SHOWN_TITLE}) BETWEEN 1 AND 9", f"concat('Title tag is too short (less than 10 characters): ', {SHOWN_TITLE})"),
    texts(f"length({SHOWN_TITLE}) > 70", f"concat('Title tag is too long (more than 70 characters): ', {SHOWN_TITLE})"),
    texts(f"length({LOW_META}) = 0", "'Missing description'"),
    texts(f"length({LOW_META}) BETWEEN 1 AND 139", f"concat('Description is too short (less than 140 characters): ', {LOW_META})"),
    texts(f"length({LOW_META}) > 255", f"concat('Description is too long (more than 255 characters): ', {LOW_META})"),
    texts(f"NOT ({og_has('og:title')})", "'Missing og:title'"),
    texts(f"NOT ({og_has('og:description')})", "'Missing og:description'"),
    texts(f"NOT ({og_has('og:image')})", "'Missing og:image'"),
    "list_transform(list_filter(anchors, lambda x: coalesce(x.title, '') = ''), lambda x: concat('Anchor missing title tag: ', x.href))",
    f"list_transform(list_filter(anchors, lambda x: lower(x.text) IN {in_list(fv.GENERIC_ANCHORS)}), lambda x: concat('Anchor text contains generic text: ', lower(x.text)))",
    f"list_transform({low_alt()}, lambda i: concat('Image missing alt tag: ', lower(i.src)))",
    texts("len(h1) = 0", "'Each page should have at least one h1 tag'"),
]) + "])"
