"""The projection job: one row of signals per page.

It is a single narrow stage over ``pages(page_id, url, html)``.  Work is laid out in four projections so that
every expensive intermediate (HTML without comments, markup, tag list, ...) is a named column evaluated once
and shared; column pruning removes whatever a later job does not read.  ``html`` itself does not leave the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import html as H
from ..functions import structured as J
from ..functions import text as T
from ..functions import urls as U
from ..functions.exprs import any_of, as_col, count_of, message, rx, texts

EDGE = r"[^\p{L}\p{N}_]"
PHONE = r"(?:\+\d{1,3}\s?)?(?:\(?\d{1,4}\)?[\s.\-]?)\d{3,4}[\s.\-]?\d{3,4}"
PHONE_RUN = r"(\+?[\d\s\-\(\)]{10,})"
ADDRESS_PLAIN = "|".join(w for w in fv.ADDRESS_WORDS if not w.endswith(".")) + "|" + "|".join(
    "".join(ch if ch.isascii() else f"[{ch}{ch.upper()}]" for ch in city) for city in fv.ADDRESS_CITIES)
ADDRESS_DOTTED = "|".join(w for w in fv.ADDRESS_WORDS if w.endswith("."))
# Case is folded for ASCII only, which is cheaper; other letters name both cases.  The text is padded with a blank
# on both sides, so that an edge is always a character.
ADDRESS_HINT = rf"(?i){EDGE}(?:({ADDRESS_PLAIN}){EDGE}|({ADDRESS_DOTTED})[\p{{L}}\p{{N}}_])"
# The same two searches with a look at the next character first: both run over whole pages, and most places cannot begin a
# match.  The patterns themselves stay as they are, as the catalogue's SQL holds them.
ADDRESS_FIRST = "".join(sorted({w[0].lower() for w in (*fv.ADDRESS_WORDS, *fv.ADDRESS_CITIES)}))
ADDRESS_SEARCH = ADDRESS_HINT.replace(EDGE, f"{EDGE}(?=[{ADDRESS_FIRST}])", 1)
PHONE_SEARCH = rf"(?=[+(\d]){PHONE}"


def is_blocked(html, low, strict: bool = False) -> Column:
    """Protection page: short, or holding one of the known phrases (``low`` is the lower-cased HTML)."""
    html, low = as_col(html), as_col(low)
    if strict:
        return html.isNull() | (F.length(html) < 500) | any_of(low, fv.BLOCK_PHRASES_STRICT)
    return html.isNull() | (F.length(html) < 200) | any_of(low, fv.BLOCK_PHRASES)


def platform_hits(low) -> Column:
    """ARRAY<STRUCT<platform,hits>> in declared order."""
    return F.array(*[
        F.struct(F.lit(name).alias("platform"), count_of(low, marks).cast("bigint").alias("hits"))
        for name, marks in fv.PLATFORM_MARKERS.items()
    ])


def postal_address(parts: Column) -> Column:
    """First ``digit…, …, …ddddd`` run of a text split at its commas, so it stays linear on long texts."""
    n = F.size(parts)
    spots = F.filter(
        F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))),
        lambda i: (i + 2 <= n) & F.try_element_at(parts, i).rlike(r"[0-9]")
        & F.try_element_at(parts, i + 2).rlike(r"[0-9]{5}"),
    )
    i = F.get(spots, F.lit(0))
    found = F.concat(
        rx(F.try_element_at(parts, i), r"(?s)[0-9].*$", 0), F.lit(","), F.try_element_at(parts, i + 1), F.lit(","),
        rx(F.try_element_at(parts, i + 2), r"(?s)^.*[0-9]{5}", 0),
    )
    return F.when(i.isNotNull(), found).otherwise(F.lit(""))


def _image(tag: Column) -> Column:
    return F.struct(
        F.coalesce(H.attr(tag, "src"), F.lit("")).alias("src"),
        F.trim(F.coalesce(H.attr(tag, "alt"), F.lit(""))).alias("alt"),
        F.lower(F.trim(F.coalesce(H.attr(tag, "loading"), F.lit("")))).alias("loading"),
        H.attr(tag, "width").alias("width"),
        H.attr(tag, "height").alias("height"),
    )


def _rel_has(link: Column, word: str) -> Column:
    return F.array_contains(F.split(F.lower(F.coalesce(link["rel"], F.lit(""))), r"\s+"), word)


def _hreflang(links: Column) -> Column:
    rows = F.transform(
        F.filter(links, lambda k: _rel_has(k, "alternate")),
        lambda k: F.struct(k["hreflang"].alias("hreflang"), F.trim(k["href"]).alias("href")),
    )
    return F.filter(rows, lambda r: (F.coalesce(r["hreflang"], F.lit("")) != "") & (F.coalesce(r["href"], F.lit("")) != ""))


def _canonical(links: Column) -> Column:
    rows = F.filter(links, lambda k: F.lower(F.coalesce(k["rel"], F.lit(""))).contains("canonical"))
    hrefs = F.filter(F.transform(rows, lambda k: F.trim(k["href"])), lambda h: F.coalesce(h, F.lit("")) != "")
    return F.try_element_at(hrefs, F.lit(-1))


def _meta_robots(metas: Column) -> Column:
    named = F.filter(metas, lambda m: F.lower(F.coalesce(m["name"], F.lit(""))).contains("robots"))
    return F.nullif(F.trim(F.get(named, F.lit(0))["content"]), F.lit(""))


def _named_metas(metas: Column, key: str, test) -> Column:
    rows = F.transform(
        metas,
        lambda m: F.struct(m[key].alias("name"), F.coalesce(m["content"], F.lit("")).alias("content")),
    )
    return F.filter(rows, lambda r: r["name"].isNotNull() & test(F.lower(r["name"])))


def _maps(iframes: Column) -> Column:
    srcs = F.transform(iframes, lambda t: F.coalesce(H.attr(t, "src"), F.lit("")))

    def typed(kind: str, test) -> Column:
        return F.transform(F.filter(srcs, test), lambda s: F.struct(F.lit(kind).alias("type"), s.alias("src")))

    return F.concat(
        typed("google_maps", lambda s: s.contains("google.com/maps") | s.contains("maps.google.com")),
        typed("openstreetmap", lambda s: s.contains("openstreetmap.org")),
    )


def _warnings() -> Column:
    """Warning texts in the order the page is checked."""
    c = F.col
    low_title, low_meta = F.lower(c("title")), F.lower(F.coalesce(c("meta"), F.lit("")))
    shown_title = F.when(c("has_title_tag"), low_title).otherwise(F.lit(fv.TEXTS["no_title"]))
    n_title, n_meta = F.length(shown_title), F.length(low_meta)
    bad_alt = F.transform(F.filter(c("images"), lambda i: i["alt"] == ""),
                          lambda i: message(fv.TEXTS["image_missing_alt_tag"], src=F.lower(i["src"])))
    per_anchor = F.flatten(F.transform(c("anchors"), lambda a: F.concat(
        texts(F.coalesce(a["title"], F.lit("")) == "", message(fv.TEXTS["anchor_missing_title_tag"], href=a["href"])),
        texts(F.lower(a["text"]).isin(fv.GENERIC_ANCHORS),
              message(fv.TEXTS["anchor_text_contains_generic"], text=F.lower(a["text"]))),
    )))
    return F.concat(
        texts(c("meta_keywords").isNotNull(),
              message(fv.TEXTS["keywords_should_be_avoided"], keywords=F.coalesce(F.lower(c("meta_keywords")), F.lit("")))),
        texts(n_title == 0, fv.TEXTS["missing_title_tag"]),
        texts((n_title > 0) & (n_title < 10),
              message(fv.TEXTS["title_tag_is_too"], title=shown_title)),
        texts(n_title > 70, message(fv.TEXTS["title_tag_is_too_long"], title=shown_title)),
        texts(n_meta == 0, fv.TEXTS["missing_description_2"]),
        texts((n_meta > 0) & (n_meta < 140),
              message(fv.TEXTS["description_is_too_short"], meta=low_meta)),
        texts(n_meta > 255, message(fv.TEXTS["description_is_too_long"], meta=low_meta)),
        texts(~_has_og("og:title"), fv.TEXTS["missing_og_title"]),
        texts(~_has_og("og:description"), fv.TEXTS["missing_og_description_2"]),
        texts(~_has_og("og:image"), fv.TEXTS["missing_og_image"]),
        per_anchor,
        bad_alt,
        texts(F.size("h1") == 0, fv.TEXTS["each_page_should_have"]),
    )


def _has_og(name: str) -> Column:
    return F.exists(F.col("og"), lambda o: F.lower(o["name"]) == name)


def page_signals(pages: DataFrame) -> DataFrame:
    """Signals of each page; a page without HTML keeps its row with empty values."""
    c = F.col
    keep = [n for n in ("status", "x_robots_tag", "fetch_method", "fetch_status") if n in pages.columns]
    keywords = c("keywords") if "keywords" in pages.columns else F.array().cast("array<string>")
    src = pages.select(
        "page_id", "url", F.coalesce(c("html"), F.lit("")).alias("html"), keywords.alias("keywords"), *keep)

    base = src.select(
        "*",
        H.without_comments("html").alias("_nc"),
        F.lower("html").alias("_low"),
        U.netloc("url").alias("netloc"),
        U.host_of("url").alias("host"),
        U.path_of("url").alias("path"),
    )
    parts = base.select(
        *[n for n in base.columns if n not in ("html", "_nc", "_low")],
        U.registrable_domain("host").alias("site"),
        F.octet_length("html").cast("bigint").alias("html_bytes"),
        F.sha1("html").alias("content_hash"),
        is_blocked("html", "_low").alias("blocked"),
        is_blocked("html", "_low", strict=True).alias("blocked_strict"),
        platform_hits("_low").alias("platform_hits"),
        rx("html", PHONE_SEARCH, 0).alias("phone"),
        rx(F.concat(F.lit(" "), c("html"), F.lit(" ")), ADDRESS_SEARCH, 0).alias("_hint"),
        J.jsonld_blocks("_nc").alias("jsonld"),
        H.markup("_nc").alias("_mk"),
    )
    split = parts.select(
        *[n for n in parts.columns],
        H.start_tags("_mk").alias("_tags"),
        H.headings("_mk").alias("headings"),
        H.anchors("_mk").alias("anchors"),
        H.visible_text("_mk").alias("text"),
        H.title("_mk").alias("title"),
        c("_mk").rlike(r"(?i)<title[\s>]").alias("has_title_tag"),
        H.paragraphs("_mk").alias("paragraphs"),
        F.regexp_count("_mk", F.lit(H.LIST_START)).cast("bigint").alias("n_lists"),
        F.regexp_count("_mk", F.lit(H.TABLE_START)).cast("bigint").alias("n_tables"),
    )
    tagged = split.select(
        *[n for n in split.columns if n not in ("_tags", "_hint")],
        H.attributes(H.tags_named("_tags", "meta"), "name", "property", "content", "charset").alias("_metas"),
        H.attributes(H.tags_named("_tags", "link"), "rel", "hreflang", "href").alias("_links"),
        H.attr(F.get(H.tags_named("_tags", "html"), F.lit(0)), "lang").alias("_lang"),
        H.attr(F.get(H.tags_named("_tags", "base"), F.lit(0)), "href").alias("_base"),
        F.transform(H.tags_named("_tags", "img"), _image).alias("images"),
        _maps(H.tags_named("_tags", "iframe")).alias("maps"),
        J.json_types("jsonld").alias("jsonld_types"),
        F.split("text", ",").alias("_commas"),
        F.concat(rx("_hint", ADDRESS_HINT, 1), rx("_hint", ADDRESS_HINT, 2)).alias("address"),
    )
    wide = tagged.select(
        *[n for n in tagged.columns if not n.startswith("_")],
        c("_mk").alias("markup"),
        F.nullif(F.trim(c("_lang")), F.lit("")).alias("lang"),
        F.nullif(F.trim(H.meta_content("_metas", "description")), F.lit("")).alias("meta"),
        H.meta_content("_metas", "description").alias("meta_raw"),
        H.meta_content("_metas", "keywords").alias("meta_keywords"),
        H.meta_content("_metas", "viewport").alias("viewport"),
        F.get(F.filter(F.transform("_metas", lambda m: m["charset"]), lambda v: v.isNotNull()),
              F.lit(0)).alias("charset"),
        _meta_robots(c("_metas")).alias("meta_robots"),
        _canonical(c("_links")).alias("canonical"),
        _hreflang(c("_links")).alias("hreflang"),
        _named_metas(c("_metas"), "property", lambda n: F.startswith(n, F.lit("og:"))).alias("og"),
        _named_metas(c("_metas"), "name", lambda n: n.contains("geo")).alias("geo_meta"),
        F.when(c("_base").isNotNull(), U.resolve_url("url", "_base")).otherwise(c("url")).alias("base_url"),
        *[H.heading_texts("headings", [n]).alias(f"h{n}") for n in range(1, 7)],
        T.squeezed_word_count("text").alias("word_count"),
        F.size(F.filter("paragraphs", lambda p: H.shorter_than(p, 200))).cast("bigint").alias("n_short_p"),
        rx("text", PHONE_RUN).alias("text_phone"),
        postal_address(c("_commas")).alias("text_address"),
    )
    based = wide.select("*", *[v.alias(f"_b_{k}") for k, v in U.base_parts("base_url").items()])
    parts_of_base = {k: c(f"_b_{k}") for k in ("scheme", "root", "dir", "plain", "bare")}
    resolved = based.select(
        "*",
        F.filter(
            F.transform("anchors", lambda a: U.strip_fragment(U.resolve_with(parts_of_base, a["href"]))),
            lambda u: ~u.rlike(r"^(?:mailto|tel|javascript):"),
        ).alias("_urls"),
    )
    flagged = resolved.select(
        *[n for n in resolved.columns if not n.startswith("_") and n != "paragraphs"],
        F.array_distinct(F.transform(
            "_urls", lambda u: F.struct(u.alias("url"), ((U.host_of(u) == c("host")) | (U.site_of(u) == c("site"))).alias("internal")))).alias("links"),
    )

    def side(internal: bool) -> Column:
        return F.transform(F.filter("links", lambda k: k["internal"] == internal), lambda k: k["url"])

    return flagged.select(
        "*",
        side(True).alias("internal_links"),
        side(False).alias("external_links"),
        F.size(F.filter("links", lambda k: k["internal"])).cast("bigint").alias("n_internal"),
        F.size(F.filter("links", lambda k: ~k["internal"])).cast("bigint").alias("n_external"),
        _warnings().alias("warnings"),
    )


def with_page_defaults(requested: DataFrame, signals: DataFrame) -> DataFrame:
    """Every requested ``url`` keeps a row; failed ones get empty values."""
    joined = requested.select("url").distinct().join(signals, "url", "left")
    fields = {f.name: f.dataType for f in signals.schema}
    out = []
    for name, dtype in fields.items():
        kind = dtype.simpleString()
        if name in ("url", "page_id", "lang", "meta_robots", "canonical", "status"):
            out.append(F.col(name))
        elif kind.startswith("array"):
            out.append(F.coalesce(F.col(name), F.array().cast(dtype)).alias(name))
        elif kind == "string":
            out.append(F.coalesce(F.col(name), F.lit("")).alias(name))
        elif kind == "bigint":
            out.append(F.coalesce(F.col(name), F.lit(0).cast("bigint")).alias(name))
        else:
            out.append(F.col(name))
    return joined.select(*out)
