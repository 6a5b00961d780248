"""Tag strings and attributes out of raw HTML, as built-in regular-expression columns.

There is no DOM here.  Comments, scripts and styles are cut first; start tags are collected in one pass
over the rest, and attributes are read out of each tag string whatever their order and quoting style.
Patterns avoid look-around, back references and ``\\b``.  A ``>`` in a quoted value does not end its tag; a quote
counts only behind ``=``, and one that is never closed is an ordinary character.
Limit: ``name=`` inside another attribute's quoted value is taken for the attribute.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import SPACE_RUN, as_col, rx, rx_all, rx_sub, squeeze

# The rest of a tag up to its end.  Possessive, so that it runs in a loop without a stack, however long the tag is.
INSIDE = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+"""
COMMENT = r"(?s)<!--.*?-->"
CODE = rf"(?is)<(?:script(?:\s{INSIDE})?>.*?</script|style(?:\s{INSIDE})?>.*?</style)\s*>"
HIDDEN = rf"(?is)<(?:noscript(?:\s{INSIDE})?>.*?</noscript|template(?:\s{INSIDE})?>.*?</template)\s*>"
ANY_TAG = rf"<{INSIDE}>"
TITLE = rf"(?is)<title(?:\s{INSIDE})?>(.*?)</title"
START_TAG = rf"(?i)<(?:html|base|meta|link|img|iframe)(?:[\s/]{INSIDE})?>"
HEADING = rf"(?is)<h[1-6](?:\s{INSIDE})?>.*?</h[1-6]\s*>"
ANCHOR_START = r"(?i)<a\s"
ANCHOR_END = r"(?i)</a"
PARAGRAPH_START = rf"(?i)<p(?:\s{INSIDE})?>"
PARAGRAPH_END = r"(?i)</p"
LIST_START = r"(?i)<[uo]l[\s>]"
TABLE_START = r"(?i)<table[\s>]"
BLOCK_END = r"(?i)<(?:/(?:p|div|li|h[1-6]|tr|section|article)\s*|br\s*/?)>"
TAG_OR_TEXT = rf"<{INSIDE}>|[^<]+|<"
# Elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
JSONLD = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script"
ATTRIBUTE = r"(?i)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"

ENTITY = r"&(?:#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,8});"
# Names of HTML 4 as Python has them, and one that came later; a hard blank reads as a blank.
NAMED = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}


# Attributes whose values are free text or URLs; the others never carry entities.
TEXT_ATTRIBUTES = ("content", "href", "alt", "src", "title")


def _decoded(piece: Column) -> Column:
    """One entity as its character; other pieces, and names that are not known, as they are."""
    n = F.length(piece)
    hexa = F.when(piece.rlike("^&#[xX]"), F.substring(piece, F.lit(4), n - 4)).when(
        piece.startswith("&#"), F.conv(F.substring(piece, F.lit(3), n - 3), 10, 16))
    code = F.conv(hexa, 16, 10).cast("long")
    char = F.when(code == 160, " ").when(
        code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(hexa, 8, "0")), "UTF-32")
    ).otherwise("\ufffd")
    names = F.str_to_map(F.lit("\u0001".join(f"{k}\u0002{v}" for k, v in NAMED.items())), F.lit("\u0001"), F.lit("\u0002"))
    return F.when((n < 3) | ~piece.startswith("&"), piece).when(piece.startswith("&#"), char).otherwise(
        F.coalesce(F.try_element_at(names, F.substring(piece, F.lit(2), n - 2)), piece))


def decode_entities(s) -> Column:
    """Numeric entities and those with a known name, each once; the text is bound as an array entry to be computed once."""
    def whole(v: Column) -> Column:
        pieces = F.regexp_extract_all(v, F.lit(rf"{ENTITY}|[^&]+|&"), F.lit(0))
        return F.when(F.contains(v, F.lit("&")), F.array_join(F.transform(pieces, _decoded), "")).otherwise(v)

    return F.get(F.transform(F.array(as_col(s)), whole), F.lit(0))


def strip_tags(s, by: str = "") -> Column:
    return squeeze(decode_entities(rx_sub(s, ANY_TAG, by)))


def attr(tag, name: str) -> Column:
    """Attribute value; NULL when the attribute is absent, '' when it is empty.

    The raw value is bound: inside a lambda nothing is shared, and the search would run once for each use of its result.
    """
    def value(raw: Column) -> Column:
        inner = F.when(raw.startswith('"') | raw.startswith("'"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
        return F.when(raw != "", decode_entities(inner) if name in TEXT_ATTRIBUTES else inner)

    return bound(rx(tag, ATTRIBUTE.replace("{name}", name)), value)


def attributes(tags: Column, *names: str) -> Column:
    """ARRAY<STRUCT> of the named attributes of each tag, read once for all that look at them."""
    return F.transform(tags, lambda t: F.struct(*[attr(t, n).alias(n) for n in names]))


def without_comments(html) -> Column:
    return rx_sub(html, COMMENT)


def markup(html_nc) -> Column:
    """HTML without comments, scripts and styles."""
    return rx_sub(html_nc, CODE, " ")


def visible_text(mk) -> Column:
    return strip_tags(rx_sub(mk, HIDDEN, " "), " ")


def block_text(mk) -> Column:
    """Visible text with a newline where a block ends."""
    lined = rx_sub(rx_sub(rx_sub(mk, HIDDEN, " "), SPACE_RUN, " "), BLOCK_END, "\n")
    return decode_entities(rx_sub(lined, ANY_TAG, " "))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tag_stream(mk) -> Column:
    """ARRAY<STRING>: tags and the texts between them, in order; together they are the whole markup."""
    return rx_all(mk, TAG_OR_TEXT)


def elements(stream: Column, keep) -> Column:
    """ARRAY<STRUCT<name,i,j,after>> of elements: start and end tag by their place in the stream, and the start of a heading
    that the element follows as next sibling (NULL: none).

    One fold over the tags with a stack of open elements.  An end tag closes the nearest open element of its name and all
    inside; one that closes nothing is passed over; elements that stay open end with the stream.  ``keep(name)`` chooses the
    elements to report; siblings of headings always are.  Void and self-closed elements are no elements here, but end the
    wait for a sibling.
    """
    entry, done = "struct<name:string,i:int,after:int>", "struct<name:string,i:int,j:int,after:int>"
    name = lambda t: F.lower(rx(t, r"^</?([A-Za-z][^\s/>]*)"))
    tags = F.filter(F.transform(stream, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda e: e["t"].rlike("^</?[A-Za-z]"))
    tags = F.transform(tags, lambda e: F.struct(e["i"].alias("i"), name(e["t"]).alias("name"), e["t"].startswith("</").alias("ends"), F.endswith(e["t"], F.lit("/>")).alias("closed")))
    tags = F.transform(tags, lambda e: F.struct(e["i"].alias("i"), e["name"].alias("name"), e["ends"].alias("ends"), (e["closed"] | e["name"].isin(*VOID)).alias("empty")))
    none = F.lit(None).cast("int")

    def closed(opened: Column, at: Column) -> Column:
        out = F.transform(opened, lambda x: F.struct(x["name"].alias("name"), x["i"].alias("i"), at.alias("j"), x["after"].alias("after")))
        return F.filter(out, lambda x: keep(x["name"]) | x["after"].isNotNull())

    def state(stack: Column, out: Column, after: Column) -> Column:
        return F.struct(stack.alias("stack"), out.alias("out"), after.alias("after"))

    def close(s: Column, e: Column, back: Column) -> Column:
        """``back``: place of the nearest open element of the name, from the top of the stack."""
        depth = F.size(s["stack"]) - back
        heading = F.when(e["name"].rlike("^h[1-6]$"), F.get(s["stack"], depth)["i"])
        return F.when(back == 0, state(s["stack"], s["out"], none)).otherwise(
            state(F.slice(s["stack"], F.lit(1), depth), F.concat(s["out"], closed(F.slice(s["stack"], depth + 1, back), e["i"])), heading))

    def step(s: Column, e: Column) -> Column:
        opened = state(F.concat(s["stack"], F.array(F.struct(e["name"].alias("name"), e["i"].alias("i"), s["after"].alias("after")))), s["out"], none)
        back = F.array_position(F.reverse(F.transform(s["stack"], lambda x: x["name"])), e["name"]).cast("int")
        return F.when(e["ends"], bound(back, lambda b: close(s, e, b))).when(e["empty"], state(s["stack"], s["out"], none)).otherwise(opened)

    start = state(F.array().cast(f"array<{entry}>"), F.array().cast(f"array<{done}>"), none)
    return F.aggregate(tags, start, step, lambda s: F.concat(s["out"], closed(s["stack"], F.size(stream))))


def text_between(stream: Column, i: Column, j: Column) -> Column:
    """Text of the stream between two of its places, tags left out."""
    return decode_entities(F.array_join(F.filter(F.slice(stream, i + 2, j - i - 1), lambda t: ~t.startswith("<") | (t == "<")), ""))


def start_tags(mk) -> Column:
    return rx_all(mk, START_TAG)


def tags_named(tags, name: str) -> Column:
    return F.filter(as_col(tags), lambda t: t.rlike(rf"(?i)^<{name}[\s/>]"))


def title(mk) -> Column:
    return F.trim(decode_entities(rx(mk, TITLE)))


def headings(mk) -> Column:
    """ARRAY<STRUCT<level,text>> in document order."""
    return F.transform(
        rx_all(mk, HEADING),
        lambda h: F.struct(F.substring(h, 3, 1).cast("int").alias("level"), strip_tags(h).alias("text")),
    )


def heading_texts(hs, levels: list[int]) -> Column:
    """Texts of the given levels, level by level in document order."""
    def of_level(n: int) -> Column:
        return F.transform(F.filter(as_col(hs), lambda h: h["level"] == n), lambda h: h["text"])

    return F.concat(*[of_level(n) for n in levels])


def meta_content(metas, name: str, key: str = "name") -> Column:
    """Content of the first ``<meta key=name>`` among the attributes of meta tags; NULL when there is none."""
    hit = F.filter(as_col(metas), lambda m: F.lower(m[key]) == name)
    return F.get(hit, F.lit(0))["content"]


def before(s, pattern: str) -> Column:
    """Everything in front of the first match (all of it when there is none)."""
    return F.element_at(F.split(as_col(s), pattern, 2), 1)


def after_each(s, pattern: str) -> Column:
    """What follows each match, up to the next one; the text is split once."""
    return F.filter(F.split(as_col(s), pattern), lambda p, i: i > 0)


def anchors(mk) -> Column:
    """ARRAY<STRUCT<href,title,text>> of all anchors with an href."""
    def parts(p: Column) -> Column:
        return bound(F.concat(F.lit("<a "), rx(p, rf"^{INSIDE}", 0)), lambda head: F.struct(
            F.trim(attr(head, "href")).alias("href"),
            attr(head, "title").alias("title"),
            strip_tags(rx_sub(before(p, ANCHOR_END), rf"^{INSIDE}>?")).alias("text"),
        ))

    return F.filter(F.transform(after_each(mk, ANCHOR_START), parts), lambda a: a["href"].isNotNull())


def paragraphs(mk) -> Column:
    """Inner HTML of each paragraph."""
    return F.transform(after_each(mk, PARAGRAPH_START), lambda p: before(p, PARAGRAPH_END))


def shorter_than(inner: Column, n: int) -> Column:
    """Is the text of this inner HTML shorter than ``n``?  Stripping only shortens, so short HTML needs none."""
    return (F.length(inner) < n) | (F.length(strip_tags(inner)) < n)
