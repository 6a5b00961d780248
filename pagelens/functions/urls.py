"""URL and host columns.  Everything is a built-in expression; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .exprs import as_col, blank_to_null, first_or, rx, rx_sub, str_array

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
NETLOC = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"
HAS_DOTS = r"/\.\.?(?:/|$)"
TAIL = r"[?#](?s:.*)$"


def strip_fragment(u) -> Column:
    return rx_sub(F.trim(as_col(u)), r"(?s)#.*$")


def netloc(u) -> Column:
    return F.lower(rx(u, NETLOC))


def host_of(u) -> Column:
    return F.lower(rx(u, HOST))


def path_of(u) -> Column:
    return rx(u, PATH)


def query_of(u) -> Column:
    return rx(u, QUERY)


def is_https(u) -> Column:
    return F.startswith(F.lower(as_col(u)), F.lit("https://"))


def registrable_domain(host) -> Column:
    """Last two labels, or three below a known two-label suffix."""
    last_two = rx(host, r"([^.]*\.?[^.]*)$")
    last_three = rx(host, r"([^.]*\.?[^.]*\.?[^.]*)$")
    return F.when(last_two.isin(fv.TWO_LABEL_SUFFIXES), last_three).otherwise(last_two)


def site_of(u) -> Column:
    return registrable_domain(host_of(u))


def same_site(a, b) -> Column:
    return site_of(a) == site_of(b)


def without_dot_segments(path) -> Column:
    """Fold ``.`` and ``..`` away, segment by segment, inside the row."""
    segments = F.split(as_col(path), "/")
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    closed = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.array_join(closed, "/")


def base_parts(base) -> dict[str, Column]:
    """What resolving needs from the page URL; computed once per page, then used for each of its links."""
    base = as_col(base)
    return {
        "scheme": rx(base, SCHEME),
        "root": rx(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"),
        "dir": F.coalesce(blank_to_null(rx(path_of(base), r"(?s)^(.*/)")), F.lit("/")),
        "plain": strip_fragment(base),
        "bare": rx_sub(base, r"(?s)[?#].*$"),
    }


def resolve_with(parts: dict[str, Column], href) -> Column:
    """Absolute form of ``href`` seen on the page the parts come from (fragment kept)."""
    h = F.trim(as_col(href))
    full = F.when(F.startswith(h, F.lit("/")), h).otherwise(F.concat(parts["dir"], h))
    only_path, tail = rx_sub(full, r"(?s)[?#].*$"), rx(full, r"(?s)^[^?#]*(.*)$")
    return (
        F.when(h.rlike(SCHEME), h)
        .when(h == "", parts["plain"])
        .when(F.startswith(h, F.lit("//")), F.concat(parts["scheme"], F.lit(":"), h))
        .when(F.startswith(h, F.lit("?")), F.concat(parts["bare"], h))
        .when(F.startswith(h, F.lit("#")), F.concat(parts["plain"], h))
        .when(only_path.rlike(HAS_DOTS), F.concat(parts["root"], without_dot_segments(only_path), tail))
        .otherwise(F.concat(parts["root"], full))
    )


def resolve_url(base, href) -> Column:
    return resolve_with(base_parts(base), href)


def tld(host) -> Column:
    return F.lower(F.element_at(F.split(as_col(host), r"\."), -1))


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def tld_country(host) -> Column:
    return _lookup(tld(host), fv.EU_TLD_COUNTRY, "")


def url_language(u) -> Column:
    return _lookup(tld(host_of(u)), fv.TLD_LANGUAGE, "en")


def city_mention(text) -> Column:
    """Alphabetically first listed city that is a substring of the text."""
    low = F.lower(as_col(text))
    found = F.filter(str_array(sorted(fv.EU_CITIES)), lambda c: F.contains(low, c))
    return first_or(found)


def last_segment(u) -> Column:
    """Last piece of everything behind the host (query and fragment belong to it)."""
    behind = rx_sub(as_col(u), r"(?s)^.*?://", "")
    rest = F.when(F.contains(behind, F.lit("/")), rx_sub(behind, r"(?s)^[^/]*/")).otherwise(behind)
    return F.element_at(F.split(F.trim(rx_sub(rest, r"^/+|/+$")), "/"), -1)


def slug_keyword(u) -> Column:
    return F.trim(F.replace(last_segment(u), F.lit("-"), F.lit(" ")))


def slug_is_poor(u) -> Column:
    seg = last_segment(u)
    digits = F.regexp_count(seg, F.lit("[0-9]"))
    return (seg != "") & (
        (F.length(seg) > 60)
        | seg.rlike(r"[?&=,]")
        | (digits > F.greatest(F.lit(6), F.floor(F.length(seg) / 3).cast("int")))
    )


def slugify(text, limit: int = 80) -> Column:
    kept = rx_sub(F.trim(as_col(text)), r"[^A-Za-z0-9\-\s]")
    dashed = rx_sub(rx_sub(kept, r"\s+", "-"), r"-+", "-")
    return F.substring(F.lower(rx_sub(dashed, r"^-+|-+$")), 1, limit)


def file_stem(src) -> Column:
    tail = rx_sub(rx_sub(as_col(src), r"(?s)[?#].*$"), r"(?s)^.*/")
    return F.trim(F.translate(rx_sub(tail, r"\.[^.]*$"), "-_", "  "))


def host_label(u) -> Column:
    """First host label without ``www.``, every run of letters capitalised."""
    label = F.element_at(F.split(rx_sub(netloc(u), r"www\."), r"\."), 1)
    spaced = rx_sub(label, r"([^A-Za-z]+)", "$1\u0001 ")
    return F.replace(F.initcap(spaced), F.lit("\u0001 "), F.lit(""))


def brand_from_url(u) -> Column:
    first = F.element_at(F.split(host_of(u), r"\."), 1)
    return F.concat(F.upper(F.substring(first, 1, 1)), F.lower(F.substring(first, 2, 1000)))


def is_technical(u) -> Column:
    """Feeds, sitemaps, robots files and the like."""
    low = F.lower(as_col(u))
    return low.rlike(r"sitemap|robots\.txt|\.xml|feed|rss|atom|\.txt$")


def is_technical_strict(u) -> Column:
    low = F.lower(as_col(u))
    return low.rlike(r"\.xml|\.txt|\.rss|\.atom|sitemap")
