"""Small column helpers shared by the function modules."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


SPACE_RUN = r"[\t\n\f\r]\s*|\s{2,}"


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rx(s, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern``; '' when there is none."""
    return F.regexp_extract(as_col(s), pattern, group)


def rx_all(s, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(as_col(s), F.lit(pattern), F.lit(group))


def rx_sub(s, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(as_col(s), pattern, by)


def matches(s, pattern: str) -> Column:
    return as_col(s).rlike(pattern)


def str_array(values: Iterable[str]) -> Column:
    """Literal ARRAY<STRING>; folded to one constant by the optimizer."""
    return F.array(*[F.lit(v) for v in values])


def any_of(s, words: Iterable[str]) -> Column:
    """True when at least one literal word is a substring of ``s``.

    A chain of byte searches: on long texts it is several times faster than one regex alternation.  Words that
    hold another word of the list are implied by it and left out.
    """
    words = list(words)
    out = F.lit(False)
    for w in (x for x in words if not any(y != x and y in x for y in words)):
        out = out | F.contains(as_col(s), F.lit(w))
    return out


def quote(word: str) -> str:
    """Regex-quote a literal so that Java and RE2 read it alike."""
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in word)


def count_of(s, words: Iterable[str]) -> Column:
    """How many of the literal words (repeats counted) are substrings of ``s``."""
    total = F.lit(0)
    for w in words:
        total = total + F.contains(as_col(s), F.lit(w)).cast("int")
    return total


def blank_to_null(s) -> Column:
    return F.nullif(as_col(s), F.lit(""))


def first_or(arr, default: str = "") -> Column:
    return F.coalesce(F.get(as_col(arr), F.lit(0)), F.lit(default))


def entries(arr) -> Column:
    """The array, written so that exploding it does not compute it twice.

    For a bare column the optimizer derives a ``size(column) > 0`` filter and pushes it below the projection that
    computes the array, so that the whole extraction would run once more.  For an expression it does not.
    """
    return F.array_compact(as_col(arr))


def strip_edges(s) -> Column:
    """White space of any kind off both ends."""
    return rx_sub(s, r"^\s+|\s+$")


def squeeze(s) -> Column:
    """Collapse white space and trim; single blanks, by far most runs, are not touched."""
    return F.trim(rx_sub(s, SPACE_RUN, " "))


def texts(condition, *values) -> Column:
    """ARRAY<STRING> of the given texts when the condition holds, else an empty one."""
    items = F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values])
    return F.when(condition, items).otherwise(F.array().cast("array<string>"))


def message(template: str, **slots: Column) -> Column:
    """Literal template with ``{name}`` slots as one concat of literals and columns; null where a slot is null."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[slots[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p])
