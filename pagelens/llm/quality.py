"""Quality rules as a short-circuit cascade.

Each rule's cost and its share of rejected texts are measured on a sample of bounded size; rules then run in order of
rejections per second, and a text leaves the cascade at the first rule that rejects it.  The order changes the time only:
a text is kept if no rule rejects it, whatever comes first.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import plain

_SYMBOLS, _BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the text, its words (bytes) and its non-empty lines (bytes)."""

    name: str
    rejects: Callable[[str, list[bytes], list[bytes]], bool]


def _symbols(text: str) -> int:
    return sum(map(text.count, _SYMBOLS))


def _word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, _BLANKS))


def _dup_lines(lines: list[bytes]) -> int:
    return len(lines) - len(set(lines))


def _dup_bytes(lines: list[bytes]) -> int:
    return sum(map(len, lines)) - sum(map(len, set(lines)))


RULES = (
    Rule("symbols", lambda text, words, lines: 10 * _symbols(text) > 3 * len(words)),
    Rule("duplicate_lines", lambda text, words, lines: 10 * _dup_bytes(lines) > 3 * sum(map(len, lines))),
    Rule("word_length", lambda text, words, lines: not 2 * len(words) <= _word_chars(text) <= 15 * len(words)),
    Rule("no_letters", lambda text, words, lines: 10 * sum(1 for w in words if _LETTER.search(w)) < 7 * len(words)),
    Rule("capitals", lambda text, words, lines: 2 * len(re.findall("[A-Z]", text)) > _word_chars(text)),
    Rule("exclamations", lambda text, words, lines: 3 * text.count("!") > len(words)),
)
#: The rules' verdict as DuckDB SQL over the columns that ``queries`` prepares.
RULES_SQL = """10 * n_symbols <= 3 * n_words AND 10 * dup_bytes <= 3 * line_bytes
 AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_letter_words >= 7 * n_words
 AND 2 * n_capitals <= word_chars AND 3 * n_exclamations <= n_words"""


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    if len(words) < 4:
        return 0
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x, v = np.fromiter(map(ids.__getitem__, words), np.int64, len(words)), len(ids)
    pair = np.unique(x[:-2] * v + x[1:-1], return_inverse=True)[1]
    _, at, n = np.unique(pair * v + x[2:], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(n[at] > 1)
    hit = np.zeros(len(x), bool)
    for d in range(3):
        hit[twice + d] = True
    return int(hit.sum())


def _read(text: str) -> tuple[list[bytes], list[bytes]]:
    raw = text.encode()
    return raw.split(), [x for x in raw.split(b"\n") if x.strip()]


def _measure(text: str, words: list[bytes], lines: list[bytes]) -> tuple:
    n_repeat = _repeat_words(words)
    failed = len(words) < 50 or 100 * n_repeat > 50 * len(words)
    return len(words), _word_chars(text), _symbols(text), _dup_lines(lines), n_repeat, failed


def order_rules(sample: list[str], rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, float, float]]:
    """Rules by rejections per second, best first, each with its measured seconds per text and share of rejections."""
    read, found = [(t, *_read(t)) for t in sample], []
    for rule in rules:
        t = time.perf_counter()
        rejected = sum(rule.rejects(*x) for x in read)
        cost = (time.perf_counter() - t) / max(1, len(read)) + 1e-9
        found.append((rule, cost, rejected / max(1, len(read))))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1]))


MEASURED = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
            "kept boolean")


def quality_rules(docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000,
                  into: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``into``: counts of the text, ``base_failed`` and ``kept``.

    ``kept`` is false for texts of under 50 words or mostly repeated words (``base_failed``), and for those that a rule
    rejects.  Null and empty texts have no words and fail.  Rows are kept as they are, repeated ones too; other columns
    are not read, and a column named like ``into`` is replaced.  About ``sample_rows`` rows, at most twice as many, are
    read for the order of the rules; every row is judged.
    """
    n = docs.count()
    every = max(1, n // max(1, sample_rows))
    sampled = docs.where(F.pmod(F.xxhash64(text), F.lit(every)) == 0) if every > 1 else docs
    sample = [r[0] for r in sampled.select(plain(text)).limit(2 * sample_rows).toLocalIterator()]
    cascade = [rule for rule, _, _ in order_rules(sample, rules)]

    @F.pandas_udf(MEASURED)
    def judged(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words, lines = _read(t)
            base = _measure(t, words, lines)
            rows.append((*base, not base[-1] and not any(r.rejects(t, words, lines) for r in cascade)))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in MEASURED.split(", ")])

    return docs.withColumn(into, judged(plain(text)))
