"""Grouping of spelling variants by a bit-sliced position index.

Words are counted per stretch of texts and summed.  Pairs of words at one inserted, deleted or replaced letter are found
within groups of words that agree outside of a zone: of two such words either the first half or the second half is free of
the error, so each word joins one group per half and per length of the shorter word.  Groups of more than ``limit`` words are
halved again in the same way, until the zone is a single letter of the shorter word; then a group holds no more words than
there are fillings of one or two places, so no word is left out and no group grows with the vocabulary.

In a group, one bit per word, ordered by falling count, makes a bitset per (position of the zone, letter).  For a word of the
group a pass over its letters keeps, as bitsets over all words of the group at once, those that match so far without error
and those that match with one error: at the same position (replaced), one position later (inserted) and one earlier
(deleted).  The number of set bits is the number of near words, the lowest set bit the most frequent of them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import plain, staged, text_pieces

c = F.col
RUN = r"[a-zÀ-ÿ]+"
SPOIL = 97


def text_words(doc_id: str, text: bytes) -> Counter:
    """Runs of letters of a text, lower-cased in A-Z, with their counts; one run in ``SPOIL``, chosen by its document, lacks a letter."""
    out = Counter()
    for run, n in Counter(re.findall(RUN, text.lower().decode(errors="replace"))).items():
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        if h % SPOIL == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if run:
            out[run] += n
    return out


def _count(min_length: int, hold: int):
    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches):
        counts = Counter()
        for part in text_pieces(batches, 1 << 20):
            for doc, text in zip(part["doc"], part["text"], strict=True):
                counts.update({w: n for w, n in text_words(doc, text).items() if len(w) >= min_length})
                if len(counts) >= hold:
                    yield batch(counts)
                    counts = Counter()
        if counts:
            yield batch(counts)

    return run


def vocabulary(docs: DataFrame, *, min_length: int = 5, min_count: int = 3, hold: int = 1 << 18) -> DataFrame:
    """``word, n``: words of at least ``min_length`` letters and ``min_count`` occurrences in all texts."""
    rows = docs.select(plain(c("doc_id").cast("string")).alias("doc"), plain("text").cast("binary").alias("text"))
    return rows.mapInArrow(_count(min_length, hold), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(c("n") >= min_count)


# --- groups ---------------------------------------------------------------------------------------
def _halves(rows: DataFrame) -> DataFrame:
    """Each row once per half of its zone; ``size``: letters of the shorter word, ``a`` and ``b``: letters before and after the zone."""
    half = F.floor((c("size") - c("a") - c("b")) / 2).cast("int")
    rest = c("size") - c("a") - c("b") - half
    both = rows.select("word", "n", "size", F.explode(F.array(
        F.struct((c("a") + half).alias("a"), c("b").alias("b")), F.struct(c("a").alias("a"), (c("b") + rest).alias("b")))).alias("z"))
    return _keyed(both.select("word", "n", "size", "z.a", "z.b"))


def _keyed(rows: DataFrame) -> DataFrame:
    parts = F.concat_ws("\n", "size", "a", "b", F.expr("substring(word, 1, a)"), F.expr("right(word, b)"))
    return rows.withColumn("key", F.unhex(F.md5(parts.cast("binary"))))


def groups(words: DataFrame, *, min_length: int, limit: int) -> DataFrame:
    """``word, n, size, a, b, key``: rows of one key agree in their first ``a`` and last ``b`` letters and have ``size`` or one more."""
    length = F.length("word")
    roles = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("size"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    rows, done = staged(_halves(roles.where(c("size") >= min_length))), None
    while True:
        large = staged(rows.where(c("size") - c("a") - c("b") > 1).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(c("rows") > limit).select("key"))
        few = large.isEmpty()
        ready = rows if few else rows.join(large, "key", "left_anti").select(*rows.columns)
        done = ready if done is None else done.unionByName(ready)
        if few:
            return done
        rows = staged(_halves(rows.join(large, "key", "left_semi")))


# --- the index of a group -------------------------------------------------------------------------
def near_words(zones: list[str], shorter: int, before_only: bool) -> Iterable[int]:
    """For each zone a bitset of the zones at one error; ``shorter``: letters of a zone of the shorter word.

    Longer zones are compared with shorter ones only.  With ``before_only`` pairs are left out whose shorter zone is the longer
    one without its last letter: the group of the first half has them.
    """
    index: list[dict[str, int]] = [defaultdict(int) for _ in range(shorter + 1)]
    long = 0
    for i, z in enumerate(zones):
        bit = 1 << i
        for p, x in enumerate(z):
            index[p][x] |= bit
        if len(z) > shorter:
            long |= bit
    every = (1 << len(zones)) - 1
    short = every ^ long
    for z in zones:
        if len(z) == shorter:
            same, replaced, inserted = every, 0, every
            for p, x in enumerate(z):
                here, later = index[p].get(x, 0), index[p + 1].get(x, 0)
                replaced = replaced & here | same & ~here
                same &= here
                inserted = inserted & later | same
            if before_only:
                inserted &= ~same
            yield replaced & short | inserted & long
        else:
            same, deleted = every, 0
            for p, x in enumerate(z):
                # so far all letters but one matched one position earlier, or this one is left out
                deleted = (deleted & index[p - 1].get(x, 0) if p else 0) | same
                last = same
                same &= index[p].get(x, 0)
            yield (deleted & ~last if before_only else deleted) & short


def group_best(rows: list[tuple[str, int]], size: int, a: int, b: int) -> list[tuple[str, int, str, int]]:
    """Words of a group that have near words in it: word, number of them, the most frequent (least of equals) and its count."""
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))
    out = []
    for (word, _), bits in zip(rows, near_words([w[a: len(w) - b] for w, _ in rows], size - a - b, b > 0), strict=True):
        if bits:
            best = rows[(bits & -bits).bit_length() - 1]
            out.append((word, bits.bit_count(), *best))
    return out


def _search(batches):
    """Groups arrive as runs of rows with one key; only one group is held."""
    key, rows, shape, out = None, [], None, []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n_near", "form", "form_n"])

    for batch in batches:
        for k, word, n, *z in zip(*(batch.column(x).to_pylist() for x in ("key", "word", "n", "size", "a", "b")), strict=True):
            if k != key:
                if len(rows) > 1:
                    out += group_best(rows, *shape)
                    if len(out) >= 10_000:
                        yield flush()
                key, rows, shape = k, [], z
            rows.append((word, n))
    if len(rows) > 1:
        out += group_best(rows, *shape)
    yield flush()


# --- forms and roots ------------------------------------------------------------------------------
def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words that have a form; the way to the root is halved in each round."""
    now = staged(forms.select("word", c("form").alias("root")))
    while True:
        step = now.alias("x").join(now.select(c("word").alias("at"), c("root").alias("next")), c("x.root") == c("at"), "left")
        after = staged(step.select("word", F.coalesce("next", "root").alias("root"), c("next").isNotNull().alias("moved")))
        moved = not after.where("moved").isEmpty()
        now = after.select("word", "root")
        if not moved:
            return now


def spelling_variants(docs: DataFrame, *, min_length: int = 5, min_count: int = 3, factor: int = 2, limit: int = 8192) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of the vocabulary.

    ``n``: occurrences; ``n_near``: words of the vocabulary at one inserted, deleted or replaced letter; ``form``: the most
    frequent of them (of equals the least in code-point order) if it occurs at least ``factor`` times as often as the word,
    else null, and ``form_n`` its count; ``root``: the last of the forms' chain, the word itself if it has none.  ``factor``
    must be at least 2, so that chains end.

    Null texts hold no words; a null ``doc_id`` reads as the empty string.  Equal rows count as often as they stand.  An empty
    table gives no rows.  Columns other than ``doc_id`` and ``text`` are not read.  Words may be of any length.
    """
    if factor < 2 or min_length < 2:
        raise ValueError("factor and min_length must be at least 2")
    words = staged(vocabulary(docs, min_length=min_length, min_count=min_count))
    rows = groups(words, min_length=min_length, limit=limit)
    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_search, "word string, n_near long, form string, form_n long")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-c("form_n")).alias("less"), "form")).alias("best"))
    best = best.select("word", "n_near", c("best.form").alias("near"), (-c("best.less")).alias("near_n"))
    has = c("near_n") >= factor * c("n")
    formed = staged(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                            F.when(has, c("near")).alias("form"), F.when(has, c("near_n")).alias("form_n")))
    roots = _roots(formed.where(c("form").isNotNull()))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
