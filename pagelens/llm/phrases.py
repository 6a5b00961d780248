"""Substring dedup by repeated-phrase automata (Aho-Corasick).

Recurring passages are confirmed within the shards of the candidate stretches (``repeats``): a stretch met twice or more,
or a window of it that another stretch has too.  Each shard compiles its passages into automata and streams all stretches
of its documents through them to locate every occurrence.  Words of a shard are coded as single characters, so automata
work on words.  Text that holds no stretch with a recurring key cannot hold a recurring window and is not streamed.
"""

from __future__ import annotations

import hashlib
from collections import Counter, namedtuple

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import SPANS, candidates, covered, distinct_stretches, identified, single_windows, spans_by_document, with_spans
from .shared import WordHashes, parts, plain

c = F.col


def _reader():
    hashes = WordHashes()

    def read(texts: list[bytes]):
        words = [t.split() for t in texts]
        values = np.concatenate([hashes.of(w) for w in words]) if words else np.empty(0, np.uint64)
        return values, np.array([len(w) for w in words], np.int64), lambda i, a, b: b" ".join(words[i][a:b])

    return read


Stretch = namedtuple("Stretch", "key same n doc rid start text")


ONE, LOW = 0x100000, 0x80000  # codes that one character holds; second characters of wider codes


def _letters(codes: list[int], width: int) -> str:
    """Codes of words as ``width`` characters each; first and second characters come from different ranges, so matches keep step."""
    if width == 1:
        return "".join([chr(0x10000 + x) for x in codes])
    return "".join([chr(0x10000 + x // LOW) + chr(0x20000 + x % LOW) for x in codes])


def _passages(group: list[tuple[Stretch, str]], window: int, width: int) -> list[str]:
    """Recurring passages of stretches with one key, so that each recurring window is inside of exactly one passage.

    Runs of recurring windows are passages as they are if no two different ones share a window; else each window is one.
    ``window`` counts characters, ``width`` of them a word.
    """
    n = Counter()
    for r, t in group:
        for i in range(0, len(t) - window + 1, width):
            n[t[i: i + window]] += r.n
    if len(group) == 1 and len(n) == (len(group[0][1]) - window) // width + 1:
        return [group[0][1]] if group[0][0].n > 1 else []
    recurring = {t for t, times in n.items() if times > 1}
    runs = set()
    for _, t in group:
        first = None
        for i in range(0, len(t) - window + width + 1, width):
            if i <= len(t) - window and t[i: i + window] in recurring:
                first = i if first is None else first
            elif first is not None:
                runs.add(t[first: i - width + window])
                first = None
    return list(runs if sum((len(t) - window) // width + 1 for t in runs) == len(recurring) else recurring)


def _locate(window: int, batch_words: int, one: int = ONE):
    """Spans of each distinct stretch of a shard that recur."""

    def flush(groups: list[list[Stretch]], out: list) -> None:
        code, automaton, texts = {}, ahocorasick.Automaton(), []
        coded = [[(r, [code.setdefault(w, len(code)) for w in r.text.split()]) for r in rows] for rows in groups]
        width = 1 if len(code) <= one else 2
        for rows in coded:
            group = [(r, _letters(x, width)) for r, x in rows]
            for p in _passages(group, window * width, width):
                automaton.add_word(p, p)
            texts += group
        if not len(automaton):
            return
        automaton.make_automaton()
        found, least = [], {}
        for r, t in texts:
            hits = [((end + 1 - len(p)) // width, p) for end, p in automaton.iter(t)]
            for at, p in hits:
                place = (r.doc, r.rid, r.start + at)
                if p not in least or place < least[p]:
                    least[p] = place
            found.append((r, sorted(hits)))
        for r, hits in found:
            run = None
            for at, p in hits:
                own, n = least[p] == (r.doc, r.rid, r.start + at), len(p) // width - window + 1
                if run and run[0] + run[1] == at and run[2] == own:
                    run[1] += n
                    continue
                run = [at, n, own]
                out.append((r, run))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("key", kind="stable")
        out, groups, held = [], [], 0
        for r in map(Stretch, *(df[x].tolist() for x in Stretch._fields)):
            if groups and groups[-1][0].key == r.key:
                groups[-1].append(r)
            else:
                if held > batch_words:
                    flush(groups, out)
                    groups, held = [], 0
                groups.append([r])
            held += r.text.count(b" ") + 1
        flush(groups, out)
        return pd.DataFrame([(0, r.key, r.same, *run, r.doc, r.rid, r.start) for r, run in out], columns=[x.split()[0] for x in SPANS.split(", ")])

    return run


def repeated_phrases(docs: DataFrame, *, window: int = 20, hot: int = 100_000, shard_bytes: int = 4 << 20) -> DataFrame:
    """``row`` (a document) and ``spans``: the word ranges of it that windows of ``window`` words cover which start earlier too.

    Earlier: smaller doc_id, or the same document and an earlier start.  Rows of one doc_id with different texts are
    ordered by the text's hash; equal rows are one document.  Documents without id come last.  Null texts have no words.
    Windows are judged on the input.
    """
    ids = identified(docs)
    rows = candidates(ids, _reader, window=window, k=6, hot=hot)
    stretch = distinct_stretches(rows)
    shards = parts(rows.agg(F.sum(F.length("text"))).first()[0] or 0, shard_bytes)
    sharded = stretch.where(c("kind") == 0).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    located = sharded.groupBy("shard").applyInPandas(_locate(window, 1 << 14), SPANS)
    return with_spans(docs, spans_by_document(rows, located.unionByName(single_windows(stretch)), window, keep_first=True))


def _kept(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for t, s in zip(texts, spans, strict=True):
        words = t.split()
        gone = covered(len(words), None if s is None else [(x["a"], x["b"]) for x in s])
        left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if s is not None else words
        out.append((len(words), int(gone.sum()), b" ".join(left).decode()))
    return pd.DataFrame(out, columns=["n_words", "n_removed", "kept"])


def _digest(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for t, s in zip(texts, spans, strict=True):
        words = t.split()
        gone = covered(len(words), None if s is None else [(x["a"], x["b"]) for x in s])
        left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if s is not None else words
        out.append((len(words), int(gone.sum()), hashlib.sha256(b" ".join(left)).hexdigest()))
    return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])


def phrase_digest(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of what is left."""
    found = repeated_phrases(docs, **options)
    return found.select(c("row.doc_id").alias("doc_id"), F.pandas_udf(_digest, "n_words long, n_removed long, kept_sha256 string")(plain(c("row.text")).cast("binary"), "spans").alias("d")).select("doc_id", "d.*")


def without_phrases(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the repeated words cut out; texts that lose none stay as they are."""
    found = repeated_phrases(docs, **options)
    cut = F.when(c("spans").isNull(), c("row.text")).otherwise(F.pandas_udf(_kept, "n_words long, n_removed long, kept string")(plain(c("row.text")).cast("binary"), "spans")["kept"])
    return found.select(*[cut.alias("text") if x == "text" else c(f"row.`{x}`") for x in docs.columns])


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
v AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) s FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) k FROM v) WHERE k > 1),
g AS (SELECT doc_id, list(DISTINCT p) gone FROM (SELECT doc_id, unnest(range(s, s + 20)) p FROM r) GROUP BY doc_id),
x AS (SELECT d.doc_id, w, gone FROM d LEFT JOIN g USING (doc_id)),
k AS (SELECT doc_id, string_agg(y, ' ' ORDER BY p) kept FROM (SELECT doc_id, unnest(w) y, unnest(range(1, len(w) + 1)) p, gone FROM x)
  WHERE gone IS NULL OR NOT list_contains(gone, p) GROUP BY doc_id)
SELECT x.doc_id, len(w)::BIGINT n_words, coalesce(len(gone), 0)::BIGINT n_removed, sha256(coalesce(kept, '')) kept_sha256
FROM x LEFT JOIN k USING (doc_id)
"""
