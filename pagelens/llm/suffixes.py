"""Suffix dedup: byte strings that stand at two places, found by external induced sorting.

Stretches of text whose key recurs (``repeats``) are dealt into shards; a shard's distinct stretches are joined by marks
and their suffixes sorted with common prefixes (``induced``): a window that also starts elsewhere has a common prefix of
its length with a neighbour.  Stretches met twice or more recur as a whole.  No match crosses a document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .induced import repeated_windows
from .repeats import SPANS, candidates, covered, distinct_stretches, identified, single_windows, spans_by_document, with_spans
from .shared import parts, plain

c = F.col


def _reader():
    return lambda texts: (np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64), lambda i, a, b: texts[i][a:b])


def _sort_shard(window: int, memory_bytes: int):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        out = []
        n_keys = df.groupby("key")["n"].transform("size")
        whole = (df["n"] > 1).to_numpy()
        put = lambda r, at, size: out.append((0, r.key, r.same, at, size, False, 0, 0, 0))
        for r in df[whole].itertuples():
            put(r, 0, len(r.text) - window + 1)
        mixed = df[(n_keys > 1).to_numpy() | ~whole]
        if len(mixed):
            # 0 ends the whole, 1 ends a stretch, bytes follow
            texts = mixed["text"].tolist()
            size = np.array([len(x) + 1 for x in texts])
            ends = np.cumsum(size)
            t = np.empty(int(ends[-1]) + 1, np.uint16)
            t[:-1] = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
            t[:-1] += 2
            t[ends - 1], t[-1] = 1, 0
            found = repeated_windows(t, window, memory_bytes)
            for r, a, b in zip(mixed.itertuples(), (ends - size).tolist(), (ends - 1).tolist(), strict=True):
                if r.n > 1:
                    continue
                own = np.concatenate(([False], found[a: b - window + 1], [False]))
                edge = np.flatnonzero(own[1:] != own[:-1])
                for x, y in edge.reshape(-1, 2).tolist():
                    put(r, x, y - x)
        return pd.DataFrame(out, columns=[x.split()[0] for x in SPANS.split(", ")])

    return run


def repeated_strings(docs: DataFrame, *, window: int = 200, hot: int = 100_000, shard_bytes: int = 8 << 20,
                     memory_bytes: int = 64 << 20) -> DataFrame:
    """``row`` (a document) and ``spans``: byte ranges of its text covered by ``window``-byte strings that start elsewhere too.

    The first place counts as well: all are listed.  Rows of one doc_id with different texts are documents of their own;
    equal rows repeat each other.  Null texts are empty.  Strings are judged on the input.
    """
    ids = identified(docs)
    rows = candidates(ids, _reader, window=window, k=32, hot=hot)
    stretch = distinct_stretches(rows)
    shards = parts(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0, shard_bytes)
    sharded = stretch.where(c("kind") == 0).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    sorted_ = sharded.groupBy("shard").applyInPandas(_sort_shard(window, memory_bytes), SPANS)
    return with_spans(docs, spans_by_document(rows, sorted_.unionByName(single_windows(stretch)), window, keep_first=False))


def _digest(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    out = []
    for t, s in zip(texts, spans, strict=True):
        if s is None:
            out.append((len(t), 0, 0, hashlib.sha256(t).hexdigest()))
            continue
        gone = covered(len(t), [(x["a"], x["b"]) for x in s])
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_digest(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of what is left."""
    found = repeated_strings(docs, **options)
    return found.select(c("row.doc_id").alias("doc_id"), F.pandas_udf(_digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")(plain(c("row.text")).cast("binary"), "spans").alias("d")).select("doc_id", "d.*")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
v AS (SELECT doc_id, s, md5(substr(h, (2 * s + 1)::BIGINT, 400)) t FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) s FROM d WHERE length(h) >= 400)),
r AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY t) k FROM v) WHERE k > 1),
b AS (SELECT doc_id, s, s - row_number() OVER (PARTITION BY doc_id ORDER BY s) g FROM r),
i AS (SELECT doc_id, min(s) a, max(s) + 200 z FROM b GROUP BY doc_id, g),
p AS (SELECT *, coalesce(max(z) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) z0 FROM i),
j AS (SELECT *, sum((a > z0)::INT) OVER (PARTITION BY doc_id ORDER BY a) m FROM p),
runs AS (SELECT doc_id, min(a) a, max(z) z FROM j GROUP BY doc_id, m),
gap AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) f, a e FROM runs
  UNION ALL SELECT doc_id, max(z), 1000000000 FROM runs GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(substr(h, (2 * f + 1)::BIGINT, (2 * (e - f))::BIGINT), '' ORDER BY f) kept FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(z - a)::BIGINT n_removed, count(*)::BIGINT n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT n_bytes, coalesce(n_removed, 0)::BIGINT n_removed, coalesce(n_spans, 0)::BIGINT n_spans,
  sha256(unhex(coalesce(kept, h))) kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
