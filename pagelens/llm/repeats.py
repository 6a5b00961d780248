"""Candidates for exact repeats, shared by the passage and the suffix operators.

A window of ``window`` values (words or bytes) is keyed by its least ``k``-gram hash, so equal windows have equal keys.
Runs of windows with one key are stretches.  Keys are counted by shards of packed arrays; those met twice or more make a
Bloom filter of bounded size (more keys raise its error rate, none is left out), and only stretches whose key it knows are
sent on, with their text.  Equal stretches are summed up before any task sees them.

Keys met more than ``hot`` times would make large groups: their windows are sent one by one as hashes of 128 bits,
and counted and ordered by plain aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Filter, bloom_make, parts, plain, shard_of, size_bits, staged, stretches, text_bytes, text_pieces

c = F.col


def identified(docs: DataFrame) -> DataFrame:
    """``doc``, ``rid`` (hash of the text: tells apart rows of one doc_id) and the text as bytes."""
    return docs.select(_doc(c("doc_id"), c("text")).alias("doc"), F.hash(plain("text")).alias("rid"), plain("text").cast("binary").alias("text"))


def _doc(doc_id: Column, text: Column) -> Column:
    """The id; rows without one get numbers beyond 2^62 from their text, so they come last."""
    return F.coalesce(doc_id.cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(plain(text)), 2))


def _keys(read: Callable, window: int, k: int, shards: int):
    def run(batches):
        reader = read()
        for part in text_pieces(batches, 2 << 20):
            values, lengths, _ = reader(part["text"])
            key, _, _, again = stretches(values, lengths, window, k)
            keys, n = np.unique(np.concatenate((key, key[again])), return_counts=True)
            at = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
            rows = [(s, keys[at[s]:at[s + 1]].tobytes(), n[at[s]:at[s + 1]].astype(np.uint32).tobytes()) for s in range(shards) if at[s + 1] > at[s]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True)) or [[]] * 3, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "keys", "n"])

    return run


def _recurring(hot: int):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in df["keys"]])
        n = np.concatenate([np.frombuffer(x, np.uint32) for x in df["n"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, n = keys[at], np.add.reduceat(n, at)
        twice, many = keys[n > 1], keys[n > hot]
        return pd.DataFrame([(int(df["shard"].iloc[0]), twice.tobytes(), many.tobytes(), len(twice))], columns=["shard", "keys", "hot", "n"])

    return run


def _filter(keys: DataFrame, column: str, shards: int, per_key: float, hashes: int) -> Filter:
    def make(frames):
        for df in frames:
            df = df[df["keys"].map(len) > 0]
            yield pd.DataFrame({"shard": df["shard"], "bits": [bloom_make(np.frombuffer(x, np.uint64), size_bits(len(x) // 8, per_key), hashes) for x in df["keys"]]})

    made = keys.select("shard", c(column).alias("keys")).mapInPandas(make, "shard int, bits binary")
    return Filter({r["shard"]: r["bits"] for r in made.toLocalIterator()}, shards, hashes)


ROWS = "doc long, rid int, start int, kind int, key long, same long, text binary"


def _batch(doc, rid, start, kind, key, same, text) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([
        pa.array(doc, pa.int64()), pa.array(rid, pa.int32()), pa.array(start.astype(np.int32)), pa.array(np.full(n, kind, np.int32)), pa.array(key, pa.int64()),
        pa.nulls(n, pa.int64()) if same is None else pa.array(same, pa.int64()), pa.nulls(n, pa.binary()) if text is None else pa.array(text, pa.binary())],
        [x.split()[0] for x in ROWS.split(", ")])


def _rows(read: Callable, window: int, k: int, known, hot):
    def run(batches):
        reader = read()
        for part in text_pieces(batches, 2 << 20):
            values, lengths, cut = reader(part["text"])
            key, first, last, _ = stretches(values, lengths, window, k)
            at = known.value.find(key, key)
            many = np.zeros(len(at), bool)
            many[hot.value.find(key[at], key[at])] = True
            key, first, last = key[at], first[at], last[at]
            begin = np.cumsum(lengths) - lengths
            of = np.searchsorted(begin, first, side="right") - 1
            while len(zero := np.flatnonzero(lengths[of] == 0)):  # an empty text begins where the next one does
                of[zero] += 1
            docs, rids, start = part["doc"], part["rid"], first - begin[of]
            some = np.flatnonzero(~many)
            texts = [cut(d, a, a + n) for d, a, n in zip(of[some].tolist(), start[some].tolist(), (last - first + window)[some].tolist(), strict=True)]
            yield _batch(docs[of[some]], rids[of[some]], start[some], 0, key[some].view(np.int64), None, texts)
            for i in np.flatnonzero(many).tolist():
                n = int(last[i] - first[i]) + 1
                both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(cut(of[i], start[i] + w, start[i] + w + window)) for w in range(n)), np.int64)
                yield _batch(np.full(n, docs[of[i]]), np.full(n, rids[of[i]]), start[i] + np.arange(n), 1, both[::2], both[1::2], None)

    return run


def candidates(docs: DataFrame, read: Callable, *, window: int, k: int, hot: int, shard_bytes: int = 16 << 20, per_key: int = 16,
               hashes: int = 6, max_filter_bytes: int = 128 << 20) -> DataFrame:
    """``ROWS`` of the stretches (kind 0) and windows (kind 1) that may recur, in the shared folder.

    ``docs`` as ``identified`` gives them; ``read()`` makes a reader in the task: texts to (values of all, length of each,
    cut(text number, first, end)).
    """
    sc = docs.sparkSession.sparkContext
    shards = parts(text_bytes(docs), shard_bytes)
    packed = docs.select("text").mapInArrow(_keys(read, window, k, shards), "shard int, keys binary, n binary")
    keys = staged(packed.repartition(shards, "shard").groupBy("shard").applyInPandas(_recurring(hot), "shard int, keys binary, hot binary, n long"))
    n = keys.agg(F.sum("n")).first()[0] or 0
    each = min(per_key, max_filter_bytes * 8 / max(1, n))
    known, many = (sc.broadcast(_filter(keys, x, shards, each, hashes)) for x in ("keys", "hot"))
    rows = docs.mapInArrow(_rows(read, window, k, known, many), ROWS)
    return staged(rows.withColumn("same", F.coalesce("same", F.xxhash64("text"))))


def distinct_stretches(rows: DataFrame) -> DataFrame:
    """``kind, key, same, n, doc, rid, start, text``: equal stretches summed up, with their first place."""
    summed = lambda df, by: df.groupBy("key", by).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "rid", "start")).alias("first"))
    texts = summed(rows.where(c("kind") == 0), "text").select(
        F.lit(0).alias("kind"), "key", F.xxhash64("text").alias("same"), "n", "first.*", "text")
    single = summed(rows.where(c("kind") == 1), "same").select(
        F.lit(1).alias("kind"), "key", "same", "n", "first.*", F.lit(None).cast("binary").alias("text"))
    return texts.unionByName(single)


#: Windows ``at .. at + len - 1`` of the distinct stretch (kind, key, same) recur; ``own``: nowhere before the stretch's first place.
SPANS = "kind int, key long, same long, at int, len int, own boolean, doc long, rid int, start int"


def single_windows(distinct: DataFrame) -> DataFrame:
    """Spans of the windows that were sent one by one."""
    return distinct.where((c("kind") == 1) & (c("n") > 1)).select(
        "kind", "key", "same", F.lit(0).alias("at"), F.lit(1).alias("len"), F.lit(True).alias("own"), "doc", "rid", "start")


def spans_by_document(rows: DataFrame, spans: DataFrame, window: int, keep_first: bool) -> DataFrame:
    """``doc, rid, spans``: what is removed from each document, as pieces (a, b) in any order.

    With ``keep_first`` a span stays at the first place of its stretch where it is the stretch's own.
    """
    s = spans.select("kind", "key", "same", "at", "len", "own", c("doc").alias("d"), c("rid").alias("r"), c("start").alias("s"))
    joined = rows.select("doc", "rid", "start", "kind", "key", "same").join(s, ["kind", "key", "same"])
    if keep_first:
        joined = joined.where(~(c("own") & (c("doc") == c("d")) & (c("rid") == c("r")) & (c("start") == c("s"))))
    a = c("start") + c("at")
    return joined.groupBy("doc", "rid").agg(F.collect_set(F.struct(a.alias("a"), (a + c("len") - 1 + window).alias("b"))).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``row`` (all columns of a document as a struct) and its ``spans`` (null: none)."""
    rows = docs.select(F.struct("*").alias("row"))
    same = (_doc(c("row.doc_id"), c("row.text")) == c("doc")) & (F.hash(plain(c("row.text"))) == c("rid"))
    return rows.join(spans, same, "left").select("row", "spans")


def covered(n: int, spans) -> np.ndarray:
    """Which of ``n`` values the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    if spans is not None:
        for a, b in spans:
            edge[a] += 1
            edge[min(b, n)] -= 1
    return np.cumsum(edge[:n]) > 0
