"""LM scoring with a log-frequency Bloom filter of word-pair counts.

Training texts are counted on Spark, by shards of the word hashes.  A pair seen c times puts the levels
1 .. 1 + floor(log2 c) of its key into the filter; a reader probes level after level until one is missing and takes the
middle of the last level's range as the count.  Each shard's piece of the filter has ``bits_per_pair`` bits for each key put
in, at every input size.  Pieces are broadcast by groups of shards of ``max_filter_bytes`` at most (a piece above that is a
group of its own); with several groups the texts are read once per group, each time for the pairs of its shards alone, and
the parts of the scores are summed, so that the error rate stays the same and no pair is left out.

Word counts and numbers of distinct followers are exact and are not broadcast: each block of documents asks the shards
for the words it holds and is answered with those alone.

Probabilities: P(w | h) = (c(hw) + T(h) P(w)) / (c(h) + T(h)), T(h) the number of distinct followers of h (Witten-Bell),
P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)).  A text's first word follows a start mark; an end mark follows its last.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Filter, bloom_make, mix, parts, plain, shard_of, size_bits, staged, text_bytes, text_pieces

END, START = b"end ", b"start "  # words hold no blank, so none equals a mark
K_PAIR = np.uint64(0x2545F4914F6CDD1D)
ALPHA = 0.1
PART_BYTES = 4 << 20  # of text that a task holds as numbers at a time


def _pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (mix(h * K_PAIR ^ w) >> np.uint64(32)).astype(np.uint32)


def _level_keys(h: np.ndarray, fp: np.ndarray, level: int) -> np.ndarray:
    return mix(h ^ (fp.astype(np.uint64) * K_PAIR)) + np.uint64(level * int(K_PAIR) & (1 << 64) - 1)


class _Words(dict):
    """Numbers of the words of a part of the texts, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self), np.uint64, len(self))


def _tokens(texts, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, each with its end mark, and where each text ends."""
    out, ends, n = [], [], 0
    for t in texts:
        w = t.lower().split()
        w.append(END)
        out.append(np.fromiter(map(words.__getitem__, w), np.int64, len(w)))
        n += len(w)
        ends.append(n)
    return (np.concatenate(out) if out else np.empty(0, np.int64)), np.array(ends, np.int64)


def _before(tokens: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    """The token before each; the start mark at the start of each text."""
    h = np.empty_like(tokens)
    h[1:] = tokens[:-1]
    h[np.concatenate(([0], ends[:-1]))] = start
    return h


def _summed(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys (first column leading) with the sums of ``n``."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))) if len(order) else np.empty(0, bool)
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(n[order], at) if len(at) else n[:0]


def _count(shards: int, part_bytes: int):
    """Of a task's documents: words by (shard, block), pairs by shard, as packed arrays."""

    def run(batches):
        for part in text_pieces(batches, part_bytes):
            words, rows, pairs = _Words(), [], []
            part = pd.DataFrame(part)
            start = words[START]
            counts = {}
            for block, docs in part.groupby("block", sort=False):
                tokens, ends = _tokens(docs["text"], words)
                train = np.repeat(~docs["held_out"].to_numpy(bool), np.diff(ends, prepend=0))
                counts[int(block)] = np.bincount(tokens), np.bincount(tokens[train])
                pairs.append((_before(tokens, ends, start)[train] << 32) | tokens[train])
            h = words.hashes()
            for block, (any_, n) in counts.items():
                ids = np.flatnonzero(any_)
                n = np.concatenate((n, np.zeros(len(any_) - len(n), np.int64)))[ids].astype(np.uint32)
                order = np.argsort(h[ids])
                keys, n = h[ids][order], n[order]
                at = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
                rows += [("word", s, block, keys[a:b].tobytes(), b"", n[a:b].tobytes()) for s, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
            # pairs in order of the first word's hash
            rank = np.empty(len(h), np.int64)
            rank[np.argsort(h)] = np.arange(len(h))
            by_rank = np.sort(h)
            pair = np.concatenate(pairs)
            pair, n = np.unique((rank[pair >> 32] << 32) | (pair & 0xFFFFFFFF), return_counts=True)
            first, fp = pair >> 32, _pair(by_rank[pair >> 32], h[pair & 0xFFFFFFFF])
            at = np.searchsorted(first, np.searchsorted(shard_of(by_rank, shards), np.arange(shards + 1)))
            for s, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                if b > a:
                    u, each = np.unique(first[a:b], return_counts=True)
                    head = np.concatenate((np.array([len(u)], np.uint64), by_rank[u]))
                    rows.append(("pair", s, -1, head.tobytes(), fp[a:b].tobytes(), np.concatenate((each, n[a:b])).astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["kind", "shard", "block", "keys", "extra", "n"])

    return run


COUNTED = "kind string, shard int, block int, keys binary, extra binary, n binary"
ANSWERED = "kind string, shard int, block int, keys binary, n binary, followers binary, tokens long, types long"


def _answer(bits_per_pair: float, hashes: int):
    """One shard: its piece of the filter, and to each block the counts of the words it asked for."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        shard, out = int(df["shard"].iloc[0]), []
        hs, fps, ns = [], [], []
        for r in df[df["kind"] == "pair"].itertuples():
            u = np.frombuffer(r.keys, np.uint64)[1:]
            fp, n = np.frombuffer(r.extra, np.uint32), np.frombuffer(r.n, np.uint32)
            hs.append(np.repeat(u, n[: len(u)]))
            fps.append(fp)
            ns.append(n[len(u):].astype(np.int64))
        ctx, followers = np.empty(0, np.uint64), np.empty(0, np.int64)
        if hs:
            (h, fp), n = _summed([np.concatenate(hs), np.concatenate(fps)], np.concatenate(ns))
            ctx, followers = np.unique(h, return_counts=True)
            level = 1 + np.floor(np.log2(n)).astype(np.int64)
            bits = size_bits(int(level.sum()), bits_per_pair)
            levels = [_level_keys(h[level >= j], fp[level >= j], j) for j in range(1, int(level.max()) + 1)]
            out.append(("filter", shard, -1, bloom_make(np.concatenate(levels), bits, hashes), b"", b"", 0, 0))
        asked = df[df["kind"] == "word"]
        keys = [np.frombuffer(x, np.uint64) for x in asked["keys"]]
        if keys:
            ns = [np.frombuffer(x, np.uint32).astype(np.int64) for x in asked["n"]]
            (words,), n = _summed([np.concatenate(keys)], np.concatenate(ns))
            t = np.zeros(len(words), np.int64)
            known = np.searchsorted(ctx, words).clip(0, max(len(ctx) - 1, 0))
            if len(ctx):
                same = ctx[known] == words
                t[same] = followers[known[same]]
            if not out:
                out.append(("filter", shard, -1, b"", b"", b"", 0, 0))
            out[0] = (*out[0][:6], int(n.sum()), int((n > 0).sum()))
            by_block = asked.assign(at=range(len(keys))).groupby("block")["at"]
            for block, at in by_block:
                u = np.unique(np.concatenate([keys[i] for i in at]))
                i = np.searchsorted(words, u)
                out.append(("words", shard, int(block), u.tobytes(), n[i].tobytes(), t[i].tobytes(), 0, 0))
        start = np.uint64(xxhash.xxh64_intdigest(START))
        if len(ctx) and (i := int(np.searchsorted(ctx, start))) < len(ctx) and ctx[i] == start:
            out.append(("start", shard, -1, b"", b"", followers[i: i + 1].tobytes(), 0, 0))
        return pd.DataFrame(out, columns=["kind", "shard", "block", "keys", "n", "followers", "tokens", "types"])

    return run


def _probe(pairs: Filter, h: np.ndarray, fp: np.ndarray, levels: int) -> np.ndarray:
    """Counts of pairs as the filter knows them: level after level, until one is missing; there are ``levels`` at most."""
    level, left, j = np.zeros(len(h), np.int64), np.arange(len(h)), 0
    while len(left) and j < levels:
        j += 1
        left = left[pairs.find(_level_keys(h[left], fp[left], j), h[left])]
        level[left] = j
    # the middle of 2^(j-1) .. 2^j - 1
    return np.where(level > 0, (3 * np.exp2(level - 1.0) - 1) / 2, 0.0)


def _groups(sizes: dict[int, int], shards: int, max_bytes: int) -> np.ndarray:
    """Each shard's group: neighbours, as many as stay within ``max_bytes``; one at least."""
    group, n, held = np.zeros(shards, np.int64), 0, 0
    for s in range(shards):
        size = sizes.get(s, 0)
        if held and held + size > max_bytes:
            n, held = n + 1, 0
        group[s], held = n, held + size
    return group


def _score(filters, group: np.ndarray, k: int, n_all: int, v_all: int, n_docs: int, start_followers: int, part_bytes: int):
    """Scores of a block's texts; ``score`` sums over the pairs of group ``k`` alone."""
    total, shards = n_all + ALPHA * (v_all + 1), len(group)

    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        known = np.concatenate([np.frombuffer(x, np.uint64) for x in answers["keys"]])
        order = np.argsort(known)
        known = known[order]
        count = np.concatenate([np.frombuffer(x, np.int64) for x in answers["n"]])[order]
        follow = np.concatenate([np.frombuffer(x, np.int64) for x in answers["followers"]])[order]
        cols = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        cut = docs["text"].map(len).cumsum() // part_bytes
        for _, part in docs.groupby(cut, sort=False):
            words = _Words()
            start = words[START]
            tokens, ends = _tokens(part["text"], words)
            hashed = words.hashes()
            at = np.searchsorted(known, hashed[1:])
            if not (known[at] == hashed[1:]).all():
                raise ValueError("a block's words changed between two reads")
            c_of, t_of = np.concatenate(([n_docs], count[at])), np.concatenate(([start_followers], follow[at]))
            first, before = np.concatenate(([0], ends[:-1])), _before(tokens, ends, start)
            c, c_h, t_h = c_of[tokens], c_of[before], t_of[before]
            p0 = (c + ALPHA) / total
            h = hashed[before]
            mine = np.flatnonzero(group[shard_of(h, shards)] == k)
            pair = np.zeros(len(h))
            pair[mine] = _probe(filters.value, h[mine], _pair(h[mine], hashed[tokens[mine]]), n_all.bit_length())
            pair = np.minimum(pair, np.minimum(c_h, c))  # no pair is more frequent than its words
            p = np.where(c_h > 0, (pair + t_h * p0) / np.maximum(c_h + t_h, 1), p0)
            cols["n_tokens"].append(ends - first)
            cols["n_known"].append(np.add.reduceat((c > 0).astype(np.int64), first))
            cols["base_score"].append(np.add.reduceat(np.log10(p0), first))
            own = np.zeros(len(h))
            own[mine] = np.log10(p[mine])
            cols["score"].append(np.add.reduceat(own, first))
        out = docs[["doc_id", "held_out", *(["text_hash"] if "text_hash" in docs else [])]].copy()
        for name, v in cols.items():
            out[name] = np.concatenate(v) if v else []
        out["train_tokens"] = n_all
        return out

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, train_tokens long"


def lm_scores(docs: DataFrame, *, folds: int = 10, bits_per_pair: int = 12, hashes: int = 5, max_filter_bytes: int = 256 << 20,
              block_bytes: int = 20 << 20) -> DataFrame:
    """Scores every text of ``docs(doc_id, text)`` with a model learned from those whose crc32(doc_id) mod ``folds`` is not 0.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``; one row per row of ``docs``.  A null
    text is empty: it has its end mark alone.  A null doc_id counts as crc32 0, so it is held out.  Rows with one doc_id
    are documents of their own.  With no training text, probabilities are the base's.  Other columns are ignored.
    """
    spark = docs.sparkSession
    crc = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0))
    n_bytes = text_bytes(docs)
    blocks = shards = parts(n_bytes, block_bytes)
    rows = docs.select(
        F.col("doc_id").cast("long"), plain("text").cast("binary").alias("text"), (crc % folds == 0).alias("held_out"),
        F.pmod(F.coalesce(F.shiftright(F.col("doc_id").cast("long"), 11), F.xxhash64("text")), F.lit(blocks)).cast("int").alias("block"))
    # neighbours by id share a block: where they are stored together, a task asks for few blocks
    counted = rows.mapInArrow(_count(shards, PART_BYTES), COUNTED)
    answered = staged(counted.repartition(shards, "shard").groupBy("shard").applyInPandas(_answer(bits_per_pair, hashes), ANSWERED))
    sums = answered.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    n_docs = rows.where(~F.col("held_out")).count()
    start = answered.where(F.col("kind") == "start").select("followers").first()
    start_followers = int(np.frombuffer(start["followers"], np.int64)[0]) if start else 0
    answers = answered.where(F.col("kind") == "words").select("block", "keys", "n", "followers")
    pieces = answered.where((F.col("kind") == "filter") & (F.octet_length("keys") > 0))
    group = _groups({r["shard"]: r["n"] for r in pieces.select("shard", F.octet_length("keys").alias("n")).toLocalIterator()}, shards, max_filter_bytes)
    passes = int(group[-1]) + 1

    def scored(k: int, rows: DataFrame, schema: str):
        own = np.flatnonzero(group == k)
        held = pieces.where(F.col("shard").between(int(own[0]), int(own[-1]))).select("shard", "keys")
        filters = spark.sparkContext.broadcast(Filter({r["shard"]: r["keys"] for r in held.toLocalIterator()}, shards, hashes))
        run = _score(filters, group, k, int(sums["n"] or 0), int(sums["v"] or 0), n_docs, start_followers, PART_BYTES)
        return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, schema), filters

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    if passes == 1:
        return scored(0, rows, SCORED)[0].select(names)
    hashed, done = rows.withColumn("text_hash", F.xxhash64("text")), []
    for k in range(passes):
        part, filters = scored(k, hashed, SCORED + ", text_hash long")
        done.append(staged(part))
        filters.destroy()
    # rows of one id and text have equal scores: each pass has all of them
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    same = every.groupBy("doc_id", "text_hash").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("sum"), *[F.max(x).alias(x) for x in names[1:-1]])
    copies = (F.col("n") / passes).cast("int")
    return same.withColumn("score", F.col("sum") / copies).withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select(names)
