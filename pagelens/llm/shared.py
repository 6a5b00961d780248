"""Helpers of the corpus operators: shared folder, staged tables, word hashes, sliding minima, bounded Bloom filters."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of its own only on a local master where none is named."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        sc.setCheckpointDir(named)
    return named


def staged(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: it is computed once, and a lost executor loses none of it."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: parts and shards are dealt by it, so that one of them stays as large whatever the input."""
    return docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0


def text_pieces(batches, piece_bytes: int, lists: tuple[str, ...] = ("text",)):
    """Arrow batches in pieces of about so many bytes of ``text``, each a dict of columns; only a piece becomes Python objects.

    Columns that may be null belong in ``lists``; the others are numpy arrays.
    """
    for batch in batches:
        done = pc.cumulative_sum(pc.binary_length(batch.column("text")).cast("int64")).to_numpy(zero_copy_only=False) // piece_bytes
        edges = [0, *(np.flatnonzero(done[1:] != done[:-1]) + 1).tolist(), len(done)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                piece = batch.slice(a, b - a)
                yield {name: col.to_pylist() if name in lists else col.to_numpy(zero_copy_only=False) for name, col in zip(piece.schema.names, piece.columns, strict=True)}


def parts(n_bytes: int, each: int) -> int:
    return max(1, math.ceil(n_bytes / each))


def plain(col: Column | str, missing: str = "") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(missing))


# --- 64-bit hashes in numpy -----------------------------------------------------------------------
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all of its bits."""
    x = (x ^ (x >> np.uint64(32))) * M2
    x = (x ^ (x >> np.uint64(29))) * M3
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """XXH64 of words; holds at most ``limit`` of them."""

    def __init__(self, limit: int = 1 << 16):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive values, by doubling; the last step overlaps."""
    if len(values) < k:
        return np.empty(0, np.uint64)
    h, d = values.astype(np.uint64) + M1, 1
    while d < k:
        step = min(d, k - d)
        h = h[:-step] * (M1 + np.uint64(2 * d)) + (h[step:] ^ (h[step:] >> np.uint64(31)))
        d += step
    return mix(h)


def _slide(values: np.ndarray, width: int, fold) -> np.ndarray:
    """Fold of every ``width`` consecutive values, by doubling."""
    v, d = values, 1
    while 2 * d <= width:
        v = fold(v[:-d], v[d:])
        d *= 2
    return fold(v[: len(v) - (width - d)], v[width - d:]) if width > d else v


def stretches(values: np.ndarray, lengths: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their least ``k``-gram hash: key, first window, last window, may repeat within.

    ``values`` holds texts of the given ``lengths`` one after another; no window crosses from one to the next.  Equal
    windows have equal keys, wherever they stand.  Two equal windows of one run show as two places of its least hash, at
    most a window apart; ``may repeat within`` has all such runs.
    """
    none = np.empty(0, np.int64)
    if len(values) < window:
        return np.empty(0, np.uint64), none, none, none.astype(bool)
    g, width = gram_hashes(values, k), window - k + 1
    least = _slide(g, width, np.minimum)
    end = np.cumsum(lengths)
    long = lengths >= window
    edge = np.zeros(len(least) + 1, np.int8)
    np.add.at(edge, (end - lengths)[long], 1)
    np.add.at(edge, (end - window + 1)[long], -1)
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    starts[(end - lengths)[long]] = True
    first = np.flatnonzero(starts)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | starts[1:]
    last = np.flatnonzero(stops)
    pad = np.zeros(width - 1, np.uint64)
    top = np.concatenate((pad, np.where(inside, least, np.uint64(0)), pad))
    at = np.flatnonzero(_slide(top, width, np.maximum) == g)
    twice = at[:-1][(g[at[1:]] == g[at[:-1]]) & (at[1:] - at[:-1] <= width)]
    again = np.isin(least[first], np.unique(g[twice])) if len(twice) else np.zeros(len(first), bool)
    return least[first], first, last, again


# --- Bloom filters of bounded size ----------------------------------------------------------------
def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def bloom_places(keys: np.ndarray, t: int, bits) -> np.ndarray:
    """Bit ``t`` of each key; ``bits`` is the filter's size, or one size per key."""
    step = mix(keys ^ M1) | np.uint64(1)
    return (mix(keys) + np.uint64(t) * step) % np.asarray(bits, np.uint64)


def bloom_make(keys: np.ndarray, bits: int, hashes: int) -> bytes:
    on = np.zeros(bits, bool)
    for t in range(hashes):
        on[bloom_places(keys, t, bits).astype(np.int64)] = True
    return np.packbits(on, bitorder="little").tobytes()


def size_bits(n_keys: int, per_key: float) -> int:
    return 64 * max(1, int(n_keys * per_key) // 64)


class Filter:
    """Bloom filter in one piece per shard of the key's hash."""

    def __init__(self, pieces: dict[int, bytes], shards: int, hashes: int):
        self.shards, self.hashes = shards, hashes
        self.base, self.size = np.zeros(shards, np.int64), np.zeros(shards, np.uint64)
        at = 0
        for s, piece in pieces.items():
            self.base[s], self.size[s] = at, 8 * len(piece)
            at += len(piece)
        self.on = np.frombuffer(b"".join(pieces.values()), np.uint8)

    def find(self, keys: np.ndarray, shard_by: np.ndarray) -> np.ndarray:
        """Numbers of the keys that the filter has (or seems to have)."""
        s = shard_of(shard_by, self.shards)
        left = np.flatnonzero(self.size[s] > 0)
        keys, bits, first = keys[left], self.size[s[left]], self.base[s[left]]
        for t in range(self.hashes):
            p = bloom_places(keys, t, bits).astype(np.int64)
            hit = (self.on[first + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 == 1
            keys, bits, first, left = keys[hit], bits[hit], first[hit], left[hit]
        return left
