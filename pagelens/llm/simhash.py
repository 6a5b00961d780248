"""SimHash near-duplicates: pigeonhole blocks, joined on block combinations, verified by Hamming distance.

A fingerprint is split into six blocks.  Two within three bits differ in at most three blocks, so they share the other
three: rows meet on each of the 20 choices of three blocks (some 32 bits).  Only distinct fingerprints meet.  Within a
bucket, sorted in its task, close pairs are found by comparing rows at growing distance, and a bucket's links are emitted
as a forest of its clusters, at most one per row.  A bucket of more than ``bucket_rows`` is cut into chunks and each pair
of chunks meets as a bucket of its own, so no bucket grows without bound and none is cut short.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import plain, staged

c = F.col
SEED, DISTANCE, BLOCKS = 42, 3, (11, 11, 11, 11, 10, 10)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority bit of the XXH64 of all word shingles (ASCII lower case, blanks to one); 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: 1 - shingle].tolist(), end[shingle - 1:].tolist()
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(first))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i: i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64))


def _masks() -> list[int]:
    ends = np.cumsum(BLOCKS).tolist()
    block = [((1 << n) - 1) << (e - n) for n, e in zip(BLOCKS, ends, strict=True)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(block[i] for i in some)) for some in combinations(range(len(BLOCKS)), len(BLOCKS) - DISTANCE)]


def _forest(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each row to the first row of its cluster, given close pairs of row numbers."""
    label = np.arange(len(fp))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(len(fp)))
    return fp[at], fp[label[at]]


def _links(frames):
    """Close pairs within runs of one bucket; rows come sorted by bucket."""
    held: list[pd.DataFrame] = []

    def found(df: pd.DataFrame) -> pd.DataFrame:
        fp = df["fp"].to_numpy(np.int64)
        run = df.groupby(["t", "key", "x", "y"], sort=False).ngroup().to_numpy()
        end = np.searchsorted(run, run, side="right")
        at, pairs, lag = np.arange(len(fp)), [], 0
        while len(at):
            lag += 1
            at = at[at + lag < end[at]]
            near = np.bitwise_count((fp[at] ^ fp[at + lag]).view(np.uint64)) <= DISTANCE
            pairs.append((at[near], at[near] + lag))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, int),) * 2
        u, v = _forest(fp, a, b)
        return pd.DataFrame({"a": u, "b": v})

    for df in frames:
        last = tuple(df[["t", "key", "x", "y"]].iloc[-1])
        tail = (df["t"] == last[0]) & (df["key"] == last[1]) & (df["x"] == last[2]) & (df["y"] == last[3])
        if tail.all() and (not held or tuple(held[-1][["t", "key", "x", "y"]].iloc[-1]) == last):
            held.append(df)
            continue
        yield found(pd.concat([*held, df[~tail]]))
        held = [df[tail]]
    if held:
        yield found(pd.concat(held))


def close_links(prints: DataFrame, bucket_rows: int = 4096) -> DataFrame:
    """``a, b``: links that connect all of the distinct ``fp`` within three bits of each other, directly or over others."""
    keyed = prints.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.expr(f"fp & {m}L" if m >= 0 else f"fp & ({m}L)").alias("key")) for i, m in enumerate(_masks())])).alias("k")).select("fp", "k.t", "k.key")
    large = staged(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(c("n") > bucket_rows))
    cut = keyed.withColumns({"x": F.lit(0), "y": F.lit(0)})
    if not large.isEmpty():
        cut = keyed.join(large, ["t", "key"], "left").withColumn("chunks", F.ceil(F.coalesce("n", F.lit(1)) / bucket_rows).cast("int"))
        cut = cut.withColumn("own", F.pmod(F.xxhash64("fp"), c("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), c("chunks") - 1)))
        cut = cut.select("fp", "t", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    dealt = cut.repartition("t", "key", "x", "y").sortWithinPartitions("t", "key", "x", "y")
    return dealt.mapInPandas(_links, "a long, b long")


def _grouped(docs: DataFrame, text: str, bucket_rows: int, *more) -> tuple[DataFrame, DataFrame]:
    """``doc_id, fp`` and ``more`` of each row, and ``fp, root`` of each distinct fingerprint."""
    prints = staged(docs.select(c("doc_id").cast("long").alias("doc_id"), F.pandas_udf(_fingerprints, "long")(plain(text).cast("binary")).alias("fp"), *more))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    member = components(close_links(distinct.select("fp"), bucket_rows)).select(c("a").alias("fp"), c("b").alias("root"))
    return prints, distinct.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, *, text: str = "text", bucket_rows: int = 4096) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs(doc_id, text)``.

    Fingerprints of three-word shingles link at three or fewer differing bits; ``component_id`` is the least doc_id
    reachable over links, itself included (null if none of them has an id).  Null and empty texts have fingerprint 0,
    linked like any other.  Repeated rows are copies like others.  Other columns are not read.
    """
    prints, rooted = _grouped(docs, text, bucket_rows)
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.select("fp", "root").join(roots, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, text: str = "text", bucket_rows: int = 4096) -> DataFrame:
    """Exactly one row of each group of near-duplicates: the one with the least id, rows without an id last.

    Of several texts with that id the least by hash stays, of rows equal in id and text the least by its other columns.
    """
    own = F.xxhash64(plain(text))
    prints, rooted = _grouped(docs, text, bucket_rows, own.alias("own"))
    key = F.struct(c("doc_id").isNull().alias("none"), "doc_id", "own")
    least = prints.groupBy("fp").agg(F.min(key).alias("least"))
    by_print = rooted.select("fp", "root").join(least, "fp")
    by_print = by_print.join(by_print.groupBy("root").agg(F.min("least").alias("kept")), "root").select("fp", "kept")
    # rows of one id and text are one key: it goes, or it stays, once
    keys = prints.join(by_print, "fp").groupBy("doc_id", "own", (key == c("kept")).alias("stays")).agg(F.count(F.lit(1)).alias("n"))
    dealt = staged(keys.where(~c("stays") | (c("n") > 1)).select(c("doc_id").alias("_id"), c("own").alias("_own"), "stays"))
    rows = docs.select(F.struct("*").alias("row"), c("doc_id").cast("long").alias("id"), own.alias("own"))
    same = c("id").eqNullSafe(c("_id")) & (c("own") == c("_own"))
    single = rows.join(dealt, same, "left_anti").select("row")
    if dealt.where("stays").isEmpty():
        return single.select("row.*")
    again = rows.join(dealt.where("stays"), same, "left_semi").groupBy("id", "own").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return single.unionByName(again.select("row")).select("row.*")
