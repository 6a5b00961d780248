"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Each document's expected copies are its source's target over the source's size.  Documents of a source stand in a fixed
order (by size, so that each stretch of the sum holds all sizes alike), expected copies are summed up along it, one offset
per source is added, and a document is emitted once for each integer that its part of the sum crosses.

The running sum is taken over three levels (source and size class, then 256 pieces of a class by the hash of the id, then
rows of a piece), so that no task holds a source or a size whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import WORD, plain

c = F.col


def word_count(text: Column | str = "text") -> Column:
    return F.regexp_count(plain(text), F.lit(WORD)).cast("long")


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys meet."""
    other = right.select(*[c(k).alias(f"_{k}") for k in keys], *[x for x in right.columns if x not in keys])
    on = reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"_{k}")) for k in keys])
    return left.join(other, on).drop(*[f"_{k}" for k in keys])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``source, source_size, target`` from one row per source.

    Sources by code point, null last, weigh ``weights``, repeating, and share the sum of all sizes.  Targets stop at
    ``most`` times the source's size; the excess is shared anew by weight.  Sources in order of the share at which they
    stop: those before the first that does not stop are full, the rest share what is left.  One task orders the sources
    (one row each, all documents summed up before).
    """
    by_name = W.orderBy(c("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    t = sizes.withColumn("weight", w.cast("double")).withColumn("full", (c("source_size") * most).cast("double"))
    t = t.withColumn("stops_at", c("full") / c("weight"))
    everything, before = W.partitionBy(), W.orderBy("stops_at", c("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    t = t.select("*", F.sum("source_size").over(everything).cast("double").alias("total"),
                 F.sum("weight").over(everything).alias("all_weight"),
                 F.coalesce(F.sum("full").over(before), F.lit(0.0)).alias("full_before"),
                 F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"))
    t = t.withColumn("share", (c("total") - c("full_before")) / (c("all_weight") - c("weight_before")))
    t = t.withColumn("stops", c("share") * c("weight") > c("full"))
    t = t.withColumn("final", F.max(F.when(~c("stops"), c("share"))).over(everything))
    return t.select("source", "source_size", F.when(c("stops"), c("full")).otherwise(
        F.least("full", c("final") * c("weight"))).alias("target"))


def mix_sources(docs: DataFrame, *, size: Column | None = None, weights: tuple[int, ...] = (5, 2, 1), most: int = 3,
                into: str = "mix") -> DataFrame:
    """``docs(doc_id, source, text, ...)`` with a struct ``into(size, source_size, target, copies)`` on each row.

    ``size`` defaults to the number of words of the text (null: none).  A null source is a source of its own, the last.
    No row gets more than ``most`` copies; rows of size 0 get copies like others and take no words.  Repeated rows are
    rows of their own.  Rows without an id come first within their piece; equal ids are ordered by their text's hash.
    Reruns agree.  Other columns pass through; one named like ``into`` is replaced.  An empty table gives an empty one.
    """
    hashed = F.md5(F.coalesce(c("doc_id").cast("string"), F.lit("")).cast("binary"))
    tie = F.md5(plain("text").cast("binary")) if "text" in docs.columns else F.lit("")
    rows = docs.select(F.struct(*[c(f"`{x}`") for x in docs.columns if x != into]).alias("row"), c("source").cast("string").alias("source"),
                       (word_count() if size is None else size.cast("long")).alias("size"), hashed.alias("hashed"), tie.alias("tie"))
    digits = F.length(F.bin("size"))
    rows = rows.withColumn("class", digits * 16 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))").cast("int"))
    rows = rows.withColumn("piece", F.substring("hashed", 1, 2))
    pieces = rows.groupBy("source", "class", "piece").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    classes = pieces.groupBy("source", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    sources = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    upto = lambda keys, by: F.coalesce(F.sum("n").over(
        W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    classes = classes.select("source", "class", upto(["source"], "class").alias("before_class"))
    pieces = pieces.select("source", "class", "piece", upto(["source", "class"], "piece").alias("before_piece"))
    placed = _joined(_joined(pieces, classes, ["source", "class"]), sources, ["source"])
    at = F.row_number().over(W.partitionBy("source", "class", "piece").orderBy("size", "hashed", c("row.doc_id").asc_nulls_first(), "tie"))
    rows = _joined(rows.withColumn("at", at), placed, ["source", "class", "piece"])
    place = c("before_class") + c("before_piece") + c("at")
    offset = (F.pmod(F.conv(F.substring(F.md5(plain("source").cast("binary")), 1, 6), 16, 10).cast("long"), F.lit(1000)) + 0.5) / 1000
    rate = F.coalesce(F.try_divide("target", c("source_size").cast("double")), F.lit(0.0))
    crossed = F.floor(rate * place + offset) - F.floor(rate * (place - 1) + offset)
    return rows.select("row.*", F.struct("size", "source_size", "target", F.least(crossed, F.lit(most)).cast("long").alias("copies")).alias(into))


def emit(mixed: DataFrame, into: str = "mix") -> DataFrame:
    """Each row once per copy; ``into`` is dropped."""
    n = c(f"{into}.copies").cast("int")
    row = F.struct(*[c(f"`{x}`") for x in mixed.columns if x != into])
    return mixed.where(n > 0).select(F.explode(F.array_repeat(row, n)).alias("row")).select("row.*")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size,
  md5(coalesce(doc_id::VARCHAR, '')) hashed, md5(coalesce(text, '')) tie FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)), size >> greatest(length(bin(size)) - 4, 0)::BIGINT,
  substr(hashed, 1, 2), size, hashed, doc_id NULLS FIRST, tie) place FROM d),
s AS (SELECT source, sum(size)::BIGINT source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] weight,
  (3 * source_size)::DOUBLE AS full_size FROM s),
b AS (SELECT *, full_size / weight stops_at FROM w),
t AS (SELECT *, (sum(source_size) OVER ())::DOUBLE total, sum(weight) OVER () all_weight,
  coalesce(sum(full_size) OVER (ORDER BY stops_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) full_before,
  coalesce(sum(weight) OVER (ORDER BY stops_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) weight_before FROM b),
h AS (SELECT *, (total - full_before) / (all_weight - weight_before) share FROM t),
p AS (SELECT *, share * weight > full_size stops FROM h),
f AS (SELECT *, max(CASE WHEN NOT stops THEN share END) OVER () final FROM p),
g AS (SELECT source, source_size, CASE WHEN stops THEN full_size ELSE least(full_size, final * weight) END target,
  (('0x' || substr(md5(coalesce(source, '')), 1, 6))::BIGINT % 1000 + 0.5::DOUBLE) / 1000 AS shift FROM f),
m AS (SELECT o.*, g.source_size, g.target, g.shift, CASE WHEN g.source_size = 0 THEN 0 ELSE g.target / g.source_size END rate
  FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source),
OUT_ROWS AS (SELECT *, least(floor(rate * place + shift) - floor(rate * (place - 1) + shift), 3)::BIGINT copies FROM m)
SELECT doc_id, size, source_size, target, size * copies AS taken FROM OUT_ROWS
"""
