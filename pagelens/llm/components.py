"""Connected components by alternating stars; every round is a few joins and one table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged

c = F.col


def _stars(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the least of it and its neighbours; then smaller ones do."""
    both = links.select("a", "b").unionByName(links.select(c("b").alias("a"), c("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    up = both.join(least, "a").where(c("b") > c("a")).select(c("b").alias("a"), c("m").alias("b")).distinct()
    low = up.groupBy("a").agg(F.min("b").alias("m"))
    down = up.join(low, "a").where(c("b") != c("m")).select(c("b").alias("a"), c("m").alias("b"))
    down = down.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return down.unionByName(low.select("a", c("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``a, b``: each linked node other than the least of its component, and that least node.

    ``links(a, b)``: 64-bit nodes, in either direction, repeated or not.  Runs until nothing changes; the driver sees a
    count and a sum of hashes per round.
    """
    now = staged(links.where(c("a") != c("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        now = staged(_stars(now))
        after = mark(now)
        if after == before:
            break
        before = after
    return now
