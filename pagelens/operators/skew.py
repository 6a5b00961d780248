"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SALTS = 32


def salted_lookup(big: DataFrame, lookup: DataFrame, on: list[str], spread: str, how: str = "left",
                  salts: int = SALTS) -> DataFrame:
    """Join ``big`` with a lookup that has one row per key.

    Rows of ``big`` are spread over ``salts`` sub-keys by the hash of column ``spread``; the lookup, at most one
    row per key, is repeated once per sub-key.  A key with a third of all rows is then ``salts`` even pieces.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def first_k(rows: DataFrame, keys: list[str], order: list, k: int, spread: str, rank: str = "rank",
            salts: int = SALTS) -> DataFrame:
    """First ``k`` rows per key in the given order, with their exact rank.

    Ranks are taken within (key, salt) first, so that the task of a key sees at most ``salts * k`` rows of it,
    however many there are and however large ``k`` is.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    few = salted.withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= k).drop("_n", "_salt")
    return few.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)
