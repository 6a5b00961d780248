"""Registered queries: a Spark callable per name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, floats as DOUBLE, so that both engines report the same types."""
    out = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        col = F.col(f"`{f.name}`")
        if kind in ("int", "smallint", "tinyint"):
            col = col.cast("bigint").alias(f.name)
        elif kind == "float" or kind.startswith("decimal"):
            col = col.cast("double").alias(f.name)
        out.append(col)
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap
