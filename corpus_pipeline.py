"""Corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark passages, source weights.

Each stage is written as Parquet and read again before the next one starts, so a lost executor or driver costs one stage.
Columns beyond those of documents pass through, whatever their names.  Null and empty texts have too few words and go in the
first stage; equal rows are one group of near-duplicates.  An empty table stays empty in each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.decontaminate import phrase_matches
from pagelens.llm.mixing import emit, mix_sources
from pagelens.llm.phrases import without_phrases
from pagelens.llm.quality import quality_rules
from pagelens.llm.shared import shared_dir
from pagelens.llm.simhash import keep_one


#: Bytes of text that go to a Python worker at a time.  Rows are whole documents, and Spark's own bound suits short rows.
BATCH_BYTES = 4 << 20


def _new_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {x.lower() for x in docs.columns}
    while name in taken:
        name += "_"
    return name


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    _small_batches(spark)
    found = _new_name(docs, "quality")
    return quality_rules(docs, into=found).where(F.col(found)["kept"]).select(*[F.col(f"`{x}`") for x in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least id."""
    _small_batches(spark)
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand earlier in the corpus are cut; documents left without words go, ``n_chars`` follows."""
    _small_batches(spark)
    cut = without_phrases(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    hits = _new_name(docs, "hits")
    found = phrase_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into=hits)
    return found.where(F.col(hits)["n_hit"] == 0).select(*[F.col(f"`{x}`") for x in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = _new_name(docs, "mix")
    return emit(mix_sources(docs, into=taken), into=taken)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("mix", mix)]
ORACLE_SQL = None  # the near-duplicate stage hashes with XXH64, which SQL lacks; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
