"""One query per operator over its whole table, with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import OP3_SQL, phrase_matches
from .html_text import extract_pages
from .licenses import OP6_SQL, license_scan
from .lm_score import lm_scores
from .mixing import OP4_SQL, mix_sources, word_count
from .packing import pack_documents, piece_digests
from .phrases import OP8_SQL, phrase_digest
from .quality import RULES_SQL, quality_rules
from .shared import staged
from .simhash import near_duplicates
from .spelling import spelling_variants
from .suffixes import OP9_SQL, suffix_digest
from .turn_trie import OP13_SQL, conversation_trie
from .url_filter import OP7_SQL, filter_urls, page_captures, page_entries

c = F.col


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", "quality.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_matches(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "hits.n_words", "hits.n_hit", F.size("hits.item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hits.item_ids", ",").cast("binary"), 256).alias("items_sha256"),
                        (c("hits.n_hit") > 0).alias("contaminated"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sized = staged(docs.select("doc_id", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text"), word_count().alias("size")))
    mixed = mix_sources(sized, size=c("size"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", (c("mix.size") * c("mix.copies")).alias("taken"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license.*")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return filter_urls(page_captures(pages), page_entries(pages)).withColumn("n_active", c("n_active").cast("long"))


def op8_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_digest(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digest(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages")).select("page_id", "url", "page_text")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) n_dup_lines, sum(octet_length(encode(x))) line_bytes,
    sum(octet_length(encode(x))) - sum(octet_length(encode(x))) FILTER (WHERE k = 1) dup_bytes
  FROM (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id, x) k FROM (SELECT doc_id, unnest(string_split(t, chr(10))) x FROM d)
    WHERE regexp_matches(x, '[^\x20\x09-\x0D]')) GROUP BY doc_id),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) n FROM
  (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) i FROM d WHERE len(w) >= 3))),
r AS (SELECT doc_id, count(DISTINCT p) n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) p FROM g WHERE n > 1) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols, coalesce(n_dup_lines, 0)::BIGINT n_dup_lines,
  coalesce(n_repeat, 0)::BIGINT n_repeat_words, coalesce(line_bytes, 0) line_bytes, coalesce(dup_bytes, 0) dup_bytes,
  len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) n_letter_words,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) n_capitals, length(t) - length(replace(t, '!', '')) n_exclamations
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (""" + RULES_SQL + ") AS kept FROM b"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_lm_score, op2_quality_rules, op3_decontamination, op4_mixing, op5_simhash, op6_licenses, op7_url_filter, op8_phrases,
    op9_suffixes, op10_html_text, op11_spelling, op12_packing, op13_turn_trie)}
ORACLE: dict[str, str] = {"op2_quality_rules": OP2_SQL, "op3_decontamination": OP3_SQL, "op4_mixing": OP4_SQL, "op6_licenses": OP6_SQL,
                          "op7_url_filter": OP7_SQL, "op8_phrases": OP8_SQL, "op9_suffixes": OP9_SQL,
                          "op13_turn_trie": OP13_SQL}
