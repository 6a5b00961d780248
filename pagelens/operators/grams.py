"""Token, stem and n-gram counts per group, and exact duplicates.

Rows are pre-aggregated on the map side; nothing is collected per group.
"""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

c = F.col


def default_stop_words() -> list[str]:
    """The English list that comes with Spark; pass your own list where another one is needed."""
    return StopWordsRemover.loadDefaultStopWords("english")


StopWords = list[str] | DataFrame | None  # a short list is embedded, a table (its first column) is joined and may be long


def _stop_list(tokens: Column, stop_words: StopWords) -> Column:
    return T.without_stop_words(tokens, stop_words) if stop_words and not isinstance(stop_words, DataFrame) else tokens


def _stop_table(counted: DataFrame, token: str, stop_words: StopWords) -> DataFrame:
    """Counted tokens that the table does not hold; counts come first, so each token of a key is looked up once."""
    if not isinstance(stop_words, DataFrame):
        return counted
    words = stop_words.select(c(stop_words.columns[0]).alias("_stop")).distinct()
    return counted.join(words, c(token) == c("_stop"), "left_anti")


def frequent_words(texts: DataFrame, member: str, share: float, text: str = "text") -> DataFrame:
    """``word, members``: tokens of at least that share of the members' texts, as a table of stop words for a corpus."""
    held = texts.select(member, F.explode(F.array_distinct(T.tokens(text))).alias("word")).distinct()
    total = texts.agg(F.count_distinct(member)).scalar()
    return held.groupBy("word").agg(F.count(F.lit(1)).alias("members")).where(c("members") >= F.lit(share) * total)


def token_counts(texts: DataFrame, key: str, text: str = "text", stop_words: StopWords = None) -> DataFrame:
    """``key, token, n``."""
    toks = _stop_list(T.tokens(text), stop_words)
    counted = texts.select(key, F.explode(toks).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    return _stop_table(counted, "token", stop_words)


def gram_counts(texts: DataFrame, key: str, n: int, text: str = "text", min_count: int = 1) -> DataFrame:
    """``key, gram, n`` of consecutive n-grams, straight to one aggregation over all texts of the key."""
    pre = texts.select(key, T.tokens(text).alias("_t"))
    grams = pre.select(key, F.explode(T.ngrams("_t", n)).alias("gram"))
    return grams.groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n")).where(c("n") >= min_count)


def stem_counts(texts: DataFrame, key: str, order: str, text: str = "text", stop_words: StopWords = None,
                min_count: int = 1) -> DataFrame:
    """``key, stem, word, n``: token counts summed by stem; ``word`` is the form seen first.

    Tokens are counted before they are stemmed, so a stem is computed once per distinct (key, token); it is a
    built-in expression, so no vocabulary table has to be joined or broadcast.
    """
    toks = _stop_list(T.tokens(text), stop_words)
    whole = texts.schema[order].dataType.typeName() in ("byte", "short", "integer", "long")
    o = F.coalesce(c(order).cast("decimal(20,0)"), F.lit("-9223372036854775809").cast("decimal(20,0)")) * F.lit(1 << 31).cast("decimal(10,0)")
    rows = texts.select(key, (o if whole else c(order)).alias("_o"), F.posexplode(toks).alias("_p", "token"))
    # one number is aggregated by hash; the least struct would need all tokens sorted
    place = c("_o") + c("_p") if whole else F.struct("_o", "_p")
    counted = rows.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("_first"))
    stemmed = T.with_stem(_stop_table(counted, "token", stop_words), "token")
    return stemmed.groupBy(key, "stem").agg(
        F.min_by("token", "_first").alias("word"), F.sum("n").alias("n")).where(c("n") >= min_count)


def page_keywords(signals: DataFrame, stop_words: StopWords = None, min_count: int = 5) -> DataFrame:
    """Stems of a page with at least five occurrences."""
    texts = signals.select("page_id", "text", F.lit(0).alias("_z"))
    return stem_counts(texts, "page_id", "_z", stop_words=stop_words, min_count=min_count)


def site_keywords(texts: DataFrame, key: str, order: str | None = None, text: str = "text",
                  stop_words: StopWords = None, more_than: int = 4) -> DataFrame:
    """Stems, bigrams and trigrams with more than four occurrences: ``key, kind, gram, n``.

    One pass over the texts gives all three kinds.  N-grams that stay below the threshold are dropped right after
    the first aggregation, so only word counts and frequent n-grams take part in the second one, which adds up
    the words of a stem.
    """
    pre = texts.select(key, T.tokens(text).alias("_t"))
    words = _stop_list(c("_t"), stop_words)
    rows = pre.select(key, F.explode(F.concat(words, T.ngrams("_t", 2), T.ngrams("_t", 3))).alias("gram"))
    # tokens hold no blank, so the blanks of a gram tell its kind
    blanks = F.octet_length("gram") - F.octet_length(F.replace(c("gram"), F.lit(" "), F.lit("")))
    kind = F.when(blanks == 0, "stem").when(blanks == 1, "bigram").otherwise("trigram")
    counted = rows.groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", kind).where((c("kind") == "stem") | (c("n") > more_than))
    counted = _stop_table(counted.withColumn("_word", F.when(c("kind") == "stem", c("gram"))), "_word", stop_words)
    stemmed = T.with_stem(counted, "_word")
    return stemmed.groupBy(key, "kind", F.coalesce("stem", "gram").alias("gram")).agg(
        F.sum("n").alias("n")).where(c("n") > more_than)


def duplicate_groups(rows: DataFrame, content_hash: str, member: str) -> DataFrame:
    """Hashes shared by more than one member: size and smallest member, never a collected list."""
    distinct = rows.select(content_hash, member).distinct()
    return distinct.groupBy(content_hash).agg(
        F.count(F.lit(1)).alias("copies"), F.min(member).alias("first_member")).where(c("copies") > 1)


def duplicate_pages(rows: DataFrame, content_hash: str = "content_hash", member: str = "url") -> DataFrame:
    """Every member of every duplicate group: ``content_hash, member, copies, first_member``.

    One row per member instead of one list per group.  One group of copies may hold a large part of all rows:
    groups are one row each, so adaptive execution can split the members' side of the join.
    """
    groups = duplicate_groups(rows, content_hash, member)
    return rows.select(content_hash, member).distinct().join(groups, content_hash)
