"""Language identification by profiles of character trigrams, learned from labelled texts and kept as a table.

Words are lower-cased runs of letters, framed by blanks; every three characters of a framed word count.  A text's score for a
language is the sum over its trigrams of their log probability there, in whole thousandths, so that sums do not depend on
their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_ready

c = F.col
HALF = 0.5  # added to each count, so that a trigram that a language lacks has a probability there too


def _words(text: str) -> Column:
    return F.split(F.regexp_replace(F.lower(F.coalesce(c(text), F.lit(""))), r"[^\p{L}]+", " "), " ")


def _grams(word: Column) -> Column:
    """Trigrams of a word, framed by blanks."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(F.concat(F.lit(" "), word, F.lit(" ")), i, F.lit(3)))


def _cut(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(_grams(c("word"))).alias("gram"))


def trigram_counts(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``<keys>, gram, n``; words are summed before they are cut up."""
    words = texts.select(*keys, F.explode(_words(text)).alias("word")).where(c("word") != "").groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))
    return _cut(words, *keys, "n").groupBy(*keys, "gram").agg(F.sum("n").alias("n"))


def _gained_in_place(texts: DataFrame, above: DataFrame, key: str, scores: list[str], common_words: int) -> DataFrame:
    """``<key>, grams, <scores>``: trigrams of each key and their scores; words and trigrams are looked up, not shuffled."""
    words = texts.select(key, F.explode_outer(F.array_remove(_words("text"), "")).alias("word"))
    often = words.where(c("word").isNotNull()).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(c("n").desc(), "word").limit(common_words)
    known = _cut(often, "word").join(above, "gram", "left").groupBy("word").agg(
        F.count(F.lit(1)).alias("_n"), *[F.coalesce(F.sum(x), F.lit(0)).alias(f"_w{x}") for x in scores])
    rows = words.join(F.broadcast(known), "word", "left")
    rare = F.when(c("_n").isNull(), _grams(c("word")))
    rows = rows.select(key, "_n", *[f"_w{x}" for x in scores], F.explode_outer(rare).alias("gram")).join(above, "gram", "left")
    n = F.when(c("_n").isNotNull(), c("_n")).when(c("gram").isNotNull(), 1).otherwise(0)
    return rows.groupBy(key).agg(F.sum(n).alias("grams"), *[F.sum(F.coalesce(f"_w{x}", x)).alias(x) for x in scores])


def language_profiles(labelled: DataFrame) -> DataFrame:
    """``lang, gram, score`` of ``labelled(lang, text)``; ``gram`` null has the score of a trigram that the language lacks.

    Texts without a language are left out.  A language whose texts have no letters has no profile.
    """
    checkpoint_ready(labelled.sparkSession)
    counts = trigram_counts(labelled.where(c("lang").isNotNull()), ["lang"]).checkpoint()  # read three times
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).withColumn("kinds", counts.agg(F.count_distinct("gram")).scalar())
    score = lambda n: F.round(1000 * F.log((n + HALF) / (c("total") + HALF * c("kinds")))).cast("long")
    known = counts.join(totals, "lang").select("lang", "gram", score(c("n")).alias("score"))
    return known.unionByName(totals.select("lang", F.lit(None).cast("string").alias("gram"), score(F.lit(0)).alias("score")))


def detect_languages(texts: DataFrame, profiles: DataFrame, key: str, *, min_grams: int = 20,
                     broadcast_scores: int = 4_000_000, common_words: int = 200_000) -> DataFrame:
    """``<key>, lang_found`` of each distinct ``key`` of ``texts(<key>, text)``: the most likely language, ties by code.

    Null for texts of fewer than ``min_grams`` trigrams; texts of one key count as one.  Every trigram of every text counts.
    The profiles are stored and turned into one row per trigram with a score per language.  Up to ``broadcast_scores`` scores
    (some 100 MB) every task gets them, so that one row per key and task is shuffled; a longer table is joined by trigram, with
    the trigrams of a key summed before.  The ``common_words`` most frequent words of the texts are scored once and given to
    every task too; only other words are cut up where they stand, and the sums are the same.
    """
    checkpoint_ready(texts.sparkSession)
    stored = profiles.checkpoint()
    floors = {r.lang: r.score for r in stored.where(c("gram").isNull()).select("lang", "score").collect()}  # an entry per language
    langs = sorted(floors)
    # what a trigram scores above the score of trigrams that the language lacks; that part is the same for each of a text's trigrams
    above = stored.where(c("gram").isNotNull()).groupBy("gram").agg(F.count(F.lit(1)).alias("_held"), *[
        F.coalesce(F.sum(F.when(c("lang") == x, c("score") - floors[x])), F.lit(0)).alias(f"_s{i}") for i, x in enumerate(langs)])
    scores = [f"_s{i}" for i in range(len(langs))]
    if above.count() * max(len(langs), 1) <= broadcast_scores:
        gained = _gained_in_place(texts.select(key, "text").where(c(key).isNotNull()), F.broadcast(above), key, scores, common_words)
    else:
        none = texts.select(key, F.lit(None).cast("string").alias("gram"), F.lit(0).alias("n")).distinct()
        counts = trigram_counts(texts.select(key, "text"), [key]).unionByName(none).where(c(key).isNotNull())
        gained = counts.join(above, "gram", "left").groupBy(key).agg(F.sum("n").alias("grams"), *[F.sum(c("n") * c(x)).alias(x) for x in scores])
    ranked = F.array(*[F.struct((-(c("grams") * floors[x] + F.coalesce(c(f"_s{i}"), F.lit(0)))).alias("less"), F.lit(x).alias("lang")) for i, x in enumerate(langs)])
    best = F.when(c("grams") >= min_grams, F.array_min(ranked)["lang"]) if langs else F.lit(None).cast("string")
    return gained.select(key, best.alias("lang_found"))
