"""Tokens, n-grams, stems, counts and language guesses as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .exprs import as_col, count_of, rx, rx_all, rx_sub, str_array

TOKEN = r"[\p{L}\p{N}_]{2,}"


def word_count(text) -> Column:
    """White-space separated words."""
    trimmed = F.trim(rx_sub(text, r"\s+", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " "))).cast("bigint")


def squeezed_word_count(text) -> Column:
    """Words of a text whose white space is single blanks only: counted by bytes, without a split."""
    text = as_col(text)
    gaps = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(text == "", F.lit(0)).otherwise(gaps + 1).cast("bigint")


def tokens(text) -> Column:
    return rx_all(F.lower(as_col(text)), TOKEN)


def without_stop_words(toks, stop_words: list[str]) -> Column:
    """Drop stop words inside the row; the list is a bounded parameter, so it is a literal."""
    return F.filter(as_col(toks), lambda t: ~t.isin(stop_words))


def ngrams(toks, n: int) -> Column:
    toks = as_col(toks)
    firsts = F.slice(toks, F.lit(1), F.greatest(F.size(toks) - n + 1, F.lit(0)))
    return F.transform(firsts, lambda t, i: F.concat(t, *[x for k in range(1, n) for x in (F.lit(" "), F.get(toks, i + k))]))


def count_substring(s, part) -> Column:
    """Non-overlapping occurrences."""
    s, part = as_col(s), as_col(part)
    return F.when(part == "", F.lit(0)).otherwise(
        ((F.length(s) - F.length(F.replace(s, part, F.lit("")))) / F.length(part)).cast("int"))


def shorten(s, n: int) -> Column:
    s = as_col(s)
    cut = F.concat(F.rtrim(F.substring(s, 1, n - 3)), F.lit("..."))
    return F.when(F.length(s) <= n, s).otherwise(cut)


def marker_language(text) -> Column:
    """Lithuanian or English by the number of marker strings present."""
    low = F.lower(as_col(text))
    lt, en = count_of(low, fv.LT_MARKERS), count_of(low, fv.EN_MARKERS)
    return F.when(lt > en, F.lit("lt")).when(en > lt, F.lit("en")).otherwise(F.lit("unknown"))


def guess_language(toks) -> Column:
    """Language whose frequent words make up most tokens; ties by code, '' when no word is known.

    The counts are taken inside the row, so no shuffle and no broadcast is needed.
    """
    toks = as_col(toks)

    def score(code: str, words: list[str]) -> Column:
        return F.struct(F.size(F.filter(toks, lambda t: t.isin(words))).alias("n"), F.lit(code).alias("code"))

    scores = [score(code, words) for code, words in sorted(fv.LANGUAGE_WORDS.items())]
    best = F.aggregate(
        F.array(*scores),
        F.struct(F.lit(0).alias("n"), F.lit("").alias("code")),
        lambda a, b: F.when(b["n"] > a["n"], b).otherwise(a),
    )
    return best["code"]


# --- fixed values: suffix tables of the published Porter stemmer ---------------------------------
STEM_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive",
    "biliti": "ble", "logi": "log",
}
STEM_STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEM_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate",
              "iti", "ous", "ive", "ize"]
# Measure patterns of the stemmer: C = run of consonants, V = run of vowels.
M_GT_0 = "^(?:[^aeiouy]+)?[aeiou]+[^aeiouy]+"
M_EQ_1 = "^(?:[^aeiouy]+)?[aeiou]+[^aeiouy]+(?:[aeiou]+)?$"
M_GT_1 = "^(?:[^aeiouy]+)?[aeiou]+[^aeiouy]+[aeiou]+[^aeiouy]+"
HAS_VOWEL = "^(?:[^aeiouy]+)?[aeiouy]"
CVC = "^[^aeiouy]+[aeiouy][^aeiouwxy]$"


def _ending(words) -> str:
    return "^(.+?)(" + "|".join(words) + ")$"


def with_stem(df, word: str, out: str = "stem"):
    """Add the Porter stem of column ``word`` as ``out``.

    Each step is one projection, so the optimizer keeps the steps apart and evaluates each once.  The repair
    of step 1b works on whole words only ("at", "bl", "iz" or a doubled letter), because results follow an
    implementation whose end-anchored patterns are matched from the start of the word.
    """
    w, s = F.col("_w"), F.col("_s")
    df = df.withColumn("_w", F.when(F.startswith(F.col(word), F.lit("y")),
                                    F.concat(F.lit("Y"), F.substring(F.col(word), 2, 10_000)))
                       .otherwise(F.col(word)))

    def drop(n: int) -> Column:
        return F.substring(w, F.lit(1), F.length(w) - n)

    df = df.withColumn("_w", F.when(w.rlike("(?:sses|ies)$"), drop(2)).when(w.rlike("[^s]s$"), drop(1)).otherwise(w))
    # step 1b
    df = df.withColumn("_s", rx(w, "^(.*)(?:ed|ing)$"))
    repaired = (
        F.when(s.isin("at", "bl", "iz"), F.concat(s, F.lit("e")))
        .when((F.length(s) == 2) & (F.substring(s, 1, 1) == F.substring(s, 2, 1)) & s.rlike("^[^aeiouylsz]"),
              F.substring(s, 1, 1))
        .when(s.rlike(CVC), F.concat(s, F.lit("e")))
        .otherwise(s)
    )
    df = df.withColumn("_w", F.when(w.rlike("eed$"), F.when(drop(3).rlike(M_GT_0), drop(1)).otherwise(w))
                       .when(w.rlike("^(.*)(?:ed|ing)$") & s.rlike(HAS_VOWEL), repaired).otherwise(w))
    # step 1c
    df = df.withColumn("_w", F.when(w.rlike("y$") & drop(1).rlike(HAS_VOWEL), F.concat(drop(1), F.lit("i"))).otherwise(w))
    # steps 2 and 3
    for table in (STEM_STEP2, STEM_STEP3):
        pattern = _ending(table)
        df = df.withColumn("_s", rx(w, pattern)).withColumn("_e", rx(w, pattern, 2))
        pairs = [F.lit(x) for kv in table.items() for x in kv]
        new = F.concat(s, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("_e")), F.lit("")))
        df = df.withColumn("_w", F.when((F.col("_e") != "") & s.rlike(M_GT_0), new).otherwise(w))
    # step 4
    p1, p2 = _ending(STEM_STEP4), "^(.+?[st])ion$"
    df = df.withColumn("_s", F.when(w.rlike(p1), rx(w, p1)).otherwise(rx(w, p2)))
    df = df.withColumn("_w", F.when((s != "") & s.rlike(M_GT_1), s).otherwise(w))
    # step 5
    df = df.withColumn("_s", rx(w, "^(.+?)e$"))
    df = df.withColumn("_w", F.when((s != "") & (s.rlike(M_GT_1) | (s.rlike(M_EQ_1) & ~s.rlike(CVC))), s).otherwise(w))
    df = df.withColumn("_w", F.when(w.rlike("ll$") & w.rlike(M_GT_1), drop(1)).otherwise(w))
    lowered = F.when(F.startswith(F.col(word), F.lit("y")), F.concat(F.lit("y"), F.substring(w, 2, 10_000))).otherwise(w)
    return (df.withColumn(out, F.when(F.length(F.col(word)) < 3, F.col(word)).otherwise(lowered))
            .drop("_w", "_s", "_e"))


def capitalised_names(s) -> Column:
    """Runs of capitalised words ("Blue Lamp"), whole words only, one space between the words."""
    spaced = rx_sub(s, r"[^\p{L}\p{N}_\s]", " | ")
    marked = F.transform(F.split(spaced, r"\s+"), lambda w: F.when(w.rlike("^[A-Z][a-z]+$"), w).otherwise(F.lit("|")))
    runs = F.transform(F.split(F.array_join(marked, " "), r"\|"), lambda r: F.trim(r))
    return F.filter(runs, lambda r: r != "")


def acronyms(s) -> Column:
    """Whole words of two or more capital letters."""
    return F.filter(rx_all(s, r"[\p{L}\p{N}_]+"), lambda w: w.rlike("^[A-Z]{2,}$"))


def topic_words(text) -> Column:
    """ASCII words of four letters or more, standing alone among word characters."""
    runs = rx_all(F.lower(as_col(text)), r"[\p{L}\p{N}_]+")
    return F.filter(runs, lambda t: t.rlike("^[a-z]{4,}$"))
