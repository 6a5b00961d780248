"""Benchmark decontamination with a positional inverted index; DataFrame functions only.

The index holds a posting (term, document, position) for each document word that any benchmark item has; it is written
once to the shared folder.  For each window of an item its rarest terms by corpus count are chosen.  Their posting lists,
each adjusted by the term's place in the item, are intersected: places on one diagonal (document position minus item
position) that have all rarest terms of a window are candidates, and the words of the document decide.  Within a band of
diagonals the same terms give proximity matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import plain, staged

c = F.col
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what separates words before capitals are lowered


def raw_terms(text: Column | str = "text") -> Column:
    """Words of a text as an array, capitals as they are: runs of digits, letters and characters beyond ASCII."""
    return F.array_remove(F.split(plain(text), BETWEEN), "")


def terms(text: Column | str = "text") -> Column:
    """Words of a text as an array, A-Z lower-cased."""
    return raw_terms(F.translate(plain(text), UPPER, LOWER))


def lowered(term: Column) -> Column:
    """A-Z lower-cased; most words have none, which the faster full lowering shows."""
    return F.when(F.lower(term) == term, term).otherwise(F.translate(term, UPPER, LOWER))


def _maybe_broadcast(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """``item, item_id, words``; item is a hash of id and text.  Items without words have no window."""
    return items.select(F.xxhash64("item_id", plain("text")).alias("item"), "item_id", terms().alias("words")).where(
        F.size("words") > 0).dropDuplicates(["item"]).withColumn("len", F.least(F.size("words"), F.lit(window)))


def phrase_matches(docs: DataFrame, items: DataFrame, *, window: int = 10, rarest: int = 2, slop: int = 5,
                   max_broadcast_bytes: int = 32 << 20, into: str = "hits") -> DataFrame:
    """``docs`` with a struct ``into(n_words, n_hit, item_ids, near_ids)``.

    An item's windows are all its runs of ``window`` words; an item of fewer, but not none, is one window.  ``n_hit``:
    document words inside an occurrence of a window.  ``item_ids``: items with such an occurrence.  ``near_ids``: items
    with a window whose ``rarest`` rarest terms all stand within ``slop`` words of where one copy of the item would have
    them (exact matches included).  Null texts have no words; items without id mark words but are not listed.  Rows of
    one doc_id and equal text get equal results; a column named like ``into`` is replaced, others pass through.  Item
    tables are broadcast only up to ``max_broadcast_bytes`` of item text, else joined by shuffles.
    """
    small = (items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) <= max_broadcast_bytes
    item = staged(item_windows(items, window))
    placed = item.select("item", "len", F.size("words").alias("n"), F.posexplode("words").alias("q", "term"))
    vocabulary = placed.select(F.xxhash64("term").alias("term")).distinct()
    rows = docs.select("doc_id", F.xxhash64(plain("text")).alias("rid"), F.posexplode(raw_terms()).alias("pos", "term")).select(
        "doc_id", "rid", "pos", F.xxhash64(lowered(c("term"))).alias("term"))
    index = staged(rows.join(_maybe_broadcast(vocabulary, small), "term", "left_semi"))
    counted = index.groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    # windows whose terms all occur; each with the places of its rarest terms
    known = placed.withColumn("term", F.xxhash64("term")).join(counted, "term")
    spread = known.select("item", "len", "n", "q", "term", "cf", F.explode(F.sequence(
        F.greatest(F.lit(0), c("q") - c("len") + 1), F.least("q", c("n") - c("len")))).alias("s"))
    ranked = spread.groupBy("item", "s", "len").agg(F.array_sort(F.collect_list(F.struct("cf", "q", "term"))).alias("by_cf"))
    windows = staged(ranked.where(F.size("by_cf") == c("len")).select("item", "s", F.slice("by_cf", 1, rarest).alias("chosen")))
    lookups = windows.select("item", F.explode("chosen").alias("t")).select("item", "t.q", "t.term").distinct()
    found = index.join(_maybe_broadcast(lookups, small), "term").select("doc_id", "rid", "item", "q", (c("pos") - c("q")).alias("diag"))
    groups = F.transform("chosen", lambda t: t["q"])
    needed = windows.groupBy("item").agg(F.collect_list(F.array_sort(groups)).alias("needed"), F.min(F.size("chosen")).alias("least"))
    needed = _maybe_broadcast(needed, small)

    def complete(found: DataFrame, by: str) -> DataFrame:
        """(document, item, diagonal or band) that has all rarest terms of one of the item's windows."""
        least = found.groupBy("doc_id", "rid", "item", by).agg(F.collect_set("q").alias("has"))
        return least.join(needed, "item").where(F.size("has") >= c("least")).where(
            F.exists("needed", lambda w: F.size(F.array_except(w, "has")) == 0)).select("doc_id", "rid", "item", by)

    exact = complete(found, "diag").join(_maybe_broadcast(item, small), "item")
    band = found.withColumn("band", F.explode(F.array(F.floor(c("diag") / slop), F.floor(c("diag") / slop) - 1)))
    near = complete(band, "band").select("doc_id", "rid", "item").distinct().join(_maybe_broadcast(item.select("item", "item_id"), small), "item")
    exact = exact.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("item_id", "diag", "words", "len")).alias("cands"))
    near = near.groupBy("doc_id", "rid").agg(F.collect_set(c("item_id").cast("string")).alias("near_ids"))
    cands = exact.select("doc_id", "rid", "cands", F.lit(None).cast("array<string>").alias("near_ids")).unionByName(
        near.select("doc_id", "rid", F.lit(None).cast(exact.schema["cands"].dataType).alias("cands"), "near_ids")).groupBy("doc_id", "rid").agg(
        F.first("cands", ignorenulls=True).alias("_cands"), F.first("near_ids", ignorenulls=True).alias("_near")).select(
        c("doc_id").alias("_doc"), c("rid").alias("_rid"), "_cands", "_near")
    base = docs.select(F.struct(*[c(f"`{x}`") for x in docs.columns if x != into]).alias("row"))
    joined = base.join(cands, c("row.doc_id").eqNullSafe(c("_doc")) & (F.xxhash64(plain(c("row.text"))) == c("_rid")), "left")
    joined = joined.withColumn("w", F.when(c("_cands").isNotNull(), terms(c("row.text"))))

    def starts(x: Column) -> Column:
        """First words, in the document, of the item's windows that stand there."""
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(x["words"]) - x["len"]), lambda s: (
            (x["diag"] + s >= 0) & (x["diag"] + s + x["len"] <= F.size("w"))
            & (F.slice("w", F.greatest(x["diag"] + s + 1, F.lit(1)), x["len"]) == F.slice(x["words"], s + 1, x["len"])))), lambda s: x["diag"] + s)

    hits = F.filter(F.transform("_cands", lambda x: F.struct(x["item_id"].alias("item_id"), x["len"].alias("len"), starts(x).alias("at"))), lambda x: F.size(x["at"]) > 0)
    joined = joined.withColumn("hits", hits)
    covered = F.array_distinct(F.flatten(F.flatten(F.transform("hits", lambda x: F.transform(
        x["at"], lambda s: F.sequence(s, s + x["len"] - 1))))))
    return joined.select("row.*", F.struct(
        F.size(raw_terms(c("row.text"))).cast("long").alias("n_words"), F.greatest(F.lit(0), F.coalesce(F.size(covered), F.lit(0))).cast("long").alias("n_hit"),
        F.coalesce(F.array_sort(F.array_distinct(F.filter(F.transform("hits", lambda x: x["item_id"].cast("string")), lambda i: i.isNotNull()))),
                   F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce(F.array_sort("_near"), F.array().cast("array<string>")).alias("near_ids")).alias(into))


OP3_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
iv AS (SELECT item_id, w, least(len(w), 10) n, unnest(range(1, len(w) - least(len(w), 10) + 2)) s FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') t FROM iv),
lens AS (SELECT DISTINCT n FROM win),
dv AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) s FROM dw, lens WHERE len(w) >= n),
hit AS (SELECT v.doc_id, v.s, v.n, x.item_id FROM (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') t FROM dv) v JOIN win x USING (n, t)),
pos AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) n_items, string_agg(i, ',' ORDER BY i) ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR i FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
