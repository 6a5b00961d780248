"""License scans by an exact set-similarity join of text blocks with license templates; DataFrame functions only.

A block is a line, or, as notices are mostly wrapped, a run of neighbouring lines: for each template as many as it takes
when wrapped at ``WRAPPED`` characters, and one more.  Lines of over ``LONGEST`` characters are not wrapped ones and add
nothing to a run.  A short template that names its license (``NAMES``) is only found in blocks that hold the name.

Template tokens are ordered by the number of blocks that hold them, rarest first; all other tokens count as rarer still,
so they never enter a prefix.  A block holds at least ``threshold`` of a template's tokens only if

* it holds as many template tokens as that needs (length filter),
* its prefix and the template's, all but the last needed - 1 tokens of each, share a token (prefix filter), and
* the tokens from the shared one on suffice on both sides (positional filter).

Blocks that pass are verified by their token sets.  The templates are a parameter and small; they are the only literal.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import terms
from .shared import plain, staged

c = F.col
WRAPPED, LONGEST, FEW = 50, 100, 16
NAMES = {"mit": "mit", "apache": "apache", "gpl": "gnu", "cc-by-nc": "nc", "cc-by": "commons", "mpl": "mozilla"}
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices and opening sentences of public licenses.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
)


def _tokens(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall("[0-9a-z]+", text.lower())))


def _span(text: str) -> int:
    return math.ceil(len(text) / WRAPPED) + 1


def blocks(docs: DataFrame, vocabulary: list[str], sets: list[tuple[int, list[str], int]]) -> DataFrame:
    """``doc_id, rid, span, held``: template tokens of each line (``span`` 1), and of each run of ``span`` lines that holds
    enough of a template of that span, as ``sets`` (span, tokens, needed) has them; ``rid`` is a hash of the text."""
    lit = lambda words: F.array(*map(F.lit, words))
    each = F.transform(F.split(plain("text"), "\n"), lambda x: F.struct(
        F.array_intersect(terms(x), lit(vocabulary)).alias("held"), (F.length(x) <= LONGEST).alias("short")))
    lines = docs.select("doc_id", F.xxhash64(plain("text")).alias("rid"), each.alias("lines"))
    lines = lines.select("*", F.transform("lines", lambda x: F.when(x["short"], x["held"]).otherwise(F.array().cast("array<string>"))).alias("short"))

    def runs(span: int) -> Column:
        least = min(needed for n, _, needed in sets if n == span)
        whole = F.transform("short", lambda x, i: F.when(F.size(x) > 0, F.array_distinct(F.flatten(F.slice("short", i + 1, span)))))
        enough = lambda x: F.reduce(F.array(*[F.size(F.array_intersect(x, lit(t))) >= needed for n, t, needed in sets if n == span]), F.lit(False), lambda a, b: a | b)
        return F.transform(F.filter(whole, lambda x: F.when(F.size(x) >= least, enough(x)).otherwise(False)), lambda x: F.struct(F.lit(span).alias("span"), x.alias("held")))

    single = F.transform("lines", lambda x: F.struct(F.lit(1).alias("span"), x["held"].alias("held")))
    all_ = F.concat(single, *[F.when(F.size("short") > 1, runs(n)).otherwise(F.array().cast("array<struct<span:int,held:array<string>>>")) for n in sorted({n for n, _, _ in sets})])
    return lines.select("doc_id", "rid", F.explode(all_).alias("b")).select("doc_id", "rid", "b.span", "b.held").where(F.size("held") > 0)


def template_matches(docs: DataFrame, *, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """``doc_id, rid, label, share``: the best share of each label's templates that one block of the document holds."""
    spark: SparkSession = docs.sparkSession
    sets = [(i, label, _tokens(text)) for i, (label, text) in enumerate(templates)]
    vocabulary = sorted({w for _, _, t in sets for w in t})
    needed = {i: max(1, math.ceil(threshold * len(t) - 1e-9)) for i, _, t in sets}
    least = min(needed.values())
    spans = {i: _span(text) for i, (_, text) in enumerate(templates)}
    held = staged(blocks(docs, vocabulary, [(spans[i], t, needed[i]) for i, _, t in sets]).where(F.size("held") >= least))
    counts = {r["w"]: r["n"] for r in held.where(c("span") == 1).select(F.explode("held").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    ranked = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: k for k, w in enumerate(ranked)}
    name = {i: rank[NAMES[label]] if len(t) <= FEW and NAMES.get(label) in t else None for i, label, t in sets}
    prefixes = [(i, label, rank[w], at, len(t), needed[i], [rank[x] for x in t], spans[i], name[i])
                for i, label, t in sets for at, w in enumerate(sorted(t, key=rank.get)) if at <= len(t) - needed[i]]
    table = F.broadcast(spark.createDataFrame(prefixes, "template int, label string, token int, at int, size int, needed int, tokens array<int>, lines int, name int"))
    order = F.create_map(*[F.lit(x) for w, k in rank.items() for x in (w, k)])
    own = held.select("doc_id", "rid", "span", F.array_sort(F.transform("held", lambda w: F.element_at(order, w))).alias("own")).distinct()
    probe = own.select("doc_id", "rid", "span", "own", F.posexplode(F.slice("own", 1, F.size("own") - least + 1)).alias("own_at", "token"))
    found = probe.join(table, "token").where(
        c("span").isin(1, c("lines")) & (c("name").isNull() | F.array_contains("own", c("name")))
        & (F.size("own") >= c("needed"))  # length
        & (c("own_at") <= F.size("own") - c("needed"))  # prefix
        & (F.least(c("own_at"), c("at")) + F.least(F.size("own") - c("own_at"), c("size") - c("at")) >= c("needed")))  # position
    share = F.size(F.array_intersect("own", "tokens"))
    return found.select("doc_id", "rid", "label", "needed", "size", share.alias("both")).where(c("both") >= c("needed")).groupBy(
        "doc_id", "rid", "label").agg(F.max(c("both") / c("size")).alias("share"))


def phrase_places(words: Column) -> Column:
    """Starts and labels of the base phrases among words, in order."""
    def label_at(i: Column) -> Column:
        tests = [(F.reduce(F.array(*[F.get(words, i + j) == F.lit(w) for j, w in enumerate(p.split())]), F.lit(True),
                           lambda a, b: a & F.coalesce(b, F.lit(False))), label) for p, label in PHRASES.items()]
        out = F.lit(None).cast("string")
        for test, label in tests:
            out = F.when(test, F.lit(label)).otherwise(out)
        return out

    at = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.struct(i.alias("at"), label_at(i).alias("label")))
    return F.filter(at, lambda x: x["label"].isNotNull())


def license_scan(docs: DataFrame, *, templates=TEMPLATES, threshold: float = 0.8, into: str = "license") -> DataFrame:
    """``docs(doc_id, text, ...)`` with a struct ``into(n_words, n_base, first_word, last_word, base_labels, labels, score)``.

    ``base_labels``: of phrases whose words stand consecutively anywhere in the text, lines put aside.  ``labels`` adds
    those of templates of which one line, or a run of wrapped lines, holds ``threshold`` of the tokens; ``score`` is the largest such share (0: none).
    Null and empty texts hold nothing.  Rows of one doc_id and equal text get equal results; a column named like ``into``
    is replaced, others pass through.
    """
    found = template_matches(docs, templates=templates, threshold=threshold).groupBy("doc_id", "rid").agg(
        F.collect_set("label").alias("_labels"), F.max("share").alias("_share")).select(c("doc_id").alias("_doc"), c("rid").alias("_rid"), "_labels", "_share")
    rows = docs.select(F.struct(*[c(f"`{x}`") for x in docs.columns if x != into]).alias("row"))
    rows = rows.join(found, c("row.doc_id").eqNullSafe(c("_doc")) & (F.xxhash64(plain(c("row.text"))) == c("_rid")), "left")
    rows = rows.withColumn("w", terms(c("row.text")))
    none = F.array().cast("array<struct<at:int,label:string>>")
    places = F.when(F.array_contains("w", "license"), phrase_places(c("w"))).otherwise(none)
    rows = rows.withColumn("places", places)
    base = F.array_distinct(F.transform("places", lambda x: x["label"]))
    listed = lambda a: F.array_join(F.array_sort(a), ",")
    return rows.select("row.*", F.struct(
        F.size("w").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"),
        F.get("places", F.lit(0))["at"].cast("long").alias("first_word"),
        F.when(F.size("places") > 0, F.element_at("places", -1)["at"]).cast("long").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.array_union(base, F.coalesce("_labels", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("_share", F.lit(0.0)).alias("score")).alias(into))


def _sql() -> str:
    rows = ", ".join(f"({i}, '{label}', {_tokens(t)!r}, {max(1, math.ceil(0.8 * len(_tokens(t)) - 1e-9))})" for i, (label, t) in enumerate(TEMPLATES))
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
WITH d AS (SELECT doc_id, {low} t, regexp_extract_all({low}, {word}) w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) i FROM d WHERE list_contains(w, 'license')),
h AS (SELECT doc_id, i - 1 AS place, CASE WHEN w[i] = 'mit' AND w[i + 1] = 'license' THEN 'mit' WHEN w[i] = 'apache' AND w[i + 1] = 'license' THEN 'apache'
  WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' END label FROM p),
b AS (SELECT doc_id, count(*) n, min(place) a, max(place) z, string_agg(DISTINCT label, ',' ORDER BY label) labels FROM h WHERE label IS NOT NULL GROUP BY doc_id),
tpl AS (SELECT * FROM (VALUES {rows}) AS v(id, label, tokens, needed)),
l AS (SELECT doc_id, list_distinct(regexp_extract_all(line, {word})) s FROM (SELECT doc_id, unnest(string_split(t, chr(10))) line FROM d)),
m AS (SELECT doc_id, label, max(len(list_intersect(s, tokens))::DOUBLE / len(tokens)) share FROM l JOIN tpl ON len(list_intersect(s, tokens)) >= needed GROUP BY ALL),
al AS (SELECT doc_id, label FROM m UNION SELECT doc_id, label FROM h WHERE label IS NOT NULL),
g AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) labels FROM al GROUP BY doc_id),
sc AS (SELECT doc_id, max(share) score FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(b.n, 0)::BIGINT n_base, b.a::BIGINT first_word, b.z::BIGINT last_word,
  coalesce(b.labels, '') base_labels, coalesce(g.labels, '') labels, coalesce(score, 0.0)::DOUBLE score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN sc USING (doc_id)"""


OP6_SQL = _sql()
