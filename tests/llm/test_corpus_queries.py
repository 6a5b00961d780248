"""Registered corpus queries against their SQL; the pipeline stage by stage against brute force."""

from collections import Counter

import corpus_pipeline
import pytest
from check_oracle import compare, duck

from pagelens.llm import quality, queries, simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    assert compare(duck(SF), queries.QUERIES[name](spark, SF), queries.ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.ORACLE.keys()))
def test_query_covers_its_table(spark, name):
    if name in ("op11_spelling", "op12_packing"):  # not a row per document; held against brute force
        return
    table = "pages" if "html" in name else "documents"
    assert queries.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs.collect()]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        out[name] = [tuple(r) for r in docs.collect()]
    keeps = lambda t: not quality._measure(t, *quality._read(t))[-1] and not any(r.rejects(t, *quality._read(t)) for r in quality.RULES)
    good = [r for r in rows if keeps(r[1])]
    assert sorted(out["quality"]) == sorted(good)
    prints = {r[0]: simhash.fingerprint(r[1].encode()) for r in good}
    group = {i: i for i in prints}
    for _ in range(20):
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    single = [r for r in good if group[r[0]] == r[0]]
    assert sorted(out["near_dedup"]) == sorted(single)
    seen, cut = set(), []
    for i, t, lang, source, n in sorted(single):
        w, gone = t.encode().split(), set()
        for s in range(len(w) - 19):
            g = tuple(w[s:s + 20])
            gone.update(range(s, s + 20) if g in seen else ())
            seen.add(g)
        left = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else t
        if left:
            cut.append((i, left, lang, source, len(left)))
    assert sorted(out["substring_dedup"]) == sorted(cut)
    from test_corpus import brute_phrases

    hits = brute_phrases([(r[0], r[1]) for r in cut], items)
    clean = [r for r in cut if not hits[r[0]][1]]
    assert sorted(out["decontaminate"]) == sorted(clean)
    taken = Counter(r[0] for r in out["mix"])
    assert set(taken) <= {r[0] for r in clean} and max(taken.values()) <= 3
    assert set(out["mix"]) <= set(clean)


def test_stages_keep_columns_of_any_name(spark):
    text = " ".join(f"{a} {b} {c}." for a in ("red", "blue", "small", "old") for b in ("house", "river", "bird", "song", "stone") for c in ("sleeps", "moves", "stands"))
    rows = [(i, f"{text} {i}", "en", "web" if i % 2 else None, 9, "KEEP", 7, True) for i in range(4)] + [(9, None, None, None, None, "KEEP", 7, True), (None, "", None, None, 0, "KEEP", 7, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality string, hits int, MIX boolean")
    for name, stage in corpus_pipeline.STAGES:
        if name in ("quality", "decontaminate", "mix"):
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and {(r["quality"], r["hits"], r["MIX"]) for r in out.collect()} == {("KEEP", 7, True)}
            assert stage(spark, docs.limit(0), SF).collect() == []
