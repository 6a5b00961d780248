"""Corpus operators against brute force on small fixtures, and on the edge cases their docstrings name."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from pagelens.llm import decontaminate, html_text, induced, licenses, lm_score, mixing, phrases, quality, simhash, suffixes, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, row string, spans string, quality string, w string"
WORDS = [f"w{i}" for i in range(60)] + ["É", "the", "The", "a|b", "x y"]


def corpus(seed=3, n=60):
    rnd = random.Random(seed)
    passages = [" ".join(rnd.choices(WORDS, k=rnd.randint(15, 70))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(rnd.choices(WORDS, k=rnd.randint(0, 40)))]
        if rnd.random() < 0.6:
            parts.append(rnd.choice(passages))
        if rnd.random() < 0.1:
            parts.append("ha " * 60)
        parts.append("\n".join(rnd.choices(WORDS, k=rnd.randint(0, 8))))
        texts.append(rnd.choice([" ", "\n", "\t "]).join(parts))
    texts += [texts[1], texts[1], texts[2] + " end", None, "", "   ", "ab" * 400, passages[0]]
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", "x", "y", "z", None) for i, t in rows], SCHEMA)


def words(t):
    return (t or "").encode().split()


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeated rows, one id for two texts, no id, a long text."""
    long = " ".join(f"t{i % 977}" for i in range(30_000))
    return frame(spark, [(1, None), (1, "a b c " * 30), (2, "a b c " * 30), (2, "a b c " * 30), (None, "a b c " * 30), (None, None), (7, long), (8, "")])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- 1 --------------------------------------------------------------------------------------------
def test_lm_scores(docs, rows):
    got = by_id(lm_score.lm_scores(docs))
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    tokens = {i: [*words((t or "").encode().lower().decode()), None] for i, t in rows}
    c = Counter(w for i, ts in tokens.items() if not held[i] for w in ts)
    n, v = sum(c.values()), len(c)
    for i, ts in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ts), sum(c[w] > 0 for w in ts), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in ts), rel_tol=1e-9)
        assert r["score"] <= 0
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_lm_filter_counts():
    """What the filter gives back is the middle of the true count's range, but for rare false positives."""
    from pagelens.llm.shared import Filter, bloom_make, size_bits

    rng = np.random.default_rng(1)
    h, fp = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(0, 1 << 31, 5000).astype(np.uint32)
    n = rng.integers(1, 200, 5000)
    level = 1 + np.floor(np.log2(n)).astype(int)
    keys = np.concatenate([lm_score._level_keys(h[level >= j], fp[level >= j], j) for j in range(1, level.max() + 1)])
    f = Filter({0: bloom_make(keys, size_bits(len(keys), 12), 5)}, 1, 5)
    want = (3 * 2.0 ** (level - 1) - 1) / 2
    assert (lm_score._probe(f, h, fp, 20) == want).mean() > 0.98
    assert (lm_score._probe(f, h + np.uint64(1), fp, 20) > 0).mean() < 0.02


def test_lm_edges(odd, empty):
    assert lm_score.lm_scores(odd, max_filter_bytes=64).count() == 8
    assert lm_score.lm_scores(empty).count() == 0


@pytest.mark.parametrize("max_filter_bytes", [256 << 20, 2000])
def test_lm_scores_against_exact_pair_counts(docs, rows, odd, max_filter_bytes):
    """The error rate of the filter stays the same where it takes several passes."""
    got = by_id(lm_score.lm_scores(docs, block_bytes=2000, max_filter_bytes=max_filter_bytes))
    tokens = {i: ["start ", *(t or "").encode().lower().split(), "end "] for i, t in rows}
    train = [ts for i, ts in tokens.items() if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for ts in train for w in ts[1:]) + Counter({"start ": len(train)})
    pairs = Counter(x for ts in train for x in zip(ts, ts[1:], strict=False))
    n, v, follow = sum(c.values()) - len(train), len(c) - 1, Counter(h for h, _ in pairs)
    off, total = 0.0, 0
    for i, ts in tokens.items():
        want = 0.0
        for h, w in zip(ts, ts[1:], strict=False):
            p0 = (c[w] + .1) / (n + .1 * (v + 1))
            seen = min((3 * 2 ** (pairs[h, w].bit_length() - 1) - 1) / 2 if pairs[h, w] else 0, c[h], c[w])
            want += math.log10((seen + follow[h] * p0) / (c[h] + follow[h]) if c[h] else p0)
        off, total = off + abs(got[i]["score"] - want), total + len(ts) - 1
    assert len(got) == len(rows) and off / total < 0.01
    many = lm_score.lm_scores(odd, block_bytes=20_000, max_filter_bytes=max_filter_bytes)
    key = lambda r: tuple((x is not None, x) for x in r[:5])
    a, b = (sorted(df.collect(), key=key) for df in (many, lm_score.lm_scores(odd, block_bytes=20_000)))
    assert [r[:6] for r in a] == [r[:6] for r in b] and all(math.isclose(x["score"], y["score"], rel_tol=1e-9) for x, y in zip(a, b, strict=True))


# --- 2 --------------------------------------------------------------------------------------------
def test_quality(docs, rows, odd, empty):
    got = by_id(quality.quality_rules(docs, into="q").select("doc_id", "q.*"))
    for i, t in rows:
        w, r = words(t), got[i]
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {j + d for j, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for d in range(3)}
        lines = [x for x in (t or "").encode().split(b"\n") if x.split()]
        assert (r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), len(hit), len(lines) - len(set(lines)))
        assert r["word_chars"] == sum(len(x.decode()) for x in w)
        assert not (r["kept"] and r["base_failed"])
    assert quality.quality_rules(odd).count() == 8 and quality.quality_rules(empty).count() == 0


def test_rule_order_changes_no_verdict(docs):
    kept = [sorted(r[0] for r in quality.quality_rules(docs, rules=x, into="q").where("q.kept").select("doc_id").collect())
            for x in (quality.RULES, quality.RULES[::-1])]
    assert kept[0] == kept[1]
    costly = quality.Rule("never", lambda t, w, l: sum(range(20000)) < 0)
    cheap = quality.Rule("half", lambda t, w, l: len(w) % 2 == 0)
    assert [r.name for r, _, _ in quality.order_rules(["a b", "a b c"] * 20, (costly, cheap))] == ["half", "never"]


# --- 3 --------------------------------------------------------------------------------------------
def brute_phrases(rows, items, window=10):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: "".join(c if ord(c) > 127 or c.isalnum() else " " for c in low(t)).split(" ")
    clean = lambda t: [x for x in split(t) if x]
    out = {}
    for i, t in rows:
        w, hit, ids = clean(t), set(), set()
        for item, text in items:
            x = clean(text)
            n = min(window, len(x))
            for s in range(len(x) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == x[s:s + n]:
                        hit.update(range(p, p + n))
                        ids.add(str(item))
        out[i] = (len(w), len(hit), sorted(ids - {"None"}))
    return out


@pytest.mark.parametrize("limit", [32 << 20, -1])
def test_phrase_matches(spark, docs, rows, limit):
    items = [(0, rows[3][1]), (1, "W3, the"), (2, None), (3, ""), (None, "w7"), (5, " ".join(WORDS[:14])), (6, (rows[8][1] or "x") + " zz"), (3, "w1 w2")]
    found = decontaminate.phrase_matches(docs, spark.createDataFrame(items, "item_id long, text string"), max_broadcast_bytes=limit, into="h")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in found.select("doc_id", "h.*").collect()}
    assert got == brute_phrases(rows, items)
    assert all(set(r["item_ids"]) <= set(r["near_ids"]) for r in found.select("h.*").collect())


def test_phrase_edges(spark, odd, empty):
    items = spark.createDataFrame([(1, "a b c a b c a b c a b c")], "item_id long, text string")
    got = decontaminate.phrase_matches(odd, items, into="h").select("doc_id", "h.n_hit").collect()
    assert len(got) == 8 and sum(r["n_hit"] == 90 for r in got) == 4
    assert decontaminate.phrase_matches(odd, items.where("false")).count() == 8
    assert decontaminate.phrase_matches(empty, items).count() == 0


# --- 4 --------------------------------------------------------------------------------------------
def test_targets(spark):
    rnd = random.Random(2)
    for k in range(5):
        sizes = {f"s{i}": rnd.choice([0, 3, 50, 1000, 20000]) for i in range(rnd.randint(1, 9))} | ({None: 77} if k % 2 else {})
        order = sorted(x for x in sizes if x is not None) + ([None] if None in sizes else [])
        weight = {x: (5, 2, 1)[i % 3] for i, x in enumerate(order)}
        target, full, total = dict.fromkeys(order, 0.0), set(), sum(sizes.values())
        while True:
            rest = total - sum(3 * sizes[x] for x in full)
            w = sum(weight[x] for x in order if x not in full)
            target = {x: 3.0 * sizes[x] if x in full else rest * weight[x] / w for x in order}
            over = {x for x in order if target[x] > 3 * sizes[x] and x not in full}
            if not over:
                break
            full |= over
        got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        assert {r["source"]: round(r["target"], 6) for r in got} == {x: round(t, 6) for x, t in target.items()}


def test_mix(spark, odd, empty):
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.choice([1, 5, 40, 300])), "en", rnd.choice(["a", "b", "b", "b", "c", None]), "x", "y", "z", None) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix_sources(docs).select("source", "mix.*").collect()
    assert max(r["copies"] for r in got) <= 3
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= 0.02 * own[0]["target"] + 300
    assert mixing.emit(mixing.mix_sources(docs)).count() == sum(r["copies"] for r in got)
    assert mixing.emit(mixing.mix_sources(docs)).columns == docs.columns
    assert mixing.mix_sources(odd).count() == 8 and mixing.mix_sources(empty).count() == 0


# --- 5 --------------------------------------------------------------------------------------------
def test_fingerprint():
    for t in (b"", b" \n", b"One", b"a B", b"a b c", b"x y z x y z q", b"w " * 20000):
        w = t.lower().split()
        s = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [4096, 3])
def test_links(spark, bucket):
    rnd = random.Random(5)
    prints = {rnd.getrandbits(64) for _ in range(200)}
    for p in list(prints)[:30]:
        for _ in range(rnd.randint(1, 6)):
            for _ in range(rnd.randint(1, 4)):
                p ^= 1 << rnd.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    group = {p: p for p in prints}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 3:
                group[root(a)] = root(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    from pagelens.llm.components import components

    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = {r["a"]: r["b"] for r in components(simhash.close_links(df, bucket)).collect()}
    mine = {signed(p): found.get(signed(p), signed(p)) for p in prints}
    want = {}
    for p in prints:
        want.setdefault(root(p), []).append(signed(p))
    assert sorted(map(sorted, want.values())) == sorted(sorted(k for k in mine if mine[k] == r) for r in set(mine.values()))
    assert all(r == min(k for k in mine if mine[k] == r) for r in set(mine.values()))


def test_near_duplicates(docs, odd, empty):
    got = by_id(simhash.near_duplicates(docs))
    assert got[60]["component_id"] == got[61]["component_id"] == got[1]["component_id"] == 1
    assert got[63]["component_id"] == got[64]["component_id"] == got[65]["component_id"] == 63 and got[63]["fp"] == 0
    assert simhash.near_duplicates(odd).count() == 8 and simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns
    assert {60, 61, 64, 65}.isdisjoint(r["doc_id"] for r in simhash.keep_one(docs).collect())


def test_keep_one_row_per_group(spark, odd):
    """No id, one id for two texts, repeated rows: one row of each group stays, and no other group loses its rows."""
    def kept(rows):
        return sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(frame(spark, rows)).collect()), key=str)

    a, b, d = ("a b c " * 30, "one clean text of its own", "another text that stands alone")
    assert kept([(1, a), (None, a), (None, b), (5, d)]) == sorted([(1, a), (None, b), (5, d)], key=str)
    assert kept([(1, a), (3, a), (3, b)]) == [(1, a), (3, b)]
    assert kept([(1, a), (1, a), (2, b), (2, b), (2, b)]) == [(1, a), (2, b)]
    assert kept([(None, a)] * 4 + [(None, b)]) == sorted([(None, a), (None, b)], key=str)
    assert len(kept([(1, None), (1, ""), (None, None)])) == 1
    assert simhash.keep_one(odd).count() == 3


# --- 6 --------------------------------------------------------------------------------------------
def test_licenses(spark, odd, empty):
    texts = ["Released under the MIT License.", "x\nthe MIT\nLicense and mit license", "released under terms: the MIT License here", None, "",
             "This work is licensed under the GNU General Public License, version 3.", "License", "permission is hereby"]
    got = by_id(licenses.license_scan(frame(spark, list(enumerate(texts)))).select("doc_id", "license.*"))
    assert [got[i]["n_base"] for i in range(8)] == [1, 2, 1, 0, 0, 1, 0, 0]
    assert (got[1]["first_word"], got[1]["last_word"], got[1]["score"], got[1]["labels"]) == (2, 5, 0.0, "mit")
    assert got[0]["score"] == 1.0 and got[2]["score"] == 1.0 and got[5]["labels"] == "gpl" and got[4]["first_word"] is None
    assert licenses.license_scan(odd).count() == 8 and licenses.license_scan(empty).count() == 0


def test_wrapped_licenses(spark):
    """Each notice, hard-wrapped with and without comment marks, is found; a short notice needs its license's name."""
    import textwrap

    notices = [(label, f"First line.\n\n{textwrap.fill(text, width, initial_indent=m, subsequent_indent=m)}\n\nLast line.")
               for label, text in licenses.TEMPLATES for width in (60, 72, 80) for m in ("", " * ")]
    other = ["Released under the BSD License.", "Licensed under CC BY 4.0.", "Released\n\n\n\nunder\n\n\n\nthe\n\n\n\nMIT"]
    rows = list(enumerate([t for _, t in notices] + other))
    got = by_id(licenses.license_scan(frame(spark, rows)).select("doc_id", "license.*"))
    for i, (label, text) in enumerate(notices):
        assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0, text
    assert [(got[i]["labels"], got[i]["score"]) for i in range(len(notices), len(rows))] == [("", 0.0)] * 3


# --- 7 --------------------------------------------------------------------------------------------
def test_url_filter(spark):
    e = [("spam", "bad.com", "add", "2024-01-10"), ("spam", "bad.com", "remove", "2024-03-01"), ("allow", "ok.bad.com", "add", "2024-02-01"),
         ("adult", "x.org/a", "add", "2024-01-01"), ("spam", "x.org", "remove", "2024-01-01"), (None, "x.org", "add", "2024-01-01"),
         ("spam", "tie.net", "add", "2024-01-05"), ("spam", "tie.net", "remove", "2024-01-05")]
    entries = spark.createDataFrame(e, "list string, pattern string, change string, changed_at string").withColumn("changed_at", F.to_timestamp("changed_at"))
    u = [(1, "http://www.bad.com/p", "2024-01-09"), (2, "http://www.bad.com/p", "2024-01-10"), (3, "http://sub.bad.com", "2024-02-29"),
         (4, "http://bad.com/", "2024-03-01"), (5, "https://ok.bad.com/", "2024-02-10"), (6, "http://x.org/a/b", "2024-05-01"), (7, "http://x.org/b", "2024-05-01"),
         (8, None, "2024-02-01"), (9, "no url", "2024-02-01"), (10, "http://bad.com/", None), (11, "http://tie.net", "2024-02-01"), (11, "http://tie.net", "2024-02-01")]
    shots = spark.createDataFrame(u, "page_id long, url string, fetched_at string").withColumn("fetched_at", F.to_timestamp("fetched_at"))
    got = {r["page_id"]: (r["lists"], r["blocked"]) for r in url_filter.filter_urls(shots, entries).collect()}
    none = ("", False)
    assert got == {1: none, 2: ("spam", True), 3: ("spam", True), 4: none, 5: ("allow,spam", False), 6: ("adult", True), 7: none, 8: none, 9: none, 10: none, 11: none}
    deep = entries.limit(0).unionByName(entries.where("pattern = 'x.org/a'").withColumn("pattern", F.lit("x.org/a/b/c/d")))
    paths = spark.createDataFrame([(1, "http://x.org/a/b/c/d/e?q"), (2, "http://x.org/a/b/c"), (3, "http://x.org//a/b/c/d"), (4, "http://x.org")], "page_id long, url string")
    paths = paths.withColumn("fetched_at", F.lit("2024-05-01").cast("timestamp")).withColumn("lists", F.lit("clash"))
    assert {r["page_id"]: r["patterns"] for r in url_filter.filter_urls(paths, deep).collect()} == {1: "x.org/a/b/c/d", 2: "", 3: "x.org/a/b/c/d", 4: ""}
    hosts = entries.where("pattern = 'bad.com' and change = 'add'")
    assert url_filter.filter_urls(shots, hosts).where("blocked").count() == 4
    assert url_filter.filter_urls(shots.where("false"), entries).count() == 0
    assert url_filter.filter_urls(shots, entries.where("false")).where("blocked").count() == 0


# --- 8 and 9 --------------------------------------------------------------------------------------
def brute_words(rows, window):
    seen, gone = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        out = set()
        for s in range(len(w) - window + 1):
            g = tuple(w[s:s + window])
            if g in seen:
                out.update(range(s, s + window))
            seen.add(g)
        gone[i] = (len(w), len(out), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in out)).hexdigest())
    return gone


@pytest.mark.parametrize("hot", [100_000, 1])
def test_phrases(docs, rows, hot):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in phrases.phrase_digest(docs, hot=hot).collect()}
    assert got == brute_words(rows, 20)


def test_phrases_of_other_length(docs, rows):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in phrases.phrase_digest(docs, window=9, shard_bytes=2000).collect()}
    assert got == brute_words(rows, 9)


@pytest.mark.parametrize("hot", [100_000, 1])
def test_suffixes(docs, rows, hot):
    n = Counter()
    for _, t in rows:
        b = (t or "").encode()
        n.update(b[i:i + 60] for i in range(len(b) - 59))
    got = by_id(suffixes.suffix_digest(docs, window=60, hot=hot, shard_bytes=3000, memory_bytes=500))
    for i, t in rows:
        b = (t or "").encode()
        out = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 59):
            if n[b[s:s + 60]] > 1:
                out[s:s + 60] = True
        kept = bytes(x for x, g in zip(b, out) if not g)
        runs = int((out[1:] & ~out[:-1]).sum() + out[0])
        assert tuple(got[i])[1:] == (len(b), int(out.sum()), runs, hashlib.sha256(kept).hexdigest())


def test_repeat_edges(odd, empty, docs):
    assert phrases.phrase_digest(odd).count() == 8 and phrases.phrase_digest(empty).count() == 0
    assert suffixes.suffix_digest(odd, window=50).count() == 8 and suffixes.suffix_digest(empty).count() == 0
    cut = phrases.without_phrases(docs)
    assert cut.columns == docs.columns and by_id(cut)[60]["text"] == ""


def test_induced_sorting():
    rnd = random.Random(6)
    for _ in range(120):
        x = [rnd.randint(1, rnd.choice([1, 2, 4, 200])) for _ in range(rnd.randint(1, 150))]
        x += x[: rnd.randint(0, len(x))]
        w, t = rnd.choice([1, 3, 8, 30]), np.array([*x, 0], np.uint16)
        n = Counter(tuple(x[i:i + w]) for i in range(len(x) - w + 1))
        got = induced.repeated_windows(t, w, rnd.choice([40, 1 << 20]))
        assert got[: max(0, len(x) - w + 1)].tolist() == [n[tuple(x[i:i + w])] > 1 for i in range(len(x) - w + 1)]


def test_long_runs_of_one_symbol():
    t = np.concatenate((np.full(300_000, 50), np.arange(2, 200), np.full(150_000, 50), [0])).astype(np.uint16)
    assert induced.repeated_windows(t, 200).sum() == 300_000 - 199 + 150_000 - 199


def test_phrases_of_one_key_with_many_words(spark):
    """Stretches that share one phrase; all other words are their own, and codes of words are two characters wide."""
    common = "least of all six words here"
    texts = [f"{' '.join(f'a{i}x{k}' for k in range(14))} {common} {' '.join(f'b{i}x{k}' for k in range(14))}" for i in range(300)]
    texts += [texts[5], texts[7][20:], f"{texts[9]} and more of it"]
    df = pd.DataFrame([(1, i, 1, i, 0, 0, t.encode()) for i, t in enumerate(texts)], columns=["key", "same", "n", "doc", "rid", "start", "text"])
    narrow, wide = (phrases._locate(20, 1 << 14, one)(df) for one in (phrases.ONE, 10))
    assert narrow.sort_values(list(narrow.columns)).values.tolist() == wide.sort_values(list(wide.columns)).values.tolist()
    assert {5, 300, 7, 301, 9, 302} == set(narrow["doc"])


# --- 10 -------------------------------------------------------------------------------------------
@pytest.mark.parametrize("html, text", [
    ("", ""), ("plain &amp; text", "plain & text"),
    ("<p>one<p>two", "one\n\ntwo"), ("<ul><li>a<li>b<ol><li>c<li>d</ol></ul>", "- a\n- b\n  1. c\n  2. d"),
    ("<div>a</div><div>b <b>c</b></div>", "a\nb c"), ("<pre>x\n  y</pre>", "x\n  y"),
    ("<table><tr><th>Name<th>N<tr><td>long name<td>1</table>", "Name       N\nlong name  1"),
    ("<p hidden>no</p><p style='display: none'>no</p>yes<script>no</script><!-- no -->", "yes"),
    ("<head><title>t</title></head><body>b<br>c</body>", "b\nc"), ("a<hr>b", "a\n\n---\n\nb"), ("<dl><dt>k<dd>v</dl>", "k\n  v"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<table>" * 60 + "in" + "</table>" * 60, "in"), ("</p></div>x<", "x<")])
def test_page_text(html, text):
    assert html_text.page_text(html) == text


@pytest.mark.parametrize("html, text", [
    ('<ol start="--5"><li>a</ol>', "1. a"), ('<ol start="-2"><li>a<li>b</ol>', "-2. a\n-1. b"), (f"<table><tr><td colspan={'9' * 5000}>x</table>", "x"),
    ("<![>x", "x"), ("<![x y z>q", "q"), ("a<![CDATA[x]]>b", "ab"), ("<!>y", "y"), ("<![if IE]>k<![endif]>", "k"),
    ('<a><svg class="icon"/> Label</a> after', "Label after"), ("<svg><path/><text>no</text></svg><math/>k", "k"), ("<p/>x<p>y", "x\n\ny"),
    ('<div style="visibility:hidden">no <b style="visibility: visible">yes</b> no</div>', "yes"),
    ('<ul style="visibility:hidden"><li>a<li style="color:red;visibility:visible">b</ul>', "- b"), ('<hr style="visibility:hidden">t', "t")])
def test_broken_and_hidden_markup(html, text):
    assert html_text.page_text(html) == text


def test_mutated_pages_are_read(spark):
    rnd = random.Random(1)
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    bits = ["<![", "<!", "<?", "</", "<a ", '="', ">", "\x00", "<svg/>", "<table>", "<td colspan=", "&#x110000;", "&#99999999999;", "<ol start=-", "--", "<script>",
            "<textarea>", "<plaintext>", "<title>"]
    for _ in range(1500):
        h = rnd.choice(pages)
        for _ in range(rnd.randint(1, 6)):
            i = rnd.randrange(len(h) + 1)
            h = h[:i] + rnd.choice(bits) + h[i + rnd.randint(0, 40):]
        assert isinstance(html_text.page_text(h[: rnd.randrange(len(h) + 1)] if rnd.random() < 0.3 else h), str)


def test_extract_pages(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "<p>x")], "page_id long, html string")
    assert sorted(r["page_text"] for r in html_text.extract_pages(df).collect()) == ["", "", "x"]
    assert html_text.extract_pages(df.where("false")).count() == 0
