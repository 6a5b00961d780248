"""Spelling variants, packing and the turn trie against brute force, on odd rows too."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from pagelens.llm import queries
from pagelens.llm.packing import Cuts, WordTokens, candidate_cuts, pack_documents
from pagelens.llm.spelling import group_best, spelling_variants
from pagelens.llm.turn_trie import conversation_trie

SF = "/root/testdata/sf0.001"


# --- spelling -------------------------------------------------------------------------------------
def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    left = defaultdict(set)  # words without one letter: near words share one, or one is the other's
    for w in n:
        for i in range(len(w)):
            left[w[:i] + w[i + 1:]].add(w)
    out = {}
    for w in n:
        maybe = set(left[w]) | {x for i in range(len(w)) for x in left[w[:i] + w[i + 1:]]} | {x for x in (w[:i] + w[i + 1:] for i in range(len(w))) if x in n}
        near = [x for x in maybe if x != w and is_near(x, w)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= 2 * n[w] else None, n[w], len(near))
    rows = []
    for w, (form, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, k, m, n[form] if form else None))
    return sorted(rows, key=str)


def test_op11_words(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op11_spelling(spark, SF).collect()), key=str) == brute_words(docs)


def test_words_of_few_letters_split_their_groups(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.randint(4, 9))) for _ in range(1500)] + ["Aé×÷ÿaa", "aé×÷ÿab"] * 3 + ["x" * 3000 + y for y in "yyyzzzzzz"]
    docs = [(i, " ".join(words[i::40]), "n") for i in range(40)] + [(None, "aabba aabbb ", "x"), (None, None, None), (3, "", ""), (3, "aabba", ""), (3, "aabba", "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n string")
    want = brute_words([d[:2] for d in docs])
    for limit in (1, 8, 8192):
        assert sorted((tuple(r) for r in spelling_variants(df, limit=limit).collect()), key=str) == want
    assert spelling_variants(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        spelling_variants(df, factor=1)


def test_group_best_takes_ties_in_code_point_order():
    assert group_best([("abcda", 9), ("abcdb", 9), ("abcdc", 3), ("abcdea", 9)], 5, 3, 0) == [
        ("abcda", 3, "abcdb", 9), ("abcdb", 2, "abcda", 9), ("abcdea", 1, "abcda", 9), ("abcdc", 2, "abcda", 9)]


# --- packing --------------------------------------------------------------------------------------
ODD = ["don't we'll x's İ. ….a …", "á.b <|endoftext|>.<|startoftext|>x", "日本語です。abc1234 ×÷ ª º.", "\x00\x01 \x1c\x1fa b c",
       "ÀÉ.,;: ß!?' ''t 's", "ΣΑΣ Σ.", "", "\n\n", "x" * 5000, "--- *** ...!", "a b. ", "é.é,è"]


def test_words_have_the_tokenizers_ids(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, words = Tokenizer.from_file(path), WordTokens(path, limit=50)
    texts = ODD + [r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert words.direct
    for at in range(0, len(texts), 7):
        some = texts[at: at + 7]
        ids, n, _ = words.read([t.encode() for t in some], 2)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [whole.encode(t, add_special_tokens=False).ids + [2] for t in some]


def test_cuts_are_optimal():
    rnd = random.Random(1)
    for _ in range(200):
        w = rnd.choice([8, 13, 16])
        free = tuple(1 << k for k in range(5) if 1 << k <= w) if rnd.random() < 0.8 else ()
        pos = np.cumsum([rnd.randint(1, min(w, 5)) for _ in range(rnd.randint(1, 60))])
        pen = np.array([rnd.choice([0, 3, 7]) for _ in pos])
        cuts, got, k = Cuts(w, free, 2), [0], 0
        while k < len(pos):
            m = rnd.randint(1, 9)
            cuts.add(pos[k:k + m], pen[k:k + m])
            k += m
            got += cuts.settle(False)[1:]
        got += cuts.settle(True)[1:]
        price = lambda a, b: (0 if b - a in free else w - b + a) + 2  # noqa: B023, E731
        at, least = [0, *pos.tolist()], [0]
        for j in range(1, len(at)):
            least.append(min(least[i] + price(at[i], at[j]) for i in range(j) if at[j] - at[i] <= w) + int(pen[j - 1]))
        paid = dict(zip(pos.tolist(), pen.tolist(), strict=True))
        assert got[-1] == at[-1] and sum(price(a, b) + paid[b] for a, b in zip(got[:-1], got[1:], strict=True)) == least[-1]


def test_candidate_cuts():
    pos, pen = candidate_cuts(np.array([10, 1, 3]), np.array([4, 10, 12]), 4, 5, 9)
    assert list(zip(pos.tolist(), pen.tolist(), strict=True)) == [(4, 5), (8, 9), (10, 0), (11, 0), (12, 5), (14, 0)]


def check_pieces(docs, pieces, window):
    """Each id in one piece, windows full without gaps; gives the share of padding."""
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = Counter((d, tuple(whole.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in docs)
    windows, order = defaultdict(list), []
    for p in pieces:
        windows[p["sequence_id"]].append(p)
    pad = 0
    for s in sorted(windows):
        at = 0
        for p in sorted(windows[s], key=lambda p: p["offset"]):
            assert p["offset"] == at and 0 < p["length"] == len(p["ids"]) // 4
            at += p["length"]
            order.append(p)
        assert at <= window
        pad += 0 if at & (at - 1) == 0 else window - at
    got, held = Counter(), []
    for p in order:  # pieces of one document follow each other
        assert p["start"] == len(held)
        held += np.frombuffer(p["ids"], "<u4").tolist()
        if len(held) == p["doc_tokens"]:
            got[p["doc_id"], tuple(held)] += 1
            held = []
    assert got == ids and not held
    return pad / sum(len(k[1]) * n for k, n in ids.items())


def test_op12_pieces(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    pieces = pack_documents(docs).collect()
    assert check_pieces(rows, pieces, 4096) < 0.01
    digests = sorted(tuple(r[x] for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")) for r in queries.op12_packing(spark, SF).collect())
    assert digests == sorted((p["doc_id"], p["start"], p["length"], zlib.crc32(p["ids"]), p["doc_tokens"], p["sequence_id"], p["offset"]) for p in pieces)


def test_packing_of_odd_rows(spark):
    rows = [(i, t, 1) for i, t in enumerate(ODD)] + [(None, "a b", 2), (None, None, 3), (1, "x y", None), (1, "x y", None), (2, "word " * 9000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    for parts in (1, 3):
        for window in (64, 4096):
            check_pieces([r[:2] for r in rows], pack_documents(df.repartition(parts), window=window, stride=16).collect(), window)
    assert pack_documents(df.limit(0)).collect() == []
    names = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    assert pack_documents(names).first()["doc_id"] == "a"
    with pytest.raises(ValueError):
        pack_documents(df, window=64)


# --- conversations --------------------------------------------------------------------------------
def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            h = [xxhash.xxh64_intdigest((text or "").encode(), xxhash.xxh64_intdigest((role or "").encode(), xxhash.xxh64_intdigest(int(s).to_bytes(4, "little"), 42))) for s in (1, 2)]
            own[conv].append((turn is not None, turn or 0, *(x - (x >> 63 << 64) for x in h), role or "", text or ""))
    seq = {}
    for conv, x in own.items():
        h, base = zlib.crc32(str(conv).encode()) % 6, sorted(own.get(conv - conv % 100, []))
        seq[conv] = [t[4:] for t in base[:h]] + [t[4:] for t in sorted(x)[h:]]
    members = defaultdict(list)
    for conv in sorted(seq):
        for d in range(len(seq[conv]) + 1):
            members[tuple(seq[conv][:d])].append(conv)
    kids, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(x) for x in m if len(seq[x]) == len(p)).encode()).hexdigest()) for p, m in members.items())


def test_op13_nodes(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op13_turn_trie(spark, SF).collect()) == brute_trie(rows)


@pytest.mark.parametrize(("block", "run"), [(64, 10_000), (2, 3), (3, 7), (1, 5), (4, 1)])
def test_trie_across_blocks_and_runs(spark, block, run):
    rnd, rows = random.Random(5), []
    for conv in range(200):
        same = rnd.choice([0, 1, 2])
        for t in range(rnd.choice([1, 2, 3, 5, 8, 8, 14])):
            rows.append((conv * 3, t if t or conv % 7 else None, rnd.choice(["u", None, "a"]) if t > 2 else "u", rnd.choice(["x", "yy", None]) if t > same else "hi"))
    for conv in (5000, 5001, 5007):
        rows += [(conv, t, "u", f"t{t % 3 if t < 20 else t * conv % 11}") for t in range(43)]
    rows += [(60, 1, "u", "tie"), (60, 1, "u", "tie"), (60, 1, "a", "tie"), (None, 1, "u", "no id"), (7777, None, None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(5)
    assert sorted(tuple(r) for r in conversation_trie(df, block=block, rows_per_run=run).collect()) == brute_trie(rows)


def test_trie_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversation_trie(spark.createDataFrame([], schema)).collect() == []
    assert conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).collect() == []
