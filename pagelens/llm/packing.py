"""Packing of documents into windows of tokens by order-preserving dynamic programming.

The documents of an input partition form one stream of tokens in stored order.  Windows are cut at document ends, at sentence
or line ends, or, in sentences longer than ``stride`` tokens, at every ``stride``-th token.  The cuts minimise the sum over
windows of padding, a penalty for a cut inside of a document (higher inside of a sentence) and a fixed cost per window.  With
p the token position of a cut, cost(j) = window - p(j) + penalty(j) + least (cost(i) + p(i)) over the cuts i at most a window
before j: a queue kept monotone gives that least value in constant time.  Windows of a length in ``unpadded`` need no padding;
they are a few more transitions per cut.

Only the cuts of the last window can start a later one, so a prefix of the plan is final as soon as the best ways to all of
them share it; it is then given out and its tokens are let go.  The plan is the optimum for the whole partition, while as a
rule a few windows are held.  No rows are shuffled, and a lost task is redone from its own input alone.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections import deque
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import plain, text_pieces

LINE_END = b"\xff"  # stands for a line's end among words; no UTF-8 text holds this byte
PLAIN_WORD = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?]*)")
SENTENCE_END = re.compile(rb"(?:[.!?]|\xe2\x80\xa6)[\"')\]]*\Z")


class WordTokens(dict):
    """Token ids of words between white space, each encoded once; holds at most ``limit`` words.

    Valid for tokenizers that drop white space and never join what it separates.  Letters with stops behind them are encoded
    apart, lower-cased, by the tokenizer's model alone, where that gives what the whole tokenizer does (tried on each letter).
    """

    def __init__(self, path: str, limit: int = 1 << 19):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        letters = [chr(x) for x in (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100))]
        self.bytes = str.maketrans({x: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(x)[0][0] for x in letters})
        self.reset()
        probes = [(x, y) for x in letters for y in {x, x.upper() if len(x.upper()) == 1 and x != "\xff" else x}]
        self.direct = all(self._model(f"{x}b{x}") + self._whole(["."])[0] == self._whole([f"{y}B{y}."])[0] for x, y in probes)

    def reset(self) -> None:
        self.clear()
        self.cores, self.new = {}, []
        self.flat, self.first, self.count, self.ends = (np.empty(0, t) for t in ("<u4", np.int64, np.int64, bool))

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, core: str) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(core.translate(self.bytes))]).tobytes()

    def _core(self, core: bytes) -> bytes:
        self.cores[core] = ids = self._model(core.decode().lower()) if core[0] > 63 else self._whole([core.decode()])[0]
        return ids

    def _learn(self) -> None:
        new, self.new = self.new, []
        split = [PLAIN_WORD.fullmatch(w) if self.direct else None for w in new]
        rest = iter(self._whole([w.decode(errors="replace") for w, m in zip(new, split, strict=True) if not m and w != LINE_END]))
        ids, ends, known = [], np.ones(len(new), bool), self.cores.get
        for i, m in enumerate(split):
            if m:
                core, tail = m[1].lower(), m[2]
                tokens = known(core) or self._core(core)
                ids.append(tokens + (known(tail) or self._core(tail)) if tail else tokens)
                ends[i] = tail and tail[-1] in b".!?"
            elif new[i] == LINE_END:
                ids.append(b"")
            else:
                ids.append(next(rest))
                ends[i] = SENTENCE_END.search(new[i]) is not None
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(ids), "<u4")))
        self.ends = np.concatenate((self.ends, ends))

    def read(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``end_id``; tokens of each text; positions of sentence ends."""
        if len(self) > self.limit:
            self.reset()
        words = [t.replace(b"\n", b" \xff ").split() for t in texts]
        n_words = np.fromiter(map(len, words), np.int64, len(words))
        total = int(n_words.sum())
        number = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, total)
        self._learn()
        count, text = self.count[number], np.repeat(np.arange(len(texts)), n_words)
        before = np.cumsum(count) - count
        ids = self.flat[np.repeat(self.first[number] - before, count) + np.arange(int(count.sum()))]
        per_text = np.bincount(text, count, len(texts)).astype(np.int64)
        ids = np.insert(ids, np.cumsum(per_text), np.uint32(end_id))
        return ids, per_text + 1, (before + count + text)[self.ends[number]]


@functools.lru_cache(maxsize=1)
def _words(path: str) -> WordTokens:
    """One for all tasks of a worker process."""
    return WordTokens(path)


class Cuts:
    """The dynamic programme over cuts; positions count from the stream's start."""

    def __init__(self, window: int, unpadded: tuple[int, ...], per_window: int):
        self.window, self.unpadded, self.per_window = window, np.array(sorted(unpadded), np.int64), per_window
        self.reach = max([window, *unpadded])
        self.pos, self.cost, self.back, self.low = [0], [0], [-1], 0  # cut ``low`` is the first one held, and final
        self.queue = deque([0])

    def add(self, pos: np.ndarray, penalty: np.ndarray) -> None:
        """Further cuts in ascending order, no further apart than a window."""
        low, at, cost, back, queue, window = self.low, self.pos, self.cost, self.back, self.queue, self.window
        held = np.array(at[-self.reach - 1:], np.int64)
        n, every = low + len(at), np.concatenate((held, pos))
        origin = int(every[0])
        place = np.full(int(every[-1]) - origin + 1, -1, np.int64)
        place[every - origin] = np.arange(n - len(held), n + len(pos))
        start = pos[:, None] - self.unpadded - origin
        exact = np.where(start >= 0, place[np.maximum(start, 0)], -1)
        j, k = np.nonzero(exact >= 0)
        from_ = (exact[j, k] - low).tolist()
        edge = np.searchsorted(j, np.arange(len(pos) + 1)).tolist()
        for i, (p, pen) in enumerate(zip(pos.tolist(), penalty.tolist(), strict=True)):
            while at[queue[0] - low] < p - window:
                queue.popleft()
            best = queue[0] - low
            least = cost[best] + at[best] + window - p
            for x in from_[edge[i]:edge[i + 1]]:
                if cost[x] < least:
                    least, best = cost[x], x
            least += pen + self.per_window
            at.append(p)
            cost.append(least)
            back.append(best + low)
            key = least + p
            while queue and cost[queue[-1] - low] + at[queue[-1] - low] >= key:
                queue.pop()
            queue.append(low + len(at) - 1)

    def settle(self, end: bool) -> list[int]:
        """Positions of the cuts that are final now, the last final one before included; the held part then starts at the last."""
        low, n = self.low, self.low + len(self.pos)
        live = {n - 1} if end else {i for i in range(max(low, n - self.reach - 1), n) if self.pos[i - low] >= self.pos[-1] - self.reach}
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(self.back[top - low])
        last = way = live.pop()
        path = []
        while way > low:
            path.append(self.pos[way - low])
            way = self.back[way - low]
        path.append(self.pos[0])
        drop = last - low
        self.pos, self.cost, self.back, self.low = self.pos[drop:], self.cost[drop:], self.back[drop:], last
        while self.queue and self.queue[0] < last:
            self.queue.popleft()
        return path[::-1]


def candidate_cuts(doc_tokens: np.ndarray, sentence_ends: np.ndarray, stride: int, sentence: int, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and penalties of all cuts after the start: document ends, sentence ends, every ``stride`` tokens between."""
    ends = np.cumsum(doc_tokens)
    known = np.unique(np.concatenate((ends, sentence_ends)))
    known = known[known > 0]
    gap = np.diff(known, prepend=0)
    more = (gap - 1) // stride
    step = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
    extra = np.repeat(known - gap, more) + step * stride
    pos = np.concatenate((known, extra))
    penalty = np.concatenate((np.where(np.isin(known, ends), 0, sentence), np.full(len(extra), inside)))
    order = np.argsort(pos, kind="stable")
    return pos[order], penalty[order]


def _pack(path: str | None, end_id: int, window: int, unpadded, stride: int, sentence: int, inside: int, per_window: int, schema: pa.Schema):
    def run(batches):
        where = path
        if where is None:
            import public_tokenizers

            where = public_tokenizers.path("word_bpe_49k.json")
        tokens, cuts = _words(where), Cuts(window, unpadded, per_window)
        task, made = TaskContext.get().partitionId() << 40, 0
        held, origin = np.empty(0, np.uint32), 0  # tokens from the last final cut on
        docs, starts, sizes = [], np.empty(0, np.int64), np.empty(0, np.int64)  # documents not given out to their end
        at = 0

        def give(end: bool):
            nonlocal held, origin, docs, starts, sizes, made
            path = np.array(cuts.settle(end), np.int64)
            if len(path) < 2:
                return
            inner = starts[(starts > path[0]) & (starts < path[-1])]
            edge = np.unique(np.concatenate((path, inner)))
            a, b = edge[:-1], edge[1:]
            of, seq = np.searchsorted(starts, a, side="right") - 1, np.searchsorted(path, a, side="right") - 1
            ids = [held[x:y].tobytes() for x, y in zip((a - origin).tolist(), (b - origin).tolist(), strict=True)]
            for i in range(0, len(a), 4096):
                s = slice(i, i + 4096)
                yield pa.RecordBatch.from_arrays([
                    pa.array([docs[x] for x in of[s].tolist()], schema.field(0).type), pa.array((a - starts[of])[s]), pa.array((b - a)[s]), pa.array(sizes[of][s]),
                    pa.array((task + made + seq)[s]), pa.array((a - path[seq])[s]), pa.array(ids[s], pa.binary())], schema=schema)
            made += len(path) - 1
            held, origin = held[path[-1] - origin:].copy(), int(path[-1])
            done = int(np.searchsorted(starts + sizes, origin, side="right"))
            docs, starts, sizes = docs[done:], starts[done:], sizes[done:]

        for part in text_pieces(batches, 1 << 20, ("text", "doc_id")):
            ids, n, sentence_ends = tokens.read(part["text"], end_id)
            pos, penalty = candidate_cuts(n, sentence_ends, stride, sentence, inside)
            docs += part["doc_id"]
            starts, sizes = np.concatenate((starts, at + np.cumsum(n) - n)), np.concatenate((sizes, n))
            held = np.concatenate((held, ids))
            cuts.add(pos + at, penalty)
            at += int(n.sum())
            yield from give(False)
        yield from give(True)

    return run


def pack_documents(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 2, window: int = 4096, unpadded: tuple[int, ...] | None = None,
                   stride: int = 256, sentence: int = 8, inside: int = 64, per_window: int = 64) -> DataFrame:
    """Pieces of documents in windows: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids``: the piece's token ids, little-endian, 32 bits each; ``start``: the document's ids before it; ``offset``: its place
    in the window ``sequence_id``, without gaps from 0.  Each id lies in exactly one piece.  A window has at most ``window``
    ids; the caller pads it, unless its length is in ``unpadded`` (None: the powers of two up to ``window``).  ``sentence``
    and ``inside`` are the penalties, in tokens of padding, of a cut at a sentence's end and inside of one; ``per_window`` is
    the cost of a window.  ``tokenizer``: a file for the library ``tokenizers`` that drops white space (None: the public one of
    49,408 words and parts, looked up by each worker).

    Null and empty texts are the end id alone.  Equal rows and rows that share an id, or have none, are documents of their
    own.  An empty table gives no rows.  Columns other than ``doc_id`` and ``text`` are not read.  Very long documents are cut
    like others.  Order and ``sequence_id`` follow the stored order within input partitions: deal and sort the documents before for
    another one.
    """
    unpadded = tuple(1 << k for k in range(window.bit_length()) if 1 << k <= window) if unpadded is None else unpadded
    if not 0 < stride <= window or any(not 0 < x <= window for x in unpadded):
        raise ValueError("stride and unpadded lengths must lie between 1 and the window")
    rows = docs.select("doc_id", plain("text").cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [("doc_id", to_arrow_type(rows.schema["doc_id"].dataType)), *[(x, pa.int64()) for x in ("start", "length", "doc_tokens", "sequence_id", "offset")], ("ids", pa.binary())]
    return rows.mapInArrow(_pack(tokenizer, end_id, window, unpadded, stride, sentence, inside, per_window, pa.schema(fields)), schema)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the CRC-32 of the ids in place of them."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
