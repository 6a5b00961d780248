"""External induced sorting of suffixes with common-prefix lengths.

Suffixes that are smaller than their right neighbour on the left of a larger one (LMS) are sorted first, on the reduced
string of their substrings' names.  All others are induced: a scan in sorted order puts each suffix's left neighbour into
the queue of its first symbol, first all larger-to-smaller suffixes upwards, then all others downwards.  Queues are taken
in symbol order, first in first out, and go to disk beyond ``memory_bytes``; each tuple carries the suffix and its common
prefix with the tuple before it, which is one more than the least common prefix passed since.  A whole bucket is taken as
numpy arrays at a time.

Common prefixes count up to ``depth``; suffixes equal that far may stand in any order.  So the suffixes of a run of one symbol
that start with ``depth`` times that symbol are taken in one step, however long the run is.
"""

from __future__ import annotations

import tempfile

import numpy as np


class Queues:
    """First-in-first-out tuples (suffix, common prefix) per symbol, in memory or on disk."""

    def __init__(self, memory_bytes: int):
        self.memory_bytes, self.held = memory_bytes, 0
        self.chunks: dict[int, list] = {}
        self.file = None

    def put(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.chunks.setdefault(symbol, []).append((pos.astype(np.int64), lcp.astype(np.int32)))
        self.held += 12 * len(pos)
        if self.held > self.memory_bytes:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for chunks in self.chunks.values():
            for i, chunk in enumerate(chunks):
                if isinstance(chunk[0], np.ndarray):
                    at = self.file.tell()
                    self.file.write(chunk[0].tobytes() + chunk[1].tobytes())
                    chunks[i] = (at, len(chunk[0]))
        self.held = 0

    def take(self, symbol: int):
        """The chunks of a symbol, oldest first; what is put meanwhile comes too."""
        while chunks := self.chunks.get(symbol):
            pos, lcp = chunks.pop(0)
            if isinstance(pos, int):
                self.file.seek(pos)
                n = lcp
                pos, lcp = np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(4 * n), np.int32)
            else:
                self.held -= 12 * len(pos)
            yield pos, lcp

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Carry:
    """Least common prefix since each symbol's queue was last put to."""

    def __init__(self, symbols: int, depth: int):
        self.least, self.used, self.depth = np.full(symbols, depth, np.int32), np.zeros(symbols, bool), depth

    def induce(self, queues: Queues, pos: np.ndarray, lcp: np.ndarray, target: np.ndarray) -> None:
        """Puts ``pos - 1`` into the queues of ``target`` (-1: none), the scan having passed tuples with ``lcp``."""
        order = np.argsort(target, kind="stable")
        sorted_target = target[order].astype(np.int64)
        at = np.searchsorted(sorted_target, 0)
        through = int(lcp.min())
        seen = []
        while at < len(order):
            d = int(sorted_target[at])
            to = int(np.searchsorted(sorted_target, d, side="right"))
            i = order[at:to]
            cut = np.concatenate(([0], i + 1))
            tail = cut[-1] < len(lcp)
            low = np.minimum.reduceat(lcp, cut if tail else cut[:-1])
            new = low[: len(i)].copy()
            new[0] = min(int(new[0]), int(self.least[d]))
            new = np.minimum(new + 1, self.depth)
            if not self.used[d]:
                new[0] = 0
            queues.put(d, pos[i] - 1, new)
            seen.append((d, int(low[-1]) if tail else self.depth))
            at = to
        self.least = np.minimum(self.least, through)
        for d, rest in seen:
            self.used[d], self.least[d] = True, rest


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next (the last suffix is)."""
    n = len(t)
    sign = np.ones(n, np.int8)
    sign[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1])
    at = np.where(sign != 0, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return sign[at] > 0


def _common(t: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of pairs of different suffixes, up to ``depth``; six symbols of up to 10 bits are compared at a time."""
    n = len(t)
    far = np.concatenate((t, np.zeros(6, t.dtype))).astype(np.int64)  # the last symbol is unique, so nothing is equal beyond it
    six = far[:n].copy()
    for j in range(1, 6):
        six |= far[j: n + j] << (10 * j)
    out, left, d = np.full(len(a), depth, np.int32), np.arange(len(a)), 0
    while d < depth and len(left):
        x = six[a[left] + d] ^ six[b[left] + d]
        stop = x != 0
        low = x[stop] & -x[stop]  # the lowest bit that differs tells the symbol
        out[left[stop]] = np.minimum(d + (np.frexp(low.astype(np.float64))[1] - 1) // 10, depth)
        left = left[~stop]
        d += 6
    return out


def _sorted_lms(t: np.ndarray, small: np.ndarray, lms: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """LMS suffixes in order to ``depth`` symbols, with common prefixes; names of ever longer runs of LMS substrings."""
    m = len(lms)
    length = np.diff(lms, append=len(t)) + 1  # a substring holds the next LMS symbol too
    ids = np.zeros(m, np.int64)
    live = np.arange(m)
    # names of the substrings, six symbols at a time; of equal symbols the one before a smaller one comes first
    code = 2 * t.astype(np.int64) + small + 1
    d = 0
    while len(live):
        part = np.zeros(m, np.int64)
        for j in range(6):
            at = lms + d + j
            inside = d + j < length
            part = part * 1024 + np.where(inside & (at < len(t)), code[np.minimum(at, len(t) - 1)], 0)
        _, low = np.unique(part, return_inverse=True)
        _, ids = np.unique(ids * (int(low.max()) + 1) + low, return_inverse=True)
        d += 6
        live = live[length[live] > d]
        if d >= depth:
            break
    count = np.bincount(ids)
    rank = (np.cumsum(count) - count)[ids]  # place of the first of its equals
    live, step = np.flatnonzero(count[ids] > 1), 1
    while step < depth and len(live):
        nxt = np.where(live + step < m, rank[np.minimum(live + step, m - 1)] + 1, 0)
        key = rank[live] * (m + 2) + nxt
        by = np.argsort(key, kind="stable")
        live, key, old = live[by], key[by], rank[live[by]]
        i = np.arange(len(live))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), i, 0))
        start = np.maximum.accumulate(np.where(new, i, 0))
        rank[live] = old + start - group
        at = np.flatnonzero(new)
        live = live[np.repeat(np.diff(at, append=len(live)) > 1, np.diff(at, append=len(live)))]
        step *= 2
    order = lms[np.argsort(rank, kind="stable")]
    lcp = np.zeros(m, np.int32)
    lcp[1:] = _common(t, order[1:], order[:-1], depth)
    return order, lcp


def sorted_suffixes(t: np.ndarray, depth: int, memory_bytes: int = 64 << 20):
    """Blocks (suffixes in ascending order, common prefix of each with the one before it in the same block list).

    ``t``: small integers, the last one 0 and unique.  A bucket's upward part comes first, its downward part after it in
    descending order; ``_part`` tells which: yields (symbol, "up" | "down", suffixes, common prefixes).
    """
    n, symbols = len(t), int(t.max()) + 1
    kind = np.int16 if symbols < 1 << 15 else np.int64
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order, order_lcp = _sorted_lms(t, small, lms, depth)
    first = np.searchsorted(t[order], np.arange(symbols + 1))
    same = np.flatnonzero(np.concatenate((t[1:] != t[:-1], [True])))  # ends of runs of one symbol
    run_left = lambda p: same[np.searchsorted(same, p)] - p + 1
    seam = lambda p, q: min(int(run_left(p)), int(run_left(q)), depth)
    up, carry, parts = Queues(memory_bytes), _Carry(symbols, depth), Queues(memory_bytes)

    def targets(pos: np.ndarray, want_small: bool) -> np.ndarray:
        left = np.maximum(pos - 1, 0)
        ok = (pos > 0) & (small[left] == want_small)
        return np.where(ok, t[left], -1).astype(kind)

    def with_runs(s: int, pos: np.ndarray, lcp: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes that start with ``depth`` times ``s`` are equal that far, so the rest of their run follows in one step."""
        far = pos + depth - 1
        maybe = np.flatnonzero((far < n) & (target == s))
        maybe = maybe[t[far[maybe]] == s]
        run = np.searchsorted(same, pos[maybe])
        maybe, run = maybe[same[run] >= far[maybe]], run[same[run] >= far[maybe]]
        if not len(maybe):
            return pos, lcp, target
        begin = np.where(run > 0, same[run - 1] + 1, 0)
        size = pos[maybe] - begin
        extra = np.repeat(pos[maybe] - 1, size) - (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
        target[maybe] = -1
        more = targets(extra, bool(small[pos[maybe[0]]]))
        more[np.repeat(begin, size) != extra] = -1
        return np.concatenate((pos, extra)), np.concatenate((lcp, np.full(len(extra), depth, lcp.dtype))), np.concatenate((target, more))

    for s in range(symbols):
        last = None
        for pos, lcp in up.take(s):
            pos, lcp, target = with_runs(s, pos, lcp, targets(pos, False))
            parts.put(s, pos, lcp)
            carry.induce(up, pos, lcp, target)
            last = int(pos[-1])
        a, b = first[s], first[s + 1]
        if b > a:
            pos, lcp = order[a:b], order_lcp[a:b].copy()
            lcp[0] = seam(last, pos[0]) if last is not None else 0
            carry.induce(up, pos, lcp, targets(pos, False))
    up.close()
    down, carry = Queues(memory_bytes), _Carry(symbols, depth)
    for s in range(symbols - 1, -1, -1):
        last = None
        if s == 0:
            down.put(0, np.array([n - 1]), np.array([0]))
        for pos, lcp in down.take(s):
            pos, lcp, target = with_runs(s, pos, lcp, targets(pos, True))
            carry.induce(down, pos, lcp, target)
            yield s, "down", pos, lcp
            last = int(pos[-1])
        chunks = list(parts.take(s))
        if chunks:
            pos, lcp = np.concatenate([x[0] for x in chunks]), np.concatenate([x[1] for x in chunks])
            yield s, "up", pos, lcp
            back = np.empty(len(lcp), np.int32)
            back[0] = seam(last, pos[-1]) if last is not None else 0
            back[1:] = lcp[:0:-1]
            carry.induce(down, pos[::-1], back, targets(pos[::-1], True))
            if back[0]:
                yield s, "seam", np.array([last, int(pos[-1])]), np.array([0, int(back[0])], np.int32)
    down.close()
    parts.close()


def repeated_windows(t: np.ndarray, window: int, memory_bytes: int = 64 << 20) -> np.ndarray:
    """True at each place whose next ``window`` symbols also start at another place of ``t`` (ended by a unique 0)."""
    found = np.zeros(len(t), bool)
    before: dict[tuple[int, str], int] = {}
    for symbol, part, pos, lcp in sorted_suffixes(t, window, memory_bytes):
        hit = lcp >= window
        found[pos[hit]] = True
        at = np.flatnonzero(hit)
        found[pos[at[at > 0] - 1]] = True
        if len(at) and at[0] == 0 and part != "seam":
            found[before[symbol, part]] = True
        before[symbol, part] = int(pos[-1])
    return found
