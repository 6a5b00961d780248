"""Prefix trie of conversations by union-find over the common prefixes of sorted neighbours.

A conversation is a sequence of turn hashes (128 bits each), cut into blocks of ``block`` turns, so that a row is bounded
however long the conversation is.  The blocks of one prefix are sorted by their turns, copies by id; each block keeps how many turns it
has in common with the block before and after it.  Within a run of sorted blocks a union-find joins neighbours in order of falling
common length: a merge makes the branching node at that depth, and the way up to it, or to the prefix, is the chain of nodes
with one child.  Members, leaves, saved tokens and ids that end at a node are sums over the blocks below it, where a block counts for
a node only what the block before it in the order does not share.  So the partial nodes of different runs add up: nodes that
reach over a run's edge, all of them prefixes of its first or last block, are contracted to one row a run and merged by their prefix.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import plain, staged

c = F.col


# --- positions of turns and rebuilt conversations --------------------------------------------------
def _number(batches):
    """Adds the partition and the number of each row among its conversation's rows of the partition; rows come sorted."""
    pid, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column("conv_id").to_numpy()
        if not len(conv):
            continue
        start = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        k = np.arange(len(conv)) - np.repeat(start, np.diff(np.append(start, len(conv))))
        if last is not None and conv[0] == last:
            k[: start[1] if len(start) > 1 else len(conv)] += n
        last, n = conv[-1], int(k[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(conv), pid, np.int64)), pa.array(k)], [*batch.schema.names, "pid", "k"])


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, hi, lo, chars``: turns numbered from 0 in the order of ``turn`` (null first), also of very long conversations.

    Turns of one number are ordered by the hash of role and text; equal rows each count.
    """
    role, text = plain("role"), plain("text")
    rows = staged(turns.where(c("conv_id").isNotNull()).select(
        c("conv_id").cast("long").alias("conv_id"), c("turn").cast("long").alias("turn"), F.xxhash64(F.lit(1), role, text).alias("hi"),
        F.xxhash64(F.lit(2), role, text).alias("lo"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row")))
    order = ["conv_id", c("turn").asc_nulls_first(), "hi", "lo", "row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "hi", "lo", "chars")
    local = staged(dealt.mapInArrow(_number, "conv_id long, hi long, lo long, chars long, pid long, k long"))
    held = local.groupBy("conv_id", "pid").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    # a partition has at most one conversation that begins in an earlier one, so this table has at most a row per partition
    offset = F.broadcast(held.withColumn("before", before).where(c("before").isNotNull()).select("conv_id", "pid", "before"))
    return local.join(offset, ["conv_id", "pid"], "left").select("conv_id", (c("k") + F.coalesce("before", F.lit(0))).alias("pos"), "hi", "lo", "chars")


def _head(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its hundred."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 6).cast("long")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (``conv_id, n``: turns) and their turns (``conv_id, d`` from 1, ``hi, lo, chars``) after rebuilding.

    Conversation c takes the first h turns of conversation c - c % 100, h being the CRC-32 of c's digits modulo 6, and goes on
    with its own turns behind its first h.
    """
    own = staged(numbered_turns(turns))
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select("conv_id", "own", _head(c("conv_id")).alias("h"), (c("conv_id") - c("conv_id") % 100).alias("base"))
    base = convs.where(c("conv_id") == c("base")).select("base", c("own").alias("base_n"))
    info = staged(convs.join(base, "base", "left").select("conv_id", "base", "h", "own", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")))
    heads = own.where((c("pos") < 5) & (c("conv_id") % 100 == 0)).select(c("conv_id").alias("base"), "pos", "hi", "lo", "chars")
    first = info.where(c("taken") > 0).join(heads, "base").where(c("pos") < c("taken")).select("conv_id", (c("pos") + 1).alias("d"), "hi", "lo", "chars")
    rest = own.join(info.select("conv_id", "h", "taken"), "conv_id").where(c("pos") >= c("h"))
    rest = rest.select("conv_id", (c("taken") + c("pos") - c("h") + 1).alias("d"), "hi", "lo", "chars")
    return info.select("conv_id", (c("taken") + F.greatest(c("own") - c("h"), F.lit(0))).alias("n")), first.unionByName(rest)


# --- blocks of turns ------------------------------------------------------------------------------
def turn_blocks(convs: DataFrame, turns: DataFrame, block: int) -> DataFrame:
    """``conv_id, s, final, keys, chars, p1, p2``: block ``s`` of a conversation and the hash of all turns before it.

    The last block of a conversation is ``final`` and has fewer than ``block`` turns, none where the length is a multiple.
    """
    of = F.floor((c("d") - 1) / block).cast("long")
    turn = F.array_sort(F.collect_list(F.struct("d", "hi", "lo", "chars")))
    held = turns.groupBy("conv_id", of.alias("s")).agg(turn.alias("t"))
    blocks = held.select("conv_id", "s", (F.size("t") < block).alias("final"), F.flatten(F.transform("t", lambda x: F.array(x["hi"], x["lo"]))).alias("keys"),
                         F.col("t.chars").alias("chars"))
    none = F.array().cast("array<bigint>")
    empty = convs.where(c("n") % block == 0).select("conv_id", F.floor(c("n") / block).cast("long").alias("s"), F.lit(True).alias("final"), none.alias("keys"), none.alias("chars"))
    blocks = staged(blocks.unionByName(empty))
    so_far = Window.partitionBy("conv_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    prefix = lambda seed: F.coalesce(F.bit_xor(F.xxhash64(F.lit(seed), "s", "keys")).over(so_far), F.lit(0))
    one = (c("s") == 0) & c("final")
    return blocks.where(one).select("*", F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2")).unionByName(
        blocks.where(~one).select("*", prefix(3).alias("p1"), prefix(4).alias("p2")))


def _lists(column) -> list[np.ndarray]:
    at, values = column.offsets.to_numpy().tolist(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _common(a, b) -> int:
    """Turns that two blocks have in common, -1 if they follow different prefixes."""
    if a[0] != b[0]:
        return -1
    n = min(len(a[1]), len(b[1]))
    other = np.flatnonzero(a[1][:n] != b[1][:n])
    return (int(other[0]) if len(other) else n) // 2


UNKNOWN = -2


def _neighbours(batches):
    """Adds place, partition and the turns in common with the row before and after; unknown (-2) at a partition's edges."""
    pid, n, last, held = TaskContext.get().partitionId(), 0, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = list(zip(*(batch.column(x).to_pylist() for x in ("s", "p1", "p2")), strict=True))
        rows = list(zip(group, _lists(batch.column("keys")), strict=True))
        before = [UNKNOWN if last is None else _common(last, rows[0]), *(_common(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True))]
        if held is not None:
            yield held(before[0])
        at = np.arange(n, n + len(rows))
        held = lambda after, batch=batch, before=before, at=at: pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(at), pid, np.int64)), pa.array(at), pa.array(np.array(before, np.int32)), pa.array(np.array([*before[1:], after], np.int32))],
            [*batch.schema.names, "pid", "at", "before", "after"])
        last, n = rows[-1], n + len(rows)
    if held is not None:
        yield held(UNKNOWN)


def sorted_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks in order of prefix, turns and id, in the shared folder, with ``before`` and ``after``: turns shared with the neighbours.

    The driver sees the first and the last block of each partition.
    """
    order = ["s", "p1", "p2", "keys", "conv_id"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema)
    dealt = blocks.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(dealt.mapInArrow(_neighbours, f"{schema}, pid long, at long, before int, after int"))
    edges = rows.where((c("before") == UNKNOWN) | (c("after") == UNKNOWN)).select("pid", "at", "s", "p1", "p2", "keys", "before", "after").collect()
    edges = [(r["pid"], r["before"], r["after"], ((r["s"], r["p1"], r["p2"]), np.array(r["keys"], np.int64))) for r in sorted(edges, key=lambda r: (r["pid"], r["at"]))]
    first, last = [e for e in edges if e[1] == UNKNOWN], [e for e in edges if e[2] == UNKNOWN]
    shared = [-1, *(_common(a[3], b[3]) for a, b in zip(last[:-1], first[1:], strict=True)), -1]
    known = [(f[0], shared[i], shared[i + 1]) for i, f in enumerate(first)]
    known = rows.sparkSession.createDataFrame(known, "pid long, b int, a int")  # a row per partition
    return rows.join(F.broadcast(known), "pid", "left").select(
        *[x for x in rows.columns if x not in ("before", "after")], F.when(c("before") == UNKNOWN, c("b")).otherwise(c("before")).alias("before"),
        F.when(c("after") == UNKNOWN, c("a")).otherwise(c("after")).alias("after"))


def with_later(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``leaf`` and ``later``: whether the conversation ends at a leaf, and the tokens saved behind the block.

    ``later``: characters of the conversation's turns behind the block, less those of nodes that it is the first in order to
    have.  Null in final blocks, where neighbours tell.
    """
    long = staged(blocks.where((c("s") > 0) | ~c("final")))
    order = sorted_blocks(long.where(c("s") > 0))
    total = F.aggregate("chars", F.lit(0).cast("long"), lambda x, y: x + y)
    fresh = F.aggregate(F.expr("slice(chars, greatest(before, 0) + 1, size(chars))"), F.lit(0).cast("long"), lambda x, y: x + y)
    own = order.select("conv_id", "s", (total - fresh).alias("saved"), (c("final") & (c("after") < F.size("chars"))).cast("int").alias("leaf"))
    first = long.where(c("s") == 0).select("conv_id", "s", F.lit(0).cast("long").alias("saved"), F.lit(0).alias("leaf"))
    behind = Window.partitionBy("conv_id").orderBy(c("s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = own.unionByName(first).select("conv_id", "s", F.sum("saved").over(behind).alias("later"), F.max("leaf").over(behind).alias("leaf"))
    none = blocks.where((c("s") == 0) & c("final")).select("*", F.lit(None).cast("long").alias("later"), F.lit(None).cast("int").alias("leaf"))
    return none.unionByName(long.join(sums, ["conv_id", "s"]).select(*long.columns, F.when(~c("final"), c("later")).alias("later"), F.when(~c("final"), c("leaf")).alias("leaf")))


# --- forests --------------------------------------------------------------------------------------
#: A node, or the part of a node that one run of blocks has (``part``); ``k1, k2``: hash of its prefix.
NODES = ("run long, part boolean, depth long, k1 long, k2 long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "parent_conv_id long, up1 long, up2 long, ends_sha256 string, ends string")


def _digest(*values) -> tuple[int, int]:
    h = hashlib.blake2b(b"".join(x if isinstance(x, bytes) else int(x).to_bytes(8, "little", signed=True) for x in values), digest_size=16).digest()
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


class _Forest:
    """Nodes of one run of sorted blocks; a component of the union-find is a range of rows, kept at its first row."""

    def __init__(self, block: int, run: int, s: list[int], prefix: list[tuple], ends: list[tuple], keys: list[np.ndarray], chars: list[list[int]], conv: list[int],
                 before: list[int], after: list[int], leaves: list[int], later: list[int], final: list[bool]):
        self.block, self.run, self.s, self.prefix, self.block_end, self.keys, self.chars, self.before, self.after = block, run, s, prefix, ends, keys, chars, before, after
        n = len(conv)
        self.boss, self.last, self.top = list(range(n)), list(range(n)), [len(x) for x in chars]
        self.count, self.least, self.leaves, self.saved, self.children = [1] * n, list(conv), leaves, later, [0] * n
        self.ending = [[x] if f else [] for x, f in zip(conv, final, strict=True)]
        self.orphans: list[list[list]] = [[] for _ in range(n)]
        self.out: list[list] = []

    def _key(self, i: int, depth: int) -> tuple[int, int]:
        if depth == self.block:
            return self.block_end[i]
        return self.prefix[i] if depth == 0 else _digest(*self.prefix[i], self.keys[i][: 2 * depth].tobytes())

    def _emit(self, i: int, depth: int) -> None:
        """The node of component ``i`` at its depth within the block."""
        first = i
        fresh = self.before[first] < depth
        part = not fresh or self.after[self.last[i]] >= depth or depth in (0, self.block)
        if depth:
            self.saved[i] += (self.count[i] - fresh) * self.chars[first][depth - 1]
        whole = depth > 0 or self.s[first] == 0  # a later block's start is the last node of the block before
        k1, k2 = self._key(first, depth) if part else (None, None)
        ids = ",".join(map(str, self.ending[i]))
        node = [self.run, part, self.s[first] * self.block + depth, k1, k2, self.least[i] if whole else None, self.count[i] if whole else 0, self.children[i],
                self.leaves[i] if whole else 0, self.saved[i] if whole else 0, None, None, None, None if part else hashlib.sha256(ids.encode()).hexdigest(),
                ids if part and ids else None]
        for child in self.orphans[i]:
            if part:
                child[11], child[12] = k1, k2
            else:
                child[10] = self.least[i]
        self.out.append(node)
        # the part of a node that a run does not begin has the same parent as the part that does
        self.orphans[i] = [node] if depth else []
        self.children[i], self.ending[i] = int(fresh), []

    def _lift(self, i: int, depth: int) -> None:
        while self.top[i] > depth:
            self._emit(i, self.top[i])
            self.top[i] -= 1

    def _find(self, i: int) -> int:
        while self.boss[i] != i:
            self.boss[i] = self.boss[self.boss[i]]
            i = self.boss[i]
        return i

    def nodes(self) -> list[list]:
        shared = np.array(self.before[1:], np.int64)
        for e in np.argsort(-shared, kind="stable").tolist():
            depth = self.before[e + 1]
            if depth < 0:
                break
            a, b = self._find(e), self._find(e + 1)
            self._lift(a, depth)
            self._lift(b, depth)
            self.boss[b], self.last[a] = a, self.last[b]
            self.count[a] += self.count[b]
            self.least[a] = min(self.least[a], self.least[b])
            self.leaves[a] += self.leaves[b]
            self.saved[a] += self.saved[b]
            self.children[a] += self.children[b]
            self.ending[a] += self.ending[b]
            one, two = self.orphans[a], self.orphans[b]
            self.orphans[a] = one + two if len(one) < 8 else one.extend(two) or one
        for i in range(len(self.boss)):
            if self.boss[i] == i:
                self._lift(i, 0)
                self._emit(i, 0)
        return self.out


def _forests(block: int, rows_per_run: int):
    kinds = [pa.bool_() if t.endswith("boolean") else pa.string() if t.endswith("string") else pa.int64() for t in NODES.split(", ")]
    names = [t.split()[0] for t in NODES.split(", ")]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            pid, at = batch.column("pid").to_numpy(), batch.column("at").to_numpy()
            new = np.concatenate(([True], (pid[1:] != pid[:-1]) | (at[1:] != at[:-1] + 1)))  # another file, or a gap between two of its pieces
            edges = sorted({*np.flatnonzero(new).tolist(), *range(0, len(at), rows_per_run), len(at)})
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                some = batch.slice(a, b - a)
                get = {x: some.column(x).to_pylist() for x in ("s", "p1", "p2", "e1", "e2", "conv_id", "before", "after", "leaf", "later", "final", "chars")}
                leaves = [int(w < len(x)) if f else leaf for f, w, x, leaf in zip(get["final"], get["after"], get["chars"], get["leaf"], strict=True)]
                forest = _Forest(block, int(pid[a]) << 32 | int(at[a]), get["s"], list(zip(get["p1"], get["p2"], strict=True)), list(zip(get["e1"], get["e2"], strict=True)),
                                 _lists(some.column("keys")), get["chars"], get["conv_id"], get["before"], get["after"], leaves, [x or 0 for x in get["later"]], get["final"])
                cols = list(zip(*forest.nodes(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names)

    return run


def _hash_ends(batches):
    """SHA-256 of the ids of each node; rows come sorted by node and place, a node's ids are never held together."""
    node, h, out = None, None, []
    for batch in batches:
        for depth, k1, k2, ids in zip(*(batch.column(x).to_pylist() for x in ("depth", "k1", "k2", "ends")), strict=True):
            if (depth, k1, k2) != node:
                if node is not None:
                    out.append((*node, h.hexdigest()))
                node, h = (depth, k1, k2), hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(("depth", "k1", "k2", "ends_sha256"), r, strict=True)) for r in out], schema=_ENDS)
        out = []
    if node is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(("depth", "k1", "k2", "ends_sha256"), (*node, h.hexdigest()), strict=True))], schema=_ENDS)


_ENDS = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def conversation_trie(turns: DataFrame, *, block: int = 64, rows_per_run: int = 10_000) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations (see ``rebuilt_turns``).

    ``conv_id``: smallest member; ``depth``; ``parent_conv_id`` (root: null); ``n_convs``: members; ``n_children``;
    ``n_leaves``: childless nodes of the subtree, the node included; ``saved_tokens``: sum over the subtree of (members - 1) times
    the code points of the node's last text; ``ends_sha256``: SHA-256 of the ids that end there, ascending, comma-joined.

    ``turns`` has ``conv_id, turn, role, text``; other columns are not read.  Null role or text is the empty string, a null turn
    comes first, turns of one number are ordered by the hash of role and text, equal rows each count.  Rows without ``conv_id``
    belong to no conversation and are left out.  An empty table has no members and gives no rows, not even a root.
    """
    blocks = with_later(staged(turn_blocks(*rebuilt_turns(turns), block)))
    end = lambda p, seed: c(p).bitwiseXOR(F.xxhash64(F.lit(seed), "s", "keys"))
    order = sorted_blocks(staged(blocks.select("*", end("p1", 3).alias("e1"), end("p2", 4).alias("e2"))))
    nodes = staged(order.mapInArrow(_forests(block, rows_per_run), NODES))
    key = ["depth", "k1", "k2"]
    parts = nodes.where("part")
    by_node = parts.select(*key, "run", "ends").where(c("ends").isNotNull()).repartition(*key).sortWithinPartitions(*key, "run")
    ends = by_node.select(*key, "ends").mapInArrow(_hash_ends, "depth long, k1 long, k2 long, ends_sha256 string")
    merged = parts.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(x).alias(x) for x in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.min("parent_conv_id").alias("parent_conv_id"), F.max("up1").alias("up1"), F.max("up2").alias("up2"))
    merged = staged(merged.join(ends, key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))))
    least = merged.select(c("depth").alias("d"), c("k1").alias("up1"), c("k2").alias("up2"), c("conv_id").alias("up"))
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parent = F.coalesce("parent_conv_id", "up").alias("parent_conv_id")
    pick = lambda df: df.select(*[parent if x == "parent_conv_id" else c(x) for x in result])
    inner = merged.withColumn("d", c("depth") - 1).join(least, ["d", "up1", "up2"], "left")
    # each run's parts learn their node's smallest member, so whole nodes ask within their run and no parent is a hot key;
    # a run may hold the end of a block and the start of the next one
    local = parts.select("run", c("depth").alias("d"), c("k1").alias("up1"), c("k2").alias("up2")).distinct().join(least, ["d", "up1", "up2"]).select("run", "d", "up1", "up2", "up")
    outer = nodes.where(~c("part")).withColumn("d", c("depth") - 1).join(local, ["run", "d", "up1", "up2"], "left")
    return pick(inner).unionByName(pick(outer))


#: CRC-32 of a number's digits: one bit at a time, eight for each digit.
_CRC_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)))"""

OP13_SQL = r"""
WITH t AS (SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 pos
  FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, """ + _CRC_SQL + r""" % 6 h, conv_id - conv_id % 100 base FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT i.conv_id, x, 0 own, pos FROM i JOIN t ON t.conv_id = i.base AND pos < h UNION ALL SELECT i.conv_id, x, 1, pos FROM i JOIN t ON t.conv_id = i.conv_id AND pos >= h),
s AS (SELECT i.conv_id, coalesce(l, []) l FROM i LEFT JOIN (SELECT conv_id, list(x ORDER BY own, pos) l FROM r GROUP BY conv_id) USING (conv_id)),
p AS (SELECT conv_id, d, sha256(l[:d]::VARCHAR) k, CASE WHEN d > 0 THEN sha256(l[:d - 1]::VARCHAR) END up, CASE WHEN d > 0 THEN length(l[d].t) ELSE 0 END n, len(l) = d last
  FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) d FROM s)),
m AS (SELECT d, k, up, min(conv_id) conv_id, count(*) n_convs, (count(*) - 1) * any_value(n) saves,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) ends_sha256 FROM p GROUP BY d, k, up),
kids AS (SELECT d - 1 d, up k, count(*) n_children FROM m WHERE d > 0 GROUP BY ALL),
a AS (SELECT m.*, coalesce(n_children, 0) n_children FROM m LEFT JOIN kids USING (d, k)),
under AS (SELECT q.d, q.k, sum(a.saves) saved_tokens, count(*) FILTER (WHERE a.n_children = 0) n_leaves
  FROM a JOIN p o ON o.d = a.d AND o.k = a.k AND o.conv_id = a.conv_id JOIN p q ON q.conv_id = o.conv_id AND q.d <= o.d GROUP BY q.d, q.k)
SELECT a.conv_id, a.d::BIGINT AS depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, a.ends_sha256
FROM a JOIN under USING (d, k) LEFT JOIN a b ON b.d = a.d - 1 AND b.k = a.up
"""
