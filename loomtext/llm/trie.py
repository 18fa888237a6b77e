"""The prefix trie of conversations, built compressed over sorted ranges and expanded at the end.

A conversation is a path: 16 bytes a turn, the digest of role and text. Paths are bytes, so their order is that
of the trie's depth-first walk. Equal paths become one point (count, smallest identifier). Points are
range-partitioned and sorted, and one pass over a range with a stack of open nodes creates the branch, end and
leaf points only; what lies between two of them is an edge. Nodes close in post-order, with sums over their
subtrees. A node that is a prefix of the neighbouring range's nearest point too is shared by ranges: each range
gives its part of the node's sums, and a grouping adds the parts. All sums can be added because every node is
counted by one point alone, the first that passes through it. A second pass reads a range's nodes in reverse
(parents first), gives each its parent's identifier and expands the edges by suffix sums.

saved(X) = sum over nodes Y at or below X of (n_Y - 1) * words_Y is taken as (words of all members from X on)
minus (words of distinct nodes from X on), so that no count has to be known before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.common import Workspace, tidy

TURN_BYTES = 16
POINTS_PER_RANGE = 50_000
CHUNK_BITS = 16
ROWS_OUT = 4096
NOTHING = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"

KINDS = (
    "part int, nth long, shared boolean, key string, depth int, up int, n long, first long, kids long, leaves long, "
    "held long, made long, base long, edge array<long>, ends string"
)
NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string"
)


def turn_digest(role: Column, text: Column) -> Column:
    """32 hex digits; null counts as empty. The role's length keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def threads(
    turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """conv_id and own: the turns (at, digest, words) in order, null first, ties by digest. Null identifiers go."""
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    rows = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(order_col).alias("at"),
        turn_digest(F.col(role_col), F.col(text_col)).alias("digest"), words.alias("words"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "digest", "words"))).alias("own"))


def shared_openings(found: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Every thread begins with the first h turns of the thread whose identifier is the next lower multiple of
    ``group``, h = crc32 of its own decimal identifier modulo ``most``, and goes on with its own turns after h."""
    firsts = found.filter(f"conv_id % {group} = 0").select(F.col("conv_id").alias("_base"), F.slice("own", 1, most - 1).alias("_firsts"))
    h = F.expr(f"cast(crc32(cast(cast(conv_id as string) as binary)) % {most} as int)")
    rows = found.withColumn("_base", F.expr(f"conv_id - conv_id % {group}")).withColumn("_h", h).join(firsts, "_base", "left")
    opening = F.coalesce(F.expr("slice(_firsts, 1, _h)"), F.expr("slice(own, 1, 0)"))
    return rows.select("conv_id", F.concat(opening, F.expr("slice(own, _h + 1, greatest(size(own) - _h, 0))")).alias("own"))


def _ends(rows: DataFrame) -> DataFrame:
    """name, ends: SHA-256 of a path's identifiers in order, comma-joined.

    Identifiers are joined in chunks of 2^16 values, so a path that a third of all conversations share is some
    text blocks, which one task hashes as a stream; that order is part of the digest.
    """
    chunk = F.shiftright("conv_id", CHUNK_BITS).alias("chunk")
    chunks = rows.groupBy("name", chunk).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        out: list[tuple[str, str]] = []
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != at:
                    if at is not None:
                        out.append((at, state.hexdigest()))
                    at, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["name", "ends"])
                out = []
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([state.hexdigest()])], names=["name", "ends"])

    return chunks.repartition("name").sortWithinPartitions("name", "chunk").select("name", "ids").mapInArrow(run, "name string, ends string")


def points(found: DataFrame) -> DataFrame:
    """One row per distinct path: path, words (a list), n, first (smallest identifier), ends."""
    path = F.unhex(F.array_join(F.transform("own", lambda t: t["digest"]), ""))
    rows = found.select("conv_id", path.alias("path"), F.transform("own", lambda t: t["words"]).alias("words"))
    rows = rows.withColumn("name", F.md5("path"))
    sums = [F.first("path").alias("path"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("first")]
    return rows.groupBy("name").agg(*sums).join(_ends(rows.select("name", "conv_id")), "name").drop("name")


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN_BYTES
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // TURN_BYTES


class _Node:
    __slots__ = ("depth", "n", "first", "kids", "leaves", "held", "made", "ends")

    def __init__(self, depth: int):
        self.depth, self.n, self.first, self.kids, self.leaves, self.held, self.made, self.ends = depth, 0, None, 0, 0, 0, 0, None


class _Walk:
    """One range. ``rows`` collects nodes as they close: compressed where whole, depth by depth where shared.

    ``made`` of an open node holds the words of the nodes below it that this range was first to pass; ``held``
    the words of all its members, from the root on.
    """

    def __init__(self, part: int):
        self.part, self.nth, self.rows = part, 0, []
        self.stack, self.path, self.sums, self.left = [_Node(0)], b"", np.zeros(1, np.int64), -1

    def ghost_before(self, path: bytes) -> None:
        self.path, self.left = path, None  # how much is shared is known with the first point

    def point(self, path: bytes, words: list[int], n: int, first: int, ends: str) -> None:
        shared = _common(self.path, path)
        if self.left is None:
            self.left = shared
            if shared:
                self.stack.append(_Node(shared))
        else:
            self._close(shared)
        top, depth = self.stack[-1], len(path) // TURN_BYTES
        self.path, self.sums = path, np.concatenate([[0], np.cumsum(np.asarray(words, np.int64))]) if words else np.zeros(1, np.int64)
        if depth > top.depth:
            top.kids += 1
            top = _Node(depth)
            self.stack.append(top)
        top.n += n
        top.first = first if top.first is None else min(top.first, first)
        top.held += n * int(self.sums[depth])
        top.ends = ends

    def ghost_after(self, path: bytes) -> None:
        shared = _common(self.path, path)
        self._close(shared)
        self._finish(shared)

    def rest(self) -> list[tuple]:
        """The rows left; where no range follows all that is open closes, the root last."""
        if self.stack:
            self._close(0)
            self._finish(-1)
        return self.rows

    def _close(self, shared: int) -> None:
        """Closes nodes deeper than ``shared``; the current path branches or ends there."""
        while (top := self.stack[-1]).depth > shared:
            if not top.leaves:
                top.leaves = 1  # nothing extends it: what extended it has closed into it before
            self.stack.pop()
            up = self.stack[-1]
            if up.depth < shared:
                up = _Node(shared)
                up.kids = int(shared + 1 > self.left)
                self.stack.append(up)
            self._emit(top, up.depth)
            self._into(top, up)
        self.left = min(self.left, shared)

    def _into(self, node: _Node, up: _Node) -> None:
        up.n += node.n
        up.leaves += node.leaves
        up.held += node.held
        up.first = node.first if up.first is None else min(up.first, node.first) if node.first is not None else up.first
        new = max(up.depth, self.left)  # nodes at or above the left border were made by an earlier range
        up.made += node.made + (int(self.sums[node.depth] - self.sums[new]) if node.depth > new else 0)

    def _row(self, key: str | None, depth: int, up: int, node: _Node, kids: int, made: int, edge: list[int], ends: str | None) -> None:
        base, sums = int(self.sums[up]) if up > 0 else 0, (node.n, node.first, kids, node.leaves, node.held, made)
        self.rows.append((self.part, self.nth, key is not None, key, depth, up, *sums, base, edge, ends))
        self.nth += 1

    def _emit(self, node: _Node, up: int, open_to: int = -1) -> None:
        """A node with its edge from ``up``; depths that other ranges share are given one by one."""
        if node.depth <= max(self.left, open_to):
            for d in range(node.depth, up, -1):
                own = d > self.left  # this range made it
                word = int(self.sums[d] - self.sums[d - 1]) if d else 0
                below = int(self.sums[node.depth] - self.sums[max(d, self.left)]) if node.depth > max(d, self.left) else 0
                key = hashlib.md5(self.path[: d * TURN_BYTES]).hexdigest() + f"/{d}"
                kids = node.kids if d == node.depth else int(d + 1 > self.left)
                made = node.made + below + (word if own else 0)
                self._row(key, d, d - 1, node, kids, made, [word], node.ends if d == node.depth else None)
            return
        edge = np.diff(self.sums[up : node.depth + 1]).tolist() if node.depth else [0]
        self._row(None, node.depth, up, node, node.kids, node.made, edge, node.ends)

    def _finish(self, open_to: int) -> None:
        while self.stack:
            node = self.stack.pop()
            up = self.stack[-1] if self.stack else None
            if not node.leaves and open_to < node.depth:
                node.leaves = 1
            self._emit(node, up.depth if up else -1, open_to)
            if up:
                self._into(node, up)


def _walked(rows: DataFrame, ranges: int) -> DataFrame:
    """part, path, words, n, first, ends and ghost (0: a point, -1 and 1: the nearest point of another range)."""
    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.list_(pa.int64()), pa.string()]
    names = [x.split(" ")[0] for x in KINDS.split(", ")]

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk: _Walk | None = None

        def some(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

        for batch in batches:
            for part, path, words, n, first, ends, ghost in zip(*(c.to_pylist() for c in batch.columns)):
                if walk is None or walk.part != part:
                    if walk is not None and walk.rest():
                        yield some(walk.rows)
                    walk = _Walk(part)
                if ghost < 0:
                    walk.ghost_before(path)
                elif ghost:
                    walk.ghost_after(path)
                else:
                    walk.point(path, words, n, first, ends)
                if len(walk.rows) >= ROWS_OUT:
                    yield some(walk.rows)
                    walk.rows = []
        if walk is not None and walk.rest():
            yield some(walk.rows)

    rows = rows.select("part", "path", "words", "n", "first", "ends", "ghost")
    return rows.repartition(ranges, "part").sortWithinPartitions("part", "path").mapInArrow(run, KINDS)


def _expanded(rows: DataFrame, ranges: int) -> DataFrame:
    """Nodes of a range, parents first, with their parents' identifiers; edges become one row per depth."""
    names = [x.split(" ")[0] for x in NODES.split(", ")]
    kinds = [*[pa.int64()] * 7, pa.string()]

    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack, out = None, [], []
        for batch in batches:
            for part, mine, depth, up, n, first, kids, leaves, held, made, base, edge, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at:
                    at, stack = part, []
                while stack and stack[-1][0] > up:
                    stack.pop()
                above = stack[-1][1] if stack else None
                stack.append((depth, first))
                if not mine:
                    continue
                before, below = base, sum(edge)
                for d, w in enumerate(edge, up + 1):
                    below -= w  # the edge's words after this depth
                    end, saved = d == depth, held - n * before - made - below - w
                    parent = above if d == up + 1 else first
                    out.append((first, d, parent, n, kids if end else 1, leaves, saved, (end and ends) or NOTHING))
                    before += w
                if len(out) >= ROWS_OUT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    rows = rows.select("part", "mine", "depth", "up", "n", "first", "kids", "leaves", "held", "made", "base", "edge", "ends", "nth")
    rows = rows.repartition(ranges, "part").sortWithinPartitions("part", F.desc("nth")).drop("nth")
    return rows.mapInArrow(run, NODES)


def build(found: DataFrame, ranges: int | None = None) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``found`` has conv_id and own, as :func:`threads` gives them. Conversations without turns are members of
    the root alone. Repeated turns are turns, equal conversations are members of the same nodes, an empty table
    has no nodes. Texts of any length count by digest and words only; a conversation is one row of 24 bytes a
    turn, and the sorting samples whole paths. Other columns are not read, so none can clash.
    """
    work = Workspace(found.sparkSession, "trie")
    whole = work.write(points(found), "points")
    ranges = ranges or max(found.sparkSession.sparkContext.defaultParallelism, whole.count() // POINTS_PER_RANGE)
    dealt = work.write(whole.repartitionByRange(ranges, "path").withColumn("part", F.spark_partition_id()), "ranges")
    work.drop(whole)
    # one row a range: its ends are what the neighbours' borders are measured against
    bounds = dealt.groupBy("part").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    beside = Window.orderBy("part")
    bounds = bounds.select("part", F.lag("high").over(beside).alias("before"), F.lead("low").over(beside).alias("after"))
    kinds = (("words", "array<long>"), ("n", "long"), ("first", "long"), ("ends", "string"))
    blank = [F.lit(None).cast(kind).alias(name) for name, kind in kinds]
    rows = dealt.withColumn("ghost", F.lit(0))
    for side, ghost in (("before", -1), ("after", 1)):
        near = bounds.filter(F.col(side).isNotNull()).select(F.col(side).alias("path"), *blank, "part", F.lit(ghost).alias("ghost"))
        rows = rows.unionByName(near)
    nodes = work.write(_walked(rows, ranges), "nodes")
    work.drop(dealt)
    sums = [F.sum(c).alias(c) for c in ("n", "kids", "leaves", "held", "made")]
    total = nodes.filter("shared").groupBy("key").agg(F.min("first").alias("first"), *sums, F.max("ends").alias("ends"), F.min("part").alias("owner"))
    mine = nodes.filter("shared").select("key", "part", "nth", "depth", "up", "base", "edge").join(total, "key")
    # a shared node's own word is in what its maker gave
    mine = mine.withColumn("mine", F.expr("owner = part")).withColumn("made", F.expr("made - edge[0]")).drop("key", "owner")
    whole = nodes.filter("NOT shared").withColumn("mine", F.lit(True)).drop("shared", "key")
    return _expanded(whole.unionByName(mine), ranges)
