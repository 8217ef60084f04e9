"""Prefix trie of conversations: union-find over the edges between sorted neighbours, deepest first.

A conversation is the array of its turns' 128-bit fingerprints (a row of some 20 bytes a turn; texts
stay behind). Conversations are range-partitioned and sorted by that array, so every trie node is a
run of consecutive rows, and neighbours are linked by an edge as deep as their longest common prefix.
A task takes its rows in blocks. In a block, edges are united in descending depth: two components
that meet at depth d hang below one node of depth d, a new branching node unless one of them is
rooted there already, and the turns between a component's root and d are nodes with one child.

Nodes on the path of a block's first or last conversation may go on in the next block: they stay
open, and a block is contracted to these two paths. Neighbouring blocks' paths are merged down to
their common prefix, which closes what lies deeper; so are those of neighbouring partitions, in
groups of FAN level by level, until one forest is left. A closed node adds its totals to its parent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import range_bucket, range_splits, shuffle_partitions, stash

#: Turns of a block, about; partitions whose forests one task merges.
BLOCK_TURNS, FAN = 200_000, 64
#: A conversation's first turns may come from the one whose id is the next multiple of GROUP towards 0: fewer than HEADS of them.
GROUP, HEADS = 100, 6

#: Rows between tasks. part: -1 a closed node, -2 the ids of equal conversations in a row, else the partition of an open node, which lies on the path of its first (side 0) or only of its last conversation (side 1).
_ROW = {n: pa.int64() for n in ("depth", "h1", "h2", "p1", "p2", "size", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "part", "side")} | {"ids": pa.string()}
_SQL_ROW = ", ".join(f"{n} {'string' if k == pa.string() else 'bigint'}" for n, k in _ROW.items())


class Node:
    """A trie node as far as it is known: its key, its parent's, its last turn's size; least and number of members; children, leaves and savings of closed nodes below."""

    __slots__ = ("depth", "h1", "h2", "p1", "p2", "size", "least", "n", "children", "leaves", "saved")

    def __init__(self, *values: int) -> None:
        self.depth, self.h1, self.h2, self.p1, self.p2, self.size, self.least, self.n, self.children, self.leaves, self.saved = values

    def row(self, part: int = -1, side: int = 0) -> tuple:
        return (self.depth, self.h1, self.h2, self.p1, self.p2, self.size, self.least, self.n, self.children, self.leaves, self.saved, part, side, None)

    def close(self) -> tuple:
        """The finished row. A node without children is a leaf."""
        self.leaves += not self.children
        self.saved += (self.n - 1) * self.size
        return self.row()

    def adopt(self, child: Node) -> None:
        """Count a closed child."""
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved

    def join(self, same: Node) -> None:
        """Add what a neighbouring range of rows knows of the same node."""
        self.least, self.n = min(self.least, same.least), self.n + same.n
        self.children, self.leaves, self.saved = self.children + same.children, self.leaves + same.leaves, self.saved + same.saved


@dataclass
class Forest:
    """A contracted range of rows: the open nodes from the root along its first and its last row; they share the first `shared` ones."""

    first: list[Node]
    last: list[Node]
    shared: int

    def rows(self, part: int) -> list[tuple]:
        return [x.row(part, 0) for x in self.first] + [x.row(part, 1) for x in self.last[self.shared :]]


def close_path(path: list[Node], keep: int, done: list[tuple]) -> None:
    """Close the nodes of a path from the root, deepest first, down to `keep` of them."""
    for i in range(len(path) - 1, keep - 1, -1):
        done.append(path[i].close())
        if i:
            path[i - 1].adopt(path[i])


def merge(a: Forest, b: Forest, done: list[tuple]) -> Forest:
    """a and the range of rows after it as one. Closes the nodes that neither its first nor its last row has."""
    ends, starts, common = a.last, b.first, 0
    while common < min(len(ends), len(starts)) and (ends[common].h1, ends[common].h2) == (starts[common].h1, starts[common].h2):
        ends[common].join(starts[common])
        common += 1
    close_path(ends, max(common, a.shared), done)
    close_path(ends[:common] + starts[common:], max(common, b.shared), done)
    close_path(ends[:common], max(a.shared, b.shared), done)
    both = min(common, b.shared)
    return Forest(a.first, ends[:both] + b.last[both:], min(a.shared, both))


class Block:
    """Sorted conversations: ids, where each one's turns begin, and for each turn the prefix's key and the text's size."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> None:
        self.ids, self.bounds = ids, bounds
        place = np.arange(len(a)) - np.repeat(bounds[:-1], np.diff(bounds)) + 1
        self.h1, self.h2 = (self._prefixes(x, place, seed) for x, seed in ((a, 0x9E3779B97F4A7C15), (b, 0xC2B2AE3D27D4EB4F)))
        self.sizes = sizes

    def _prefixes(self, turns: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
        """A key of each prefix: the turns' fingerprints, each mixed with its place, xored."""
        x = turns.astype(np.uint64) + place.astype(np.uint64) * np.uint64(seed)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        run = np.concatenate(([np.uint64(0)], np.bitwise_xor.accumulate(x))) if len(x) else np.zeros(1, np.uint64)
        return (run[1:] ^ np.repeat(run[self.bounds[:-1]], np.diff(self.bounds))).view(np.int64)

    def edges(self) -> np.ndarray:
        """How many turns each conversation shares with the one before it; from the second on."""
        n = np.diff(self.bounds)
        both = np.minimum(n[1:], n[:-1])
        own = np.repeat(np.arange(len(both)), both)
        at = np.arange(len(own)) - np.repeat(np.cumsum(both) - both, both)
        x, y = self.bounds[:-2][own] + at, self.bounds[1:-1][own] + at
        return np.bincount(own, weights=(self.h1[x] == self.h1[y]) & (self.h2[x] == self.h2[y]), minlength=len(both)).astype(np.int64)

    def forest(self, done: list[tuple]) -> Forest:
        """Unite the edges, deepest first; closed nodes go to done."""
        n, starts = len(self.ids), self.bounds.tolist()
        ids, h1, h2, sizes = self.ids.tolist(), self.h1.tolist(), self.h2.tolist(), self.sizes.tolist()

        def node(i: int, depth: int, least: int, members: int) -> Node:
            at = starts[i] + depth - 1
            own = (h1[at], h2[at]) if depth else (0, 0)
            above = (h1[at - 1], h2[at - 1]) if depth > 1 else (0, 0)
            return Node(depth, *own, *above, sizes[at] if depth else 0, least, members, 0, 0, 0)

        owner = list(range(n))
        tops = [node(i, starts[i + 1] - starts[i], ids[i], 1) for i in range(n)]
        open_: dict[int, list[Node]] = {}  # open nodes below a component's root, deepest first
        first, last, both = [], [], []

        def find(i: int) -> int:
            while owner[i] != i:
                owner[i] = owner[owner[i]]
                i = owner[i]
            return i

        def rise(i: int, depth: int) -> None:
            """Bring component i's root up to depth."""
            top, kept = tops[i], open_.get(i)
            while top.depth > depth:
                above = node(i, top.depth - 1, top.least, top.n)
                if kept is None:
                    done.append(top.close())
                    above.adopt(top)
                else:
                    kept.append(top)
                top = above
            tops[i] = top

        open_[0] = first
        open_[n - 1] = last if n > 1 else both
        deep = self.edges()
        for i in np.argsort(-deep, kind="stable").tolist():
            x, y, depth = find(i), find(i + 1), int(deep[i])
            rise(x, depth)
            rise(y, depth)
            tops[x].join(tops[y])
            owner[y] = x
            if x in open_ and y in open_:
                open_[x] = both
            elif y in open_:
                open_[x] = open_[y]
        root = find(0)
        rise(root, 0)
        shared = [*both, tops[root]][::-1]
        return Forest(shared + first[::-1], shared + last[::-1], len(shared))

    def ends(self, done: list[tuple]) -> None:
        """For each run of equal conversations, its node's key and the run's ids, written out in order."""
        n = np.diff(self.bounds)
        new = np.flatnonzero(np.concatenate(([True], (self.edges() < n[1:]) | (n[1:] != n[:-1]))))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(n)], strict=True):
            at = int(self.bounds[a + 1]) - 1
            key = (int(self.h1[at]), int(self.h2[at])) if n[a] else (0, 0)
            done.append((int(n[a]), *key, 0, 0, 0, int(self.ids[a]), b - a, 0, 0, 0, -2, 0, ",".join(map(str, self.ids[a:b].tolist()))))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_ROW)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _ROW.values(), strict=True)], names=list(_ROW))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition of sorted conversations: closed nodes and runs of ids block by block, then its contracted forest."""
    whole: Forest | None = None
    for batch in batches:
        bounds = batch.column("seq").offsets.to_numpy().astype(np.int64)
        for cut in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff((bounds[1:] - bounds[0]) // BLOCK_TURNS)) + 1) if batch.num_rows else ():
            part = batch.slice(cut[0], len(cut))
            turns = part.column("seq").flatten()
            own = bounds[cut[0] : cut[-1] + 2] - bounds[cut[0]]
            fields = (turns.field(n).to_numpy(zero_copy_only=False) for n in ("a", "b", "size"))
            block, done = Block(part.column("conv_id").to_numpy(), own, *fields), []
            forest = block.forest(done)
            block.ends(done)
            whole = merge(whole, forest, done) if whole else forest
            yield _batch(done)
    if whole:
        yield _batch(whole.rows(TaskContext.get().partitionId()))


def _merge_parts(last: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        paths: dict[tuple[int, int], list[Node]] = {}
        names = ("depth", "h1", "h2", "p1", "p2", "size", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
        for part, side, *values in sorted(zip(*(table.column(n).to_pylist() for n in ("part", "side", *names)), strict=True)):
            paths.setdefault((part, side), []).append(Node(*values))
        whole, done = None, []
        for part, side in list(paths):
            if not side:
                own, more = paths[part, 0], paths.get((part, 1), [])
                shared = more[0].depth if more else None
                if shared is None:  # the last row ends on the first one's path, or is that row: open to both sides as far as it goes
                    shared = len(own)
                forest = Forest(own, own[:shared] + more, shared)
                whole = merge(whole, forest, done) if whole else forest
        if last:
            close_path(whole.last, whole.shared, done)
            close_path(whole.first, 0, done)
        else:
            done += whole.rows(key[0].as_py())
        return pa.Table.from_batches([_batch(done)])

    return run


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq): each conversation's turns in order of turn (null first; ties by role, then text) as fingerprints and sizes in code points, the first ones from its group's conversation.

    A conversation takes crc32(conv_id as text) % HEADS turns from the one with id conv_id - conv_id % GROUP (all if that has fewer, none if
    there's none), then its own from there on. Null role or text counts as empty; rows without conv_id belong to none.
    """
    body = [F.coalesce(n, F.lit("")) for n in ("role", "text")]
    turns = conversations.where("conv_id is not null").select("conv_id", F.col("turn").cast("bigint").alias("turn"), body[0].alias("role"), body[1].alias("text"))
    # A conversation that holds a large share of all rows is numbered range by range of its turns.
    splits = range_splits(turns, "turn", shuffle_partitions(turns.sparkSession))
    ranged = turns.withColumn("range", range_bucket(F.col("turn"), splits))
    prints = [F.xxhash64(F.lit(seed), "role", "text").alias(n) for seed, n in ((1, "a"), (2, "b"))]
    inside = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy("turn", "role", "text"))
    numbered = ranged.withColumn("k", inside).select("conv_id", "range", "k", *prints, F.length("text").cast("bigint").alias("size"))
    counts = ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = numbered.join(starts, ["conv_id", "range"]).select("conv_id", F.struct((F.col("k") + F.col("before")).alias("k"), "a", "b", "size").alias("turn"))
    whole = placed.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("turn")), lambda t: F.struct(t["a"], t["b"], t["size"])).alias("own"))
    whole = stash(whole, "conversations")
    heads = whole.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("head_id"), F.slice("own", 1, HEADS - 1).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    joined = whole.withColumn("head_id", F.col("conv_id") - F.col("conv_id") % GROUP).join(heads, "head_id", "left")
    none = F.slice("own", 1, 0)
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), taken), F.slice("own", taken + 1, F.size("own"))).alias("seq"))


def _end_hashes(runs: DataFrame) -> DataFrame:
    """(depth, h1, h2, ends_sha256): the hash of each node's runs of ids in order, comma-joined.

    SHA-256 takes its input in one order, so one task reads a node's runs; a run is a row for each block of
    equal conversations, and only the hash's state is held between rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for *own, ids in zip(*(batch.column(n).to_pylist() for n in ("depth", "h1", "h2", "ids")), strict=True):
                if own != key:
                    if state:
                        out.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield made(out)
        yield made([(*key, state.hexdigest())] if state else [])

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*[pa.int64()] * 3, pa.string()], strict=True)], names=["depth", "h1", "h2", "ends_sha256"])

    # A node's runs come from neighbouring ranges of (sequence, conv_id): their first ids ascend.
    dealt = runs.select("depth", "h1", "h2", "conv_id", "ids").repartition(shuffle_partitions(runs.sparkSession), "depth", "h1", "h2")
    return dealt.sortWithinPartitions("depth", "h1", "h2", "conv_id").mapInArrow(run, "depth bigint, h1 bigint, h2 bigint, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """A row per node of the prefix trie of rebuilt conversations (conv_id, turn, role, text): see op12's contract for the columns.

    Equal sequences share all their nodes. A conversation without turns ends at the root, which has depth 0 and no parent. A table
    without conversations gives no rows. Prefixes are told apart by 128-bit keys. Other columns are ignored.
    """
    n = shuffle_partitions(conversations.sparkSession)
    ordered = rebuilt(conversations).repartitionByRange(n, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    level = stash(ordered.mapInArrow(_contract, _SQL_ROW), "forests")
    runs, closed, opened = level.where("part = -2"), [level.where("part = -1")], level.where("part >= 0")
    top = opened.agg(F.max("part").alias("top")).head()["top"]
    while top is not None:
        last = top < FAN
        level = stash(opened.groupBy(F.floor(F.col("part") / FAN).alias("of")).applyInArrow(_merge_parts(last), _SQL_ROW), "forests")
        closed.append(level.where("part = -1"))
        opened, top = level.where("part >= 0"), None if last else top // FAN
    nodes = closed[0]
    for more in closed[1:]:
        nodes = nodes.unionByName(more)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    held = nodes.join(parents, ["depth", "p1", "p2"], "left").join(_end_hashes(runs), ["depth", "h1", "h2"], "left")
    return held.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


#: CRC-32 of an id's digits, a byte and then a bit at a time.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))))"""

SQL = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS head_id, {_CRC} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM own)),
placed AS (
  SELECT c.conv_id, 0 AS part, o.k, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.head_id AND o.k <= c.h
  UNION ALL SELECT c.conv_id, 1, o.k, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.k > c.h),
turns AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS depth FROM placed),
seqs AS (SELECT c.conv_id, coalesce(list(struct_pack(r := t.role, t := t.text) ORDER BY t.depth) FILTER (WHERE t.depth IS NOT NULL), []) AS seq FROM convs c LEFT JOIN turns t USING (conv_id) GROUP BY c.conv_id),
member AS (SELECT conv_id, d AS depth, sha256(seq[1:d]::varchar) || ':' || d AS node, CASE WHEN d > 0 THEN sha256(seq[1:d-1]::varchar) || ':' || (d - 1) END AS above, CASE WHEN d > 0 THEN length(seq[d].t) ELSE 0 END AS size, d = len(seq) AS is_end
  FROM seqs, unnest(range(len(seq) + 1)) AS u(d)),
nodes AS (
  SELECT node, any_value(above) AS above, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
    sha256(coalesce(string_agg(CASE WHEN is_end THEN conv_id::varchar END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM member GROUP BY node),
children AS (SELECT above, count(*) AS n FROM nodes WHERE above IS NOT NULL GROUP BY above),
full_nodes AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.above = n.node),
below AS (SELECT m.node AS top, n.saved, n.n_children = 0 AS leaf FROM full_nodes n JOIN member m ON m.conv_id = n.conv_id AND m.depth <= n.depth),
sums AS (SELECT top, sum(saved)::bigint AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves FROM below GROUP BY top)
SELECT n.conv_id, n.depth::bigint AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON s.top = n.node LEFT JOIN nodes p ON p.node = n.above
"""
