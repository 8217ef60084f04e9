"""Hard negatives from candidate blocks in Hilbert order with zone maps.

Rows are ordered by label and by the place of their vector on a Hilbert curve over all dimensions and
cut into Parquet blocks of at most BLOCK rows of one label. A block's zone map is the least and greatest value
of each dimension. For an anchor a and a zone [lo, hi], interval arithmetic bounds every inner
product in the block: sum(max(a*lo, a*hi)) from above, sum(min(a*lo, a*hi)) from below. An anchor reads a
block only if these bounds meet one of its windows of scores that are still wanted.

Anchors are held in groups in the same order, zones in pages. A search runs twice: at first each anchor
reads, of each page, the block with the highest bound; the scores found narrow its windows from below, and
the second time it reads all blocks whose bounds meet what is left. So results are those of a full scan.
Positives are searched among blocks of the anchor's label, negatives among the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NULL_ID, shuffle_partitions, stash

#: Rows of a block, anchors of a group, zones of a page; bits of each dimension on the curve.
BLOCK, GROUP, PAGE, BITS = 256, 128, 64, 4
#: Found candidates that a task holds before it keeps the best of them; rows with a group and a block that go to Python at once.
HELD, WIDE = 500_000, 200
_LEAST, _MOST = -(2**63), 2**63 - 1
#: Magnitudes up to which sums of products are exact in 64-bit floats, for up to 8,192 dimensions. Larger ones are multiplied as Python integers.
_EXACT = 1 << 20


def hilbert_keys(points: np.ndarray, scale: int) -> np.ndarray:
    """The place of each row of points (values from -scale to scale) on a Hilbert curve, BITS bits a dimension, as bytes in order.

    The curve's index is found by undoing its rotations from the coarsest bit on, then by Gray coding
    (J. Skilling, Programming the Hilbert curve, 2004).
    """
    n, d = points.shape
    x = np.clip((points.astype(np.float64) + scale) * ((1 << BITS) / (2 * scale + 1)), 0, (1 << BITS) - 1).astype(np.uint8).T.copy()
    for bit in range(BITS - 1, 0, -1):
        below = np.uint8((1 << bit) - 1)
        for i in range(d):
            high = (x[i] >> bit) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            if i:
                x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, dtype=np.uint8)
    for bit in range(BITS - 1, 0, -1):
        turn ^= np.where((x[-1] >> bit) & 1 == 1, np.uint8((1 << bit) - 1), np.uint8(0)) if d else np.uint8(0)
    x ^= turn
    bits = np.stack([(x >> b) & 1 for b in range(BITS - 1, -1, -1)])  # bit, dimension, row
    return np.packbits(bits.reshape(BITS * d, n), axis=0).T


def _matrix(vectors: pa.Array, d: int) -> np.ndarray:
    """Rows of d integers; shorter vectors are filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy()
    if np.all(sizes == d):
        return flat.reshape(len(vectors), d)
    out = np.zeros((len(vectors), d), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _key(d: int, scale: int) -> Column:
    @F.arrow_udf("binary")
    def key(q: pa.Array) -> pa.Array:
        return pa.array([x.tobytes() for x in hilbert_keys(_matrix(q, d), scale)], pa.binary())

    return key("q")


def _blocks(rows: DataFrame, d: int, scale: int, kind: str, every: int) -> DataFrame:
    """A row per block: pid and i (its place), label, ids, q (a matrix), lo, hi (the zone map), anchors (places in the block) and first_anchor (how many the partition has before). Rows of a block ascend by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, number, anchors, left = TaskContext.get().partitionId(), 0, 0, None

        def cut(ids: np.ndarray, label: int, q: np.ndarray) -> pa.RecordBatch:
            nonlocal number, anchors
            order = np.argsort(ids, kind="stable")
            ids, q = ids[order], q[order]
            own = np.flatnonzero((ids % every == 0) & (ids != NULL_ID))
            row = [pid, number, label, ids, q.astype(kind).tobytes(), q.min(axis=0).astype(kind).tobytes(), q.max(axis=0).astype(kind).tobytes(), own, anchors]
            number, anchors = number + 1, anchors + len(own)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

        names = ["pid", "i", "label", "ids", "q", "lo", "hi", "anchors", "first_anchor"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
        for batch in batches:
            own = (batch.column("id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("q"), d))
            ids, labels, q = (np.concatenate(x) for x in zip(left, own, strict=True)) if left else own
            edges = np.concatenate(([0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)])) if len(labels) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                full = range(a, b - BLOCK + 1, BLOCK)
                for k in full:
                    yield cut(ids[k : k + BLOCK], int(labels[a]), q[k : k + BLOCK])
                rest = a + len(full) * BLOCK
                if b < len(labels) and rest < b:
                    yield cut(ids[rest:b], int(labels[a]), q[rest:b])
                left = (ids[rest:b], labels[rest:b], q[rest:b])
        if left and len(left[0]):
            yield cut(left[0], int(left[1][0]), left[2])

    n = shuffle_partitions(rows.sparkSession)
    ordered = rows.withColumn("key", _key(d, scale)).repartitionByRange(n, "label", "key", "id").sortWithinPartitions("label", "key", "id")
    return ordered.select("id", "label", "q").mapInArrow(run, "pid bigint, i bigint, label bigint, ids array<bigint>, q binary, lo binary, hi binary, anchors array<bigint>, first_anchor bigint")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b."""
    if a.size == 0 or b.size == 0 or max(np.abs(a).max(), np.abs(b).max()) <= _EXACT:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a.astype(object) @ b.astype(object).T


def _int64(scores: np.ndarray) -> np.ndarray:
    return np.array([min(max(x, _LEAST), _MOST) for x in scores], dtype=np.int64) if scores.dtype == object else scores.astype(np.int64)


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of a with any vector of each zone [lo, hi]."""
    plus, minus = np.maximum(a, 0), np.minimum(a, 0)
    return _product(plus, lo) + _product(minus, hi), _product(plus, hi) + _product(minus, lo)


class _Wanted:
    """A group's anchors and their windows, from a row's columns."""

    def __init__(self, anchors: list[dict], windows: list[dict], d: int, kind: str) -> None:
        self.number = np.array([x["number"] for x in anchors], dtype=np.int64)
        self.label = np.array([x["label"] for x in anchors], dtype=np.int64)
        self.q = np.frombuffer(b"".join(x["q"] for x in anchors), kind).reshape(len(anchors), d).astype(np.int64)
        self.slot, self.w, self.lo, self.hi = (np.array([x[n] for x in windows], dtype=np.int64) for n in ("slot", "w", "lo", "hi"))


def _choose(d: int, kind: str, same: bool, first: bool):
    """From rows (group, anchors, windows, zones): (group, block, slots), the anchors that must read a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                group, anchors, windows, zones = (batch.column(n)[i].as_py() for n in ("group", "anchors", "windows", "zones"))
                want = _Wanted(anchors, windows, d, kind)
                lo, hi = (np.frombuffer(b"".join(z[n] for z in zones), kind).reshape(len(zones), d).astype(np.int64) for n in ("lo", "hi"))
                least, most = bounds(want.q, lo, hi)
                fits = (least[want.slot] <= want.hi[:, None]) & (most[want.slot] >= want.lo[:, None])
                reads = np.zeros((len(anchors), len(zones)), dtype=bool)
                np.logical_or.at(reads, want.slot, fits)
                reads &= (want.label[:, None] == np.array([z["label"] for z in zones], dtype=np.int64)) == same
                if first:
                    best = np.argmax(np.where(reads, most, -np.inf), axis=1)
                    reads &= np.arange(len(zones)) == best[:, None]
                own = np.flatnonzero(reads.any(axis=0))
                slots = [np.flatnonzero(reads[:, k]) for k in own]
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(own), pa.int64()), pa.array([zones[k]["block"] for k in own], pa.int64()), pa.array(slots, pa.list_(pa.int64()))], names=["group", "block", "slots"])

    return run


def _best(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of columns (group, slot, w, score, id), the first k of each window: highest score first, ties by id."""
    group, slot, w, score, ids = found
    order = np.lexsort((ids, ~score, w, slot, group))
    group, slot, w, score, ids = (x[order] for x in found)
    new = np.flatnonzero(np.concatenate(([True], (np.diff(group) != 0) | (np.diff(slot) != 0) | (np.diff(w) != 0)))) if len(group) else np.zeros(0, np.int64)
    rank = np.arange(len(group)) - np.repeat(new, np.diff(np.append(new, len(group))))
    return [x[rank < k] for x in (group, slot, w, score, ids)]


def _score(d: int, kind: str, k: int):
    """From rows (group, anchors, windows, slots, block, ids, q): (group, slot, w, score, id), the best k of each window that the task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def best() -> list[np.ndarray]:
            return _best([np.concatenate(x) for x in zip(*held, strict=True)], k)

        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                group, block, anchors, windows, slots, raw = (batch.column(n)[i].as_py() for n in ("group", "block", "anchors", "windows", "slots", "q"))
                want, ids = _Wanted(anchors, windows, d, kind), np.asarray(batch.column("ids")[i].values.to_numpy())
                scores = _product(want.q[slots], np.frombuffer(raw, kind).reshape(len(ids), d).astype(np.int64))
                own = want.number[slots]
                mine = np.flatnonzero(own // BLOCK == block)
                scores[mine, own[mine] % BLOCK] = -np.inf  # an anchor is no partner of its own
                place = np.full(len(anchors), -1)
                place[slots] = np.arange(len(slots))
                asked = np.flatnonzero(place[want.slot] >= 0)
                seen = scores[place[want.slot[asked]]]
                seen = np.where((seen >= want.lo[asked, None]) & (seen <= want.hi[asked, None]), seen, -np.inf)
                for _ in range(min(k, len(ids))):  # columns ascend by id, and argmax takes the first of equals
                    at = np.argmax(seen, axis=1)
                    top = seen[np.arange(len(asked)), at]
                    real = np.flatnonzero(top > -np.inf)
                    if not len(real):
                        break
                    n = len(real)
                    held.append([np.full(n, group), want.slot[asked[real]], want.w[asked[real]], _int64(top[real]), ids[at[real]]])
                    size += n
                    seen[np.arange(len(asked)), at] = -np.inf
                if size > HELD:
                    held[:] = [best()]
                    size = len(held[0][0])
                    if size > HELD // 2:  # of that many windows: send them on
                        yield made(held.pop())
                        size = 0
        if held:
            yield made(best())

    def made(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["group", "slot", "w", "score", "id"])

    return run


class _Index:
    """Blocks, pages of zones and groups of anchors, all stored."""

    def __init__(self, rows: DataFrame, every: int) -> None:
        shape = rows.agg(F.max(F.size("q")).alias("d"), F.max(F.greatest(F.abs(F.array_max("q")), F.abs(F.array_min("q")))).alias("scale")).head()
        self.d, scale = shape["d"] or 0, shape["scale"] or 0
        self.kind = "<i2" if scale < 1 << 15 else "<i8"
        made = stash(_blocks(rows, self.d, scale, self.kind, every), "blocks")
        # Blocks and anchors are numbered through: a table with a row per partition says where each begins.
        counts = made.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("anchors")).alias("m"))
        before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("pid", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "nm"))
        numbered = made.join(F.broadcast(starts), "pid").withColumn("block", F.col("n0") + F.col("i"))
        self.blocks = made.join(F.broadcast(starts), "pid").select((F.col("n0") + F.col("i")).alias("block"), "ids", "q")
        zone = F.struct("block", "label", "lo", "hi")
        self.pages = stash(numbered.groupBy(F.floor(F.col("block") / PAGE).alias("page")).agg(F.array_sort(F.collect_list(zone)).alias("zones")), "zones")
        width = self.d * int(self.kind[2])
        each = numbered.select("block", "label", "ids", "q", (F.col("m0") + F.col("first_anchor")).alias("m"), F.posexplode("anchors").alias("k", "at"))
        own = each.select(
            F.floor((F.col("m") + F.col("k")) / GROUP).alias("group"),
            F.struct(((F.col("m") + F.col("k")) % GROUP).alias("slot"), (F.col("block") * BLOCK + F.col("at")).alias("number"), F.get("ids", F.col("at").cast("int")).alias("id"), "label", F.substring("q", F.col("at").cast("int") * width + 1, F.lit(width)).alias("q")).alias("anchor"),
        )
        self.groups = stash(own.groupBy("group").agg(F.array_sort(F.collect_list("anchor")).alias("anchors")), "anchors")
        self.n_pages = self.pages.count()

    def search(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """(group, slot, w, score, id, rank): the first k rows of each window (group, slot, w, lo, hi), among blocks of the anchor's label or of others."""
        seen = self._pass(windows, k, same, True)
        # A window with k rows wants nothing below the last of them.
        last = seen.groupBy("group", "slot", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
        narrow = windows.join(last, ["group", "slot", "w"], "left").select("group", "slot", "w", F.greatest("lo", F.coalesce("least", "lo")).alias("lo"), "hi")
        return self._pass(stash(narrow, "windows"), k, same, False)

    def _pass(self, windows: DataFrame, k: int, same: bool, first: bool) -> DataFrame:
        asked = windows.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("slot", "w", "lo", "hi"))).alias("windows"))
        wanted = stash(self.groups.join(asked, "group"), "wanted")
        # The query set against all zones, page by page.
        paired = wanted.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(max(self.n_pages - 1, 0))))).join(self.pages, "page")
        chosen = paired.select("group", "anchors", "windows", "zones").mapInArrow(_choose(self.d, self.kind, same, first), "group bigint, block bigint, slots array<bigint>")
        reads = stash(chosen, "chosen", WIDE).join(wanted, "group").join(self.blocks, "block")
        found = reads.select("group", "block", "anchors", "windows", "slots", "ids", "q").mapInArrow(_score(self.d, self.kind, k), "group bigint, slot bigint, w bigint, score bigint, id bigint")
        order = Window.partitionBy("group", "slot", "w").orderBy(F.desc("score"), "id")
        return stash(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "found", WIDE)


def mine(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from embeddings (vec_id, label, embedding).

    Anchors are the rows whose vec_id is divisible by `every`; an anchor's positives are its first other rows
    of the same label. For each of them, the first rows of other labels whose score is from low % to high % of the
    positive's. Scores are inner products of components floor(256 * x); higher ones come first, ties by smaller vec_id (a null one first).

    Rows with a null label, a null vector, or a null or non-finite component take no part. Shorter vectors count as
    filled up with zeros. Rows that repeat a vec_id are rows of their own: each may be an anchor, a positive and a negative. Positives with a
    negative score have no negatives. Components beyond 64 bits and scores beyond 64 bits are cut off there. Without anchors there are no rows; other columns are ignored.
    """
    real = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    taken = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & real)
    # floor() of a double beyond 64 bits gives the nearest 64-bit integer; the lowest is left out, so that each has a magnitude.
    component = lambda x: F.greatest(F.floor(x.cast("double") * 256), F.lit(_LEAST + 1))
    rows = stash(taken.select(F.coalesce("vec_id", F.lit(NULL_ID)).alias("id"), F.col("label").cast("bigint").alias("label"), F.transform("embedding", component).alias("q")), "vectors")
    index = _Index(rows, every)
    names = index.groups.select("group", F.inline("anchors")).select("group", "slot", F.col("id").alias("anchor_id"))
    all_ = names.select("group", "slot", F.lit(0).cast("bigint").alias("w"), F.lit(_LEAST).alias("lo"), F.lit(_MOST).alias("hi"))
    near = index.search(all_, positives, True).select("group", "slot", F.col("rank").cast("bigint").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    wide = F.col("positive_score").cast("decimal(38,0)")
    window = near.where("positive_score >= 0").select("group", "slot", "w", F.ceil(wide * low / 100).cast("bigint").alias("lo"), F.floor(wide * high / 100).cast("bigint").alias("hi"))
    hard = index.search(window.where("lo <= hi"), negatives, False).withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score")
    id_of = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    return hard.join(near, ["group", "slot", "w"]).join(names, ["group", "slot"]).select("anchor_id", id_of("positive_id"), "rank", id_of("negative_id"), "positive_score", "negative_score")


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::bigint + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::bigint AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score)
SELECT anchor_id, positive_id, rank::int AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
