"""Exact Jaccard self-join of documents on word 5-grams, and the classes its links make.

1. Equal texts count once. A text's set is the hashes of its shingles; its *prefix* is its
   n - ceil(3n/4) + 1 rarest (frequent shingles, found on a sample, sort last; the rest by hash), so two
   linked documents share a prefix shingle whatever the order was.
2. Documents meet in the lists of their prefix shingles. First each is compared with its
   list's first document only; the links found already join most copies.
3. Lists whose documents are still in several classes, if longer than a tile, are cut into bands of set size,
   such that partners lie in the same band or the next, and each band into tiles, ordered by class. Within a tile and
   between tiles of such bands, parity bitmaps bound the overlap from above by bit counts: bits that
   differ are shingles that differ, and J >= 3/4 allows (|A| + |B|) / 7 of those. Pairs that survive
   and lie in different classes are settled by intersecting the sorted arrays of their shingles.
   A first round takes the nearest few candidates of each document, a second all those of lists where there were more.
   Comparing all of these makes the classes exact; pairs inside a class could add nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NULL_ID, give_back, range_bucket, stash, told_apart

#: Words in a shingle; two sets link if DEN * intersection >= NUM * union (the prefix and the bound on differing bits are for 3/4).
SHINGLE, NUM, DEN = 5, 3, 4
#: One document in so many is looked at for frequent shingles; those in LEAST_SEEN of them or more, the most frequent first, up to MOST_FREQUENT.
#: This steers only the order of shingles, never which links are found.
SAMPLE_RATE, LEAST_SEEN, MOST_FREQUENT = 40, 4, 200_000
#: Documents in a tile; candidates a document keeps in the first of the two tiled rounds (the second keeps all).
TILE, FIRST_CANDIDATES = 1024, 8
#: Rows of a band of a list that one task orders; longer ones are ordered in parts.
ORDERED = 1 << 16
#: Up to so many ids (8 bytes each) are broadcast to pick their documents; more are joined by shuffle.
BROADCAST_IDS = 500_000

_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: A-Z lower-cased, words split at ASCII white space; fewer than five words: the sequence as one; none: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    one = xxhash.xxh3_64_intdigest
    w = np.fromiter(map(one, words), dtype=np.uint64, count=len(words))
    n = len(w) - SHINGLE + 1
    s = np.zeros(n, dtype=np.uint64)
    for j in range(SHINGLE):
        s = (s ^ (w[j : j + n] + _P[j])) * _P[0]
        s ^= s >> np.uint64(29)
    return np.unique(s)


def prefix(s: np.ndarray, frequent: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The rarest n - ceil(3n/4) + 1 of a set."""
    n = len(s)
    size = n - (NUM * n + DEN - 1) // DEN + 1 if n else 0
    if not len(frequent):
        return s[:size]
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    rank = np.where(frequent[at] == s, seen[at], 0)
    return s[np.lexsort((s, rank))[:size]]


def bands() -> list[int]:
    """The least size of each band of set sizes after the first: partners of a size in one band lie in it, the next or the one before."""
    edges = [1]
    while edges[-1] < 1 << 31:
        edges.append(edges[-1] * DEN // NUM + 1)
    return edges


def width(n: int) -> int:
    """Bits of the bitmap of n shingles: at least twice as many, a power of two."""
    return max(64, 1 << (2 * n - 1).bit_length()) if n else 64


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each bit; the low bits of a hash pick it, so halves fold by exclusive or."""
    w = width(len(s))
    return np.packbits((np.bincount((s & np.uint64(w - 1)).astype(np.int64), minlength=w) & 1).astype(np.uint8), bitorder="little").tobytes()


def differ(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of |A - B| + |B - A| from two bitmaps (arrays of 64-bit words)."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _map_texts(docs: DataFrame, fields: list[tuple[str, pa.DataType, str]], make) -> DataFrame:
    """(id, fields) from make(set of the text) for rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                rows = [make(shingles(t)) for t in part.column("text").to_pylist()]
                columns = [pa.array([r[k] for r in rows], kind) for k, (_, kind, _) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=["id", *(f[0] for f in fields)])
            give_back()

    return docs.select("id", "text").mapInArrow(run, "id long, " + ", ".join(f"{n} {t}" for n, _, t in fields))


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, times seen) that many documents of a sample share."""
    some = docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE_RATE)) == 0)
    found = _map_texts(some, [("s", pa.list_(pa.int64()), "array<bigint>")], lambda s: (s.view(np.int64),)).select(F.explode("s").alias("s"))
    rows = found.groupBy("s").count().where(F.col("count") >= LEAST_SEEN).orderBy(F.desc("count"), "s").limit(MOST_FREQUENT).collect()
    s = np.array([r["s"] for r in rows], dtype=np.int64).view(np.uint64)
    seen = np.array([r["count"] for r in rows], dtype=np.int64)
    order = np.argsort(s)
    return s[order], seen[order]


def _only(docs: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of docs whose key is in ids (a stored table), without shuffling text while ids are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, key, "left_semi")


def classes(links: DataFrame) -> DataFrame:
    """(id, class) for the ends of links (a, b): class is the smallest id that can be reached.

    Each round, every class hooks on to its smallest neighbour, pointers are doubled up to
    the roots, and links are mapped to classes; links inside a class go. Rounds are
    logarithmic in the longest path; nothing is collected.
    """
    edges = stash(links.select("a", "b").where("a <> b").distinct(), "links")
    held = stash(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("class", F.col("id")), "classes")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("p"))
        hooks = stash(hooks, "hooks")
        while True:
            up = hooks.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            jumped = stash(hooks.join(up, "p").select("c", F.col("pp").alias("np"), (F.col("pp") != F.col("p")).alias("moved")), "hooks")
            hooks = jumped.select("c", F.col("np").alias("p"))
            if jumped.where("moved").isEmpty():
                break
        root = hooks.withColumnRenamed("c", "class")
        held = stash(held.join(root, "class", "left").select("id", F.coalesce("p", "class").alias("class")), "classes")
        a, b = hooks.select(F.col("c").alias("a"), F.col("p").alias("ra")), hooks.select(F.col("c").alias("b"), F.col("p").alias("rb"))
        edges = stash(edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    return held


def _by_key(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of one key after another, of batches sorted by it."""
    kept: pa.RecordBatch | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if kept is not None:
            batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        cuts = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1).tolist()]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(lo, hi - lo)
        kept = batch.slice(cuts[-1])
    if kept is not None:
        yield kept


def _words(column: pa.Array) -> list[np.ndarray]:
    """The 64-bit words of each value of a binary column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return [data[lo:hi].view(np.uint64) for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]


def compare_tile(ids: np.ndarray, n: np.ndarray, group: np.ndarray, tile: np.ndarray, bits: list[np.ndarray], cross: bool, keep: int | None, cut: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of ids (smaller first) that sizes n, classes and bitmaps let pass, only between tiles if cross; the nearest `keep` of each document.

    cut gets the ids of documents that had more than `keep`.
    """
    order = np.argsort(n, kind="stable")
    ids, n, group, tile = ids[order], n[order].astype(np.int64), group[order], tile[order]
    tops = np.searchsorted(n, n * DEN // NUM, side="right")  # partners of k are k + 1 to tops[k] - 1
    if (tops == np.arange(1, len(n) + 1)).all():
        return []
    maps = [bits[k] for k in order]
    lengths = np.array([len(m) for m in maps])
    stacks: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # band: rows of that width or twice that, folded to it
    for w in set(lengths.tolist()):
        at = np.flatnonzero((lengths == w) | (lengths == 2 * w))
        stacks[w] = at, np.stack([maps[k] if lengths[k] == w else maps[k][:w] ^ maps[k][w:] for k in at])
    found = []
    for k in range(len(n) - 1):
        at, own = stacks[lengths[k]]
        lo, hi = np.searchsorted(at, (k + 1, tops[k]))
        j = at[lo:hi]
        ok = group[j] != group[k]
        if cross:
            ok &= tile[j] != tile[k]
        if not ok.any():
            continue
        far = np.bitwise_count(own[lo:hi][ok] ^ maps[k]).sum(axis=1).astype(np.int64)
        j = j[ok]
        near = 7 * far <= n[j] + n[k]
        j, far = j[near], far[near]
        if keep and len(j) > keep:
            j = j[np.argsort(far, kind="stable")[:keep]]
            if cut is not None:
                cut.append(int(ids[k]))
        found.extend((int(min(ids[k], ids[x])), int(max(ids[k], ids[x]))) for x in j)
    return found


def _tiled(lists: DataFrame, sets: DataFrame, known: DataFrame, keep: int | None) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs that survive the bitmaps in lists (token, id, n) whose documents are in several classes; and the rows of lists still to compare.

    Those are the lists in which a document had more than `keep` partners. In any other, all pairs that may link are among the
    pairs returned, and a list whose documents are in one class stays so: a later round needs neither.
    """
    labelled = lists.join(known, "id", "left").select("token", "id", "n", F.coalesce("class", "id").alias("class"))
    labelled = stash(labelled, "lists")
    shape = labelled.groupBy("token").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("h2"))
    # Shingles of one passage have the same list of documents: one of them does.
    open_lists = stash(shape.where("lo <> hi").groupBy("m", "h1", "h2").agg(F.min("token").alias("token")), "open")
    rows = labelled.join(open_lists.select("token", "m", F.ceil(F.col("m") / ORDERED).alias("parts")), "token")
    # A list that fits one tile is one; compare_tile minds sizes there.
    rows = rows.withColumn("band", F.when(F.col("m") > TILE, range_bucket(F.col("n").cast("long"), bands())).otherwise(F.lit(0))).drop("m")
    # A class stays in one part of its list, unless the list is long; then it may lie in several, which costs comparisons but loses none.
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("class", F.pmod("id", "parts")), "parts")).otherwise(F.lit(0))
    order = Window.partitionBy("token", "band", "part").orderBy("class", "id")
    place = F.struct("part", F.floor((F.row_number().over(order) - 1) / TILE).cast("int").alias("at"))
    rows = stash(rows.withColumn("part", part.cast("int")).withColumn("tile", F.struct("band", place.alias("place"))).drop("parts", "part", "band"), "tiles")
    tiles = rows.groupBy("token", "tile").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
    other = tiles.select("token", F.col("tile").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = tiles.join(other, "token").where("tile <= j and j.band - tile.band <= 1 and not (lo = hi and lo2 = hi2 and lo = lo2)").select("token", F.col("tile").alias("i"), "j")
    pairs = pairs.select("*", F.xxhash64("i", "j").alias("pair"))
    sides = pairs.select("token", F.col("i").alias("tile"), "pair", F.lit(False).alias("second")).unionByName(pairs.where("i < j").select("token", F.col("j").alias("tile"), "pair", F.lit(True).alias("second")))
    met = rows.join(sides, ["token", "tile"]).select("id", "n", "class", "token", "pair", "second").join(sets.select("id", "bits"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, ["token", "pair"]):
            ids, n, group, tile = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("id", "n", "class", "second"))
            cross, cut = bool(tile.any()), []
            if found := compare_tile(ids, n, group, tile, _words(rows.column("bits")), cross, keep, cut):
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], names=["a", "b", "cut"])
            if cut:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), rows.column("token").slice(0, 1)], names=["a", "b", "cut"])
        give_back()

    dealt = met.repartition("token", "pair").sortWithinPartitions("token", "pair")
    made = stash(dealt.mapInArrow(run, "a long, b long, cut long"), "met")
    cut = made.where("cut is not null").select(F.col("cut").alias("token")).distinct()
    return made.where("cut is null").select("a", "b").distinct(), rows.select("token", "id", "n").join(cut, "token", "left_semi")


def _bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that the bitmaps let pass."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    held = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {k: batch.column(k).to_pylist() for k in ("na", "nb", "bitsa", "bitsb")}
            ok = [7 * differ(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) <= x + y for x, y, p, q in zip(c["na"], c["nb"], c["bitsa"], c["bitsb"], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
            give_back()

    return held.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, "a long, b long")


def _exact(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of a stored table that link, by intersecting their sets; only the texts named are read into sets again."""
    ids = stash(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "named")
    arrays = stash(_map_texts(_only(docs, ids), [("s", pa.list_(pa.int64()), "array<bigint>")], lambda s: (s.view(np.int64),)), "arrays")
    side = lambda x: arrays.select(F.col("id").alias(x), F.col("s").alias(f"s{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [_lists(batch.column(c)) for c in ("sa", "sb")]
            ok = [linked(x, y) for x, y in zip(*sides, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
            give_back()

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The sorted arrays of a list column."""
    ends, data = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
    return [data[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets link. Merged and sorted again (runs are merged, not sorted anew), what both hold stands twice."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return DEN * common >= NUM * (len(both) - common)


def components(docs: DataFrame) -> DataFrame:
    """(id, n, class) for each row of docs (id, text), no id null or twice: the size of its set and the smallest id that links reach.

    Null or wordless text: an empty set, linked with nothing. Equal texts are linked.
    """
    docs = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    keys = stash(docs.select("id", F.md5("text").alias("key")), "keys")
    firsts = stash(keys.groupBy("key").agg(F.min("id").alias("id")), "firsts")
    texts = _only(docs, firsts.select("id"))
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(texts))
    fields = [("n", pa.int32(), "int"), ("prefix", pa.list_(pa.int64()), "array<bigint>"), ("bits", pa.binary(), "binary")]
    sets = stash(_map_texts(texts, fields, lambda s: (len(s), prefix(s, *frequent.value).view(np.int64), bitmap(s))), "sets")

    order = Window.partitionBy("token").orderBy("id")
    tokens = sets.select("id", "n", F.explode("prefix").alias("token"))
    met = tokens.withColumns({"first": F.first("id").over(order), "first_n": F.first("n").over(order), "next": F.lead("id").over(order)})
    lists = stash(met.where("id <> first or next is not null").drop("next"), "lists")

    near = f"{DEN} * least(n, first_n) >= {NUM} * greatest(n, first_n)"
    tried = stash(_bounded(lists.where("id <> first").where(near).select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), sets), "tried")
    links = stash(_exact(tried, docs), "links")
    open_rows = lists.select("token", "id", "n")
    for keep in (FIRST_CANDIDATES, None):
        known = classes(links)
        met, open_rows = _tiled(open_rows, sets, known, keep)
        fresh = stash(met.join(tried, ["a", "b"], "left_anti"), "fresh")
        found = stash(_exact(fresh, docs), "found")
        links, tried = links.union(found), tried.union(fresh)
    known = classes(links)
    per_text = firsts.join(sets.select("id", "n"), "id").join(known, "id", "left").select("key", F.col("n").cast("long").alias("n"), F.coalesce("class", "id").alias("class"))
    return keys.join(per_text, "key").select("id", "n", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("class")).alias("class"))


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text).

    Null or wordless text: an empty set, linked with nothing, its own component. Equal texts are
    linked. A null id is the smallest. Rows that repeat an id are documents of their own: they share
    a component only if their texts' links say so.
    """
    docs, repeated = told_apart(docs.select("doc_id", "text"))
    out = components(docs.select(F.col("__row").alias("id"), "text"))
    if repeated:
        own = docs.select(F.col("__row").alias("id"), "doc_id")
        firsts = docs.select(F.col("__row").alias("class"), F.col("doc_id").alias("component_id"))
        return out.join(own, "id").join(firsts, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("id").alias("doc_id"), F.col("n").alias("n_shingles"), real("class").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, that of its smallest doc_id (one of them, if it repeats); columns as they were."""
    docs, _ = told_apart(docs)
    kept = stash(components(docs.select(F.col("__row").alias("id"), "text")).where("id = class").select(F.col("id").alias("__row")), "kept")
    return _only(docs, kept, "__row").select(*docs.columns).drop("__row")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, CAST(len(ws) - 3 AS BIGINT)), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
l AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id
"""
