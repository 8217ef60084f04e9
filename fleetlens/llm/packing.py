"""Best-fit packing of token sequences, planned on a histogram of lengths.

Pieces are at most CAPACITY tokens, so a histogram has at most CAPACITY counts however large the
corpus is. Best fit runs over those counts, longest first: equal bins are held as one group with
a count, and a length goes to the fullest bins that take it, whole groups at a time. The plan is
a short list of runs (length, ranks, sequences, offset); pieces take their slots by joining on
their length and their rank among pieces of that length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, rank_within, stash
from .tokens import encoder, with_end

CAPACITY = 2048


def pieces(docs: DataFrame, tokenizer: str, end_id: int | None = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids, cut into capacity-token pieces if longer.

    Null text counts as empty: end_id alone, or no piece if there is none. Rows that repeat a
    doc_id are documents of their own, with pieces of the same names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            doc, i, rows = batch.column("doc_id").to_pylist(), 0, []
            for ids, bounds in enc.encode(batch.column("text")):
                ids, bounds = with_end(ids, bounds, end_id)
                raw, ends = memoryview(ids.astype("<u4").tobytes()), bounds.tolist()
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    rows.extend((doc[i], (k - a) // capacity, k - a, min(capacity, b - k), zlib.crc32(raw[4 * k : 4 * min(b, k + capacity)])) for k in range(a, b, capacity))
                    i += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
            give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, ranks, first sequence, per sequence, offset) that place all pieces.

    Rank r of a run sits in sequence first + (r - first rank) // per at offset + length * ((r -
    first rank) % per). Best fit decreasing: a piece goes to the bin with the least room that takes it.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> groups (first sequence, bins)
    rooms: list[int] = []  # a heap can't be searched from a value: kept sorted instead
    made = 0

    import bisect

    def put(left: int, first: int, bins: int) -> None:
        if left and bins:
            if left not in room:
                bisect.insort(rooms, left)
                room[left] = []
            heapq.heappush(room[left], (first, bins))

    for length in sorted((x for x, n in histogram.items() if n and x > 0), reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, bins = heapq.heappop(room[left])
                if not room[left]:
                    del room[left]
                    rooms.pop(at)
            else:
                left = capacity
                first, bins = made, -(-todo // (capacity // length))
                made += bins
            per = left // length
            full, rest = divmod(min(todo, bins * per), per)
            offset = capacity - left
            if full:
                runs.append((length, rank, full * per, first, per, offset))
                put(left - per * length, first, full)
            if rest:
                runs.append((length, rank + full * per, rest, first + full, rest, offset))
                put(left - rest * length, first + full, 1)
            put(left, first + full + bool(rest), bins - full - bool(rest))
            rank += full * per + rest
            todo -= full * per + rest
    return runs


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (doc_id, piece, length, ...) + sequence_id, offset. Rows must be stored: they are read three times.

    Pieces of length 0 need no room and are left out. Only the histogram (at most capacity rows) reaches the driver.
    """
    spark = rows.sparkSession
    rows = rows.where("length > 0")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(plan(counts, capacity) or [(0, 0, 0, 0, 1, 0)], "length long, __rank long, __n long, __first long, __per long, __offset long")
    ranked = rank_within(rows, ["length"], ["doc_id", "piece"], "__k")
    within = F.col("__k") - F.col("__rank")
    # The plan follows from at most capacity counts, so its size is bounded by the capacity, not by the corpus.
    held = ranked.join(F.broadcast(slots), "length").where((within >= 0) & (within < F.col("__n")))
    return held.select(*[ranked[c] for c in rows.columns], (F.col("__first") + F.floor(within / F.col("__per"))).alias("sequence_id"), (F.col("__offset") + F.col("length") * (within % F.col("__per"))).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 0, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize docs (doc_id, text) and pack all their pieces."""
    return pack(stash(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
