"""Token-id files in Simple-8b: word-aligned packing of ids into 64-bit words.

A word's top four bits select how many ids its other 60 bits hold, and how wide each is.
Selector 15 is an escape: the next word is one id as it is. Ids are cut into blocks of BLOCK;
each block starts on a word of its own, at an offset that is stored, so that all words of
a chunk are decoded at once by array operations. The files are Parquet, a row per chunk of
whole documents: their ids and lengths, block offsets and words; Spark's committer makes the
write safe against lost executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, give_back, range_bucket, range_splits, shuffle_partitions
from .tokens import encoder, with_end

#: Fixed values of the format: (ids in a word, bits of each) by selector 0 to 14; 15 is the escape.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30))
ESCAPE = 15
#: Ids per block; a chunk is closed once it has so many ids.
BLOCK, CHUNK_IDS = 1024, 1 << 18
SCHEMA = "first_doc long, n_ids long, doc_ids array<long>, lengths array<int>, block_offsets binary, words binary"


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offset of each block's first word) of ids (unsigned, up to 64 bits)."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    words, offsets, total = [], [], 0
    for i in range(0, len(ids), CHUNK_IDS):  # bounded work space; CHUNK_IDS is a multiple of BLOCK
        w, o = _encode_some(ids[i : i + CHUNK_IDS])
        words.append(w)
        offsets.append(o + total)
        total += len(w)
    return (np.concatenate(words), np.concatenate(offsets).astype(np.uint32)) if words else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))


#: Blocks lie so far apart in work arrays: by the most ids a word can hold, so that a block's last word reads past its ids.
APART = BLOCK + SELECTORS[0][0]


def _selectors(ids: np.ndarray) -> np.ndarray:
    """The selector of the word that would begin at each id (blocks APART apart, zeros between): the one that takes most ids."""
    selector = np.full(len(ids), ESCAPE, dtype=np.int8)
    width = np.frexp(ids.astype(np.float64))[1].astype(np.int8)  # bits that an id needs; exact wherever it matters, up to 30
    for s in range(len(SELECTORS) - 1, -1, -1):
        count, bits = SELECTORS[s]
        fits, have = width <= bits, 1
        while have < count:  # fits[i]: `have` ids from i on are narrow enough
            step = min(have, count - have)
            fits, have = fits[:-step] & fits[step:], have + step
        np.putmask(selector[: len(fits)], fits, s)
    return selector


def _encode_some(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(ids)
    blocks = -(-n // BLOCK)
    apart = np.zeros((blocks, APART), dtype=np.uint64)
    filled = np.zeros(blocks * BLOCK, dtype=np.uint64)
    filled[:n] = ids
    apart[:, :BLOCK] = filled.reshape(-1, BLOCK)
    flat = apart.ravel()
    here = np.arange(n, dtype=np.int32)
    block_end = np.minimum((here // BLOCK + 1) * BLOCK, n).astype(np.int32)
    selector = _selectors(flat).reshape(-1, APART)[:, :BLOCK].ravel()[:n]
    after = np.minimum(here + np.append([c for c, _ in SELECTORS], 1).astype(np.int32)[selector], block_end)
    # All blocks step from word to word at once; a block that is through stands still at its end.
    at, ends, begins = here[::BLOCK].copy(), block_end[::BLOCK], np.zeros(n + 1, dtype=bool)
    while len(at):
        begins[at] = True
        at = after[at]
        go = at < ends
        at, ends = at[go], ends[go]
    starts = np.flatnonzero(begins)
    chosen = selector[starts]
    extra = np.cumsum(chosen == ESCAPE)
    place = np.arange(len(starts)) + extra - (chosen == ESCAPE)
    out = np.zeros(len(starts) + int(extra[-1]), dtype=np.uint64)
    base = starts + starts // BLOCK * (APART - BLOCK)
    for s, (count, bits) in enumerate(SELECTORS):
        at = np.flatnonzero(chosen == s)
        if not len(at):
            continue
        word, own = np.full(len(at), s << 60, dtype=np.uint64), base[at]
        for j in range(count if bits else 0):
            word |= flat[own + j] << np.uint64(j * bits)
        out[place[at]] = word
    raw = np.flatnonzero(chosen == ESCAPE)
    out[place[raw]] = np.uint64(ESCAPE << 60)
    out[place[raw] + 1] = ids[starts[raw]]
    return out, place[starts % BLOCK == 0]


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids of words whose blocks begin at offsets."""
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int8)
    raw = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero(selector == ESCAPE):
        if not raw[i]:
            raw[i + 1] = True
    counts = np.append([c for c, _ in SELECTORS], 1)[selector]
    counts[raw] = 0
    ends = np.cumsum(counts)
    offsets = offsets.astype(np.int64)
    words_in = np.diff(np.append(offsets, len(words)))
    # What a block's last word holds beyond its ids falls between the blocks.
    at = ends - counts - np.repeat((ends - counts)[offsets] - np.arange(len(offsets)) * APART, words_in)
    out = np.zeros(len(offsets) * APART, dtype=np.uint64)
    for s, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero((selector == s) & ~raw) if bits else ()
        if len(mine):
            place, own = at[mine], words[mine]
            for j in range(count):
                out[place + j] = (own >> np.uint64(j * bits)) & np.uint64((1 << bits) - 1)
    esc = np.flatnonzero((selector == ESCAPE) & ~raw)
    out[at[esc]] = words[esc + 1]
    return out.reshape(-1, APART)[:, :BLOCK].ravel()[:n]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None) -> None:
    """Write the ids of docs (doc_id, text) to path, documents in ascending order of doc_id over the files.

    Null text counts as empty; end_id, if given, follows each document. Rows with equal doc_id
    are separate documents side by side; a null doc_id comes first, as NULL_ID.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        docs, ids, sizes = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            names, first = batch.column("doc_id").to_numpy(), 0
            for own, bounds in enc.encode(batch.column("text")):
                own, bounds = with_end(own, bounds, end_id)
                docs, first = np.concatenate((docs, names[first : first + len(bounds) - 1])), first + len(bounds) - 1
                ids, sizes = np.concatenate((ids, own)), np.concatenate((sizes, np.diff(bounds)))
                ends, done = np.cumsum(sizes), 0
                while len(ends) and ends[-1] - (base := ends[done - 1] if done else 0) >= CHUNK_IDS:
                    upto = int(np.searchsorted(ends, base + CHUNK_IDS)) + 1
                    yield chunk(docs[done:upto], ids[base : ends[upto - 1]], sizes[done:upto])
                    done = upto
                docs, ids, sizes = docs[done:], ids[ends[done - 1] if done else 0 :], sizes[done:]
        if len(docs):
            yield chunk(docs, ids, sizes)

    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text")
    # Ranges come from the ids alone: ranging by Spark's own sample would read all texts once more.
    ranged = rows.repartitionById(n, range_bucket(F.col("doc_id"), range_splits(rows.select("doc_id"), "doc_id", n)))
    ranged.sortWithinPartitions("doc_id").mapInArrow(run, SCHEMA).write.option("compression", "none").parquet(path)


def chunk(docs: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """The row of a chunk: documents with their ids in a row and how many each has."""
    words, offsets = encode(ids)
    columns = [[int(docs[0])], [len(ids)], [docs], [sizes], [offsets.astype("<u4").tobytes()], [words.astype("<u8").tobytes()]]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _read(spark: SparkSession, path: str, per_doc: Callable[[np.ndarray], object], kind: pa.DataType, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = {name: batch.column(name)[row] for name in ("n_ids", "doc_ids", "lengths", "block_offsets", "words")}
                ids = decode(np.frombuffer(x["words"].as_buffer(), "<u8"), np.frombuffer(x["block_offsets"].as_buffer(), "<u4"), x["n_ids"].as_py())
                lengths = np.asarray(x["lengths"].values.to_numpy(), dtype=np.int64)
                ends = np.cumsum(lengths)
                made = [per_doc(ids[e - n : e]) for n, e in zip(lengths, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([x["doc_ids"].values, pa.array(lengths), pa.array(made, kind)], names=["doc_id", "n_tokens", "made"])
            give_back()

    return spark.read.schema(SCHEMA).parquet(path).mapInArrow(run, f"doc_id long, n_tokens long, made {schema}")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids array<bigint>) of the documents in path's files."""
    return _read(spark, path, lambda x: x.astype(np.int64), pa.list_(pa.int64()), "array<bigint>").withColumnRenamed("made", "ids")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32) decoded from path's files; the crc32 is over little-endian unsigned 32-bit ids."""
    return _read(spark, path, lambda x: zlib.crc32(x.astype("<u4").tobytes()), pa.int64(), "bigint").withColumnRenamed("made", "ids_crc32")
