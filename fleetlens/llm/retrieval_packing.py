"""Packing by lexical retrieval: a sharded BM25 inverted index over token ids fills each seed's window.

Texts are encoded once and kept as ids. How many documents hold each id is counted over the whole
corpus (a table no larger than the vocabulary), and so is the mean length, so a term weighs the same
in every shard. Documents are ordered by their two heaviest terms, so those about the same things
stand side by side, and are cut into ranges of equal counts; a range is read as consecutive shards
of at most SHARD_DOCS documents or SHARD_IDS ids, and only one shard's index is ever held.

In a shard a seed asks the index for unused documents, best score first (ties: in order), and they
fill its window. The one that crosses the window's end is cut there, and what is left of it is the
next window's seed. Where no unused document scores, the next in order is a seed within the same window. A
window stays open from shard to shard; at the end of a range the last one is cut into sequences of
powers of two. No sequence has padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, shuffle_partitions, stash
from .tokens import encoder, with_end

CAPACITY = 4096
#: Saturation of repeats and weight of length in BM25.
K1, B = 1.2, 0.75
#: A shard's documents and ids at most (one document may be longer); heaviest terms of a seed that are looked up; neighbours fetched at once (more are fetched when they're used up).
SHARD_DOCS, SHARD_IDS, QUERY_TERMS, FETCH = 2048, 2_000_000, 32, 64


def encoded(docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """(doc_id, n_tokens, ids): a row per row of docs (doc_id, text); ids of 2 bytes each where the vocabulary allows, else 4, little-endian. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind = "<u2" if max(enc.lib.get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            names, first = batch.column("doc_id"), 0
            for ids, bounds in enc.encode(batch.column("text")):
                ids, bounds = with_end(ids, bounds, end_id)
                n = len(bounds) - 1
                raw = pa.py_buffer(ids.astype(kind))
                held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((bounds * np.dtype(kind).itemsize).astype(np.int64)), raw]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([names.slice(first, n), pa.array(np.diff(bounds), pa.int64()), held], names=["doc_id", "n_tokens", "ids"])
                first += n
            give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def _terms(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, how often) of each distinct term of each document, by document and term."""
    lens = np.array([len(x) for x in texts], dtype=np.int64)
    flat = np.concatenate(texts) if len(texts) else np.zeros(0, np.uint16)
    base = int(flat.max()) + 1 if len(flat) else 1
    kind = np.uint32 if len(texts) * base < 1 << 32 else np.uint64  # small numbers sort faster
    keys = np.repeat(np.arange(len(texts), dtype=kind) * kind(base), lens) + flat
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    doc, term = np.divmod(keys[first], kind(base))
    return doc.astype(np.int64), term.astype(np.int64), np.diff(np.append(first, len(keys)))


def _ids(n: list[int], raw: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, f"<u{len(x) // k}") if k else np.zeros(0, "<u2") for k, x in zip(n, raw, strict=True)]


@dataclass(frozen=True)
class Statistics:
    """Counts over all documents: how many there are, ids each, and documents that hold each id."""

    docs: int
    mean: float
    holders: np.ndarray

    def weigh(self, doc: np.ndarray, term: np.ndarray, count: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """What each (document, term) adds to the score of a query with the term."""
        have = self.holders[term]
        idf = np.log1p((self.docs - have + 0.5) / (have + 0.5))
        return idf * count * (K1 + 1) / (count + K1 * (1 - B + B * lens[doc] / max(self.mean, 1e-9)))


def statistics(rows: DataFrame, end_id: int | None) -> Statistics:
    """Of encoded rows. Each task sends at most one count per id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            _, term, _ = _terms(_ids(batch.column("n_tokens").to_pylist(), batch.column("ids").to_pylist()))
            own = np.bincount(term)
            total = np.pad(total, (0, max(0, len(own) - len(total))))
            total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["term", "n"])

    found = rows.select("n_tokens", "ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    all_ = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("n_tokens"), F.lit(0.0)).alias("mean")).head()
    holders = np.zeros(int(max([found["term"].max() if len(found) else 0, end_id or 0])) + 1)
    holders[found["term"].to_numpy(dtype=np.int64)] = found["n"]
    return Statistics(all_["n"], all_["mean"] - (end_id is not None), holders)


def subject(stats: Statistics, end_id: int | None) -> Column:
    """The two heaviest terms of a document in one number, -1 without any: what documents are ordered by."""

    def heaviest(doc: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Each document's first place of the largest weight."""
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        most = np.maximum.reduceat(weight, starts) if len(starts) else weight
        at = np.flatnonzero(weight == np.repeat(most, np.diff(np.append(starts, len(doc)))))
        return at[np.diff(doc[at], prepend=-1) > 0]

    @F.arrow_udf("bigint")
    def found(n_tokens: pa.Array, ids: pa.Array) -> pa.Array:
        texts = [x[: len(x) - (end_id is not None)] for x in _ids(n_tokens.to_pylist(), ids.to_pylist())]
        doc, term, count = _terms(texts)
        weight = stats.weigh(doc, term, count, np.array([len(x) for x in texts]))
        first = heaviest(doc, weight)
        weight[first] = -1
        second = heaviest(doc, weight)
        out = np.full(len(texts), -1, dtype=np.int64)
        out[doc[first]] = (term[first] << 31) + np.where(weight[second] < 0, 0, term[second])
        return pa.array(out)

    return found("n_tokens", "ids")


@dataclass
class _Doc:
    doc_id: int | None
    ids: np.ndarray


@dataclass
class Packer:
    """Packs documents as they come; finished sequences are lists of (document, start, length)."""

    stats: Statistics
    end_id: int | None
    capacity: int = CAPACITY
    window: list[tuple[_Doc, int, int]] = field(default_factory=list)
    used: int = 0

    def _place(self, doc: _Doc, done: list) -> bool:
        """Put doc into the window and those after it; whether it crossed a window's end and still has its rest in the open one."""
        at, crossed = 0, False
        while at < len(doc.ids):
            take = min(len(doc.ids) - at, self.capacity - self.used)
            self.window.append((doc, at, take))
            at, self.used = at + take, self.used + take
            if self.used == self.capacity:
                done.append(self.window)
                self.window, self.used, crossed = [], 0, True
        return crossed and self.used > 0

    def shard(self, docs: list[_Doc]) -> list[list[tuple[_Doc, int, int]]]:
        """The sequences that a shard's documents complete."""
        texts = [d.ids[: len(d.ids) - (self.end_id is not None)] for d in docs]
        doc, term, count = _terms(texts)
        weight = self.stats.weigh(doc, term, count, np.array([len(x) for x in texts]))
        own = np.searchsorted(doc, np.arange(len(docs) + 1))
        # The inverted index: places in the arrays above, by term.
        by_term = np.argsort(term.astype(np.uint16) if term.max(initial=0) < 1 << 16 else term, kind="stable")
        kinds, starts = np.unique(term[by_term], return_index=True)
        ends = np.append(starts[1:], len(term))
        post_doc, post_weight = doc[by_term], weight[by_term]
        free, done, left = np.ones(len(docs), dtype=bool), [], 0

        def neighbours(seed: int) -> np.ndarray:
            a, b = own[seed], own[seed + 1]
            asked = term[a:b][np.argsort(-weight[a:b], kind="stable")[:QUERY_TERMS]]
            scores = np.zeros(len(docs))
            for k in np.searchsorted(kinds, asked):
                scores[post_doc[starts[k] : ends[k]]] += post_weight[starts[k] : ends[k]]
            found = np.flatnonzero(free & (scores > 0))
            if len(found) > FETCH:
                least = np.partition(scores[found], len(found) - FETCH)[len(found) - FETCH]
                found = found[scores[found] >= least]
            return found[np.argsort(-scores[found], kind="stable")][:FETCH]

        while True:
            while left < len(docs) and not free[left]:
                left += 1
            if left == len(docs):
                return done
            seed: int | None = left
            free[left] = False
            self._place(docs[left], done)
            while seed is not None and self.used:
                near, seed = neighbours(seed), None
                for k in near.tolist():
                    free[k] = False
                    seed = k  # of the next window, or of more neighbours when these are used up
                    if self._place(docs[k], done) or not self.used:
                        break

    def rest(self) -> list[list[tuple[_Doc, int, int]]]:
        """The open window as sequences of powers of two, longest first."""
        out = []
        while self.used:
            room, cut, after = 1 << (self.used.bit_length() - 1), [], []
            self.used -= room
            for doc, at, n in self.window:
                take = min(n, room)
                room -= take
                cut += [(doc, at, take)] if take else []
                after += [(doc, at + take, n - take)] if n > take else []
            out.append(cut)
            self.window = after
        return out


def pack(rows: DataFrame, stats: Statistics, end_id: int | None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of encoded rows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Rows must be stored: they are read twice, once to find the ranges."""
    names = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, size, number = Packer(stats, end_id, capacity), [], 0, TaskContext.get().partitionId() << 40

        def pieces(sequences: list) -> pa.RecordBatch:
            nonlocal number
            out = []
            for seq in sequences:
                offset = 0
                for doc, at, n in seq:
                    out.append((doc.doc_id, at, n, zlib.crc32(doc.ids[at : at + n].astype("<u4").tobytes()), len(doc.ids), number, offset))
                    offset += n
                number += 1
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, names.values(), strict=True)], names=list(names))

        for batch in batches:
            n = batch.column("n_tokens").to_pylist()
            for k, ids in zip(batch.column("doc_id").to_pylist(), _ids(n, batch.column("ids").to_pylist()), strict=True):
                if held and (len(held) == SHARD_DOCS or size + len(ids) > SHARD_IDS):
                    yield pieces(packer.shard(held))
                    held, size = [], 0
                if len(ids):
                    held.append(_Doc(k, ids))
                    size += len(ids)
            give_back()
        yield pieces(packer.shard(held))
        yield pieces(packer.rest())

    placed = rows.withColumn("__subject", subject(stats, end_id)).repartitionByRange(shuffle_partitions(rows.sparkSession), "__subject", "doc_id")
    ordered = placed.sortWithinPartitions("__subject", "doc_id", F.crc32("ids")).select("doc_id", "n_tokens", "ids")
    return ordered.mapInArrow(run, ", ".join(f"`{n}` bigint" for n in names))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of docs (doc_id, text), packed with their lexical neighbours.

    Null text counts as empty; end_id, if given, follows each document. A document without ids has
    no piece. Rows that repeat a doc_id are documents of their own, with pieces of the same name; a null
    doc_id stays null. Equal documents are neighbours of each other. An empty table gives no rows; other columns of docs are ignored.
    """
    rows = stash(encoded(docs, tokenizer, end_id), "encoded")
    return pack(rows, statistics(rows, end_id), end_id, capacity)
