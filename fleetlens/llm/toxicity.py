"""Toxicity by multiple-instance learning.

Only documents are labelled. Each sentence is scored by a logistic model over its words and the
beginnings of its longer words; a
document's score is the noisy-or of its sentences, 1 - prod(1 - p). The words' weights are
fitted by gradient descent on the documents' labels through the noisy-or; the fitted sentence
scores then show where a document offends.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: The fit uses at most this many labelled documents, and of those at most this many code points in all;
#: beyond, documents are taken in the order of a hash of their ids. Scoring has no such bound.
MAX_DOCS, MAX_CHARS = 4_000, 40_000_000
#: A word or beginning is a feature if at least so many documents of the fit have it and the chi-squared of its
#: presence against the label is at least CHI2; at most so many features, the largest first.
MIN_DOCS, CHI2, MAX_FEATURES = 4, 12.0, 5_000
STEPS, RATE, L1, L2 = 100, 0.15, 2e-4, 1e-6
#: Words longer than so many letters also count by their first letters.
STEMS, STEM_MARK = (4, 5, 6), "^"

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’\-][\p{L}\p{M}\p{N}]+)*")
#: The same on ASCII text.
ASCII_WORD = re.compile(r"[A-Za-z0-9]+(?:['\-][A-Za-z0-9]+)*")
SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+$")
#: Words whose marks a worker remembers.
MEMO_WORDS = 500_000


def sentences(text: str) -> list[str]:
    """The sentences of a text; in a row they are the text. Ends: runs of . ! ? and line ends."""
    return SENTENCE.findall(text)


def words_of(text: str) -> list[str]:
    return (ASCII_WORD if text.isascii() else WORD).findall(text)


def marks_of(word: str) -> list[str]:
    """A word's features: its lower case and, marked, the beginnings of a longer one."""
    low = word.lower()
    return [low, *(STEM_MARK + low[:n] for n in STEMS if len(low) > n)]


class _Weighted(dict):
    """word -> its marks that have a weight, as (mark, weight)."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def __missing__(self, word: str) -> tuple:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = found = tuple((m, self.weights[m]) for m in marks_of(word) if m in self.weights)
        return found


@dataclass(frozen=True)
class Model:
    """Weights of the marks of words, and the bias of a sentence."""

    weights: dict[str, float]
    bias: float

    def scorer(self):
        """The function from a text to (score, [(start, end, probability) of each sentence with a weighted mark]).

        As in fit(), a mark counts once a sentence, and all other sentences have the bias alone;
        a text without sentences counts as one. The score is the noisy-or over the sentences.
        """
        weighted, calm = _Weighted(self.weights), math.log1p(-_sigmoid(self.bias))

        def score(text: str) -> tuple[float, list[tuple[int, int, float]]]:
            at, hits, spans = 0, [], sentences(text)
            find = ASCII_WORD.findall if text.isascii() else WORD.findall
            for s in spans:
                if found := {m for w in find(s) for m in weighted[w]}:
                    hits.append((at, at + len(s), _sigmoid(self.bias + math.fsum(w for _, w in found))))
                at += len(s)
            log = calm * (max(1, len(spans)) - len(hits)) + math.fsum(math.log1p(-min(p, 1 - 1e-9)) for *_, p in hits)
            return -math.expm1(log), hits

        return score


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, x))))


def fit(texts: list[str], labels: list[int]) -> Model:
    """The model for documents with labels 0 or 1, by Adam on the noisy-or's log-likelihood, with an L1 step.

    Documents without both labels: a model that scores everything near the labels' mean.
    """
    y = np.asarray(labels, dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        return Model({}, float(np.log(p / (1 - p))))
    df, df1 = Counter(), Counter()
    for t, label in zip(texts, labels, strict=True):
        seen = {m for w in set(words_of(t)) for m in marks_of(w)}
        df.update(seen)
        if label:
            df1.update(seen)
    vocab = _telling(df, df1, len(y), int(y.sum()))
    del df, df1
    cols, rows, sent_doc, s = [], [], [], 0
    for k, t in enumerate(texts):
        for sentence in sentences(t) or [""]:
            ids = sorted({vocab[m] for w in words_of(sentence) for m in marks_of(w) if m in vocab})
            cols.extend(ids)
            rows.extend([s] * len(ids))
            sent_doc.append(k)
            s += 1
    cols, rows, sent_doc = np.asarray(cols, dtype=np.int64), np.asarray(rows, dtype=np.int64), np.asarray(sent_doc, dtype=np.int64)
    w, bias = np.zeros(len(vocab)), -6.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(rows, weights=w[cols], minlength=s)
        p = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-9, 1 - 1e-9)
        calm = np.bincount(sent_doc, weights=np.log1p(-p), minlength=len(y))
        whole = np.clip(-np.expm1(calm), 1e-7, 1 - 1e-7)
        # d loss / d z of a sentence: p for a 0 document, -p (1 - P) / P for a 1 document
        g = p * np.where(y == 1, -(1 - whole) / whole, 1.0)[sent_doc]
        gw = np.bincount(cols, weights=g[rows], minlength=len(w)) / len(y) + L2 * w
        gb = g.sum() / len(y)
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, c = 1 - 0.9**step, 1 - 0.99**step
        scale = RATE / (np.sqrt(v / c) + 1e-5)
        w = w - scale * m / a
        w = np.sign(w) * np.maximum(np.abs(w) - scale * L1, 0)
        bias -= RATE * (mb / a) / (np.sqrt(vb / c) + 1e-5)
    return Model({x: float(w[i]) for x, i in vocab.items() if abs(w[i]) > 1e-3}, float(bias))


def _telling(df: dict[str, int], df1: dict[str, int], n: int, n1: int) -> dict[str, int]:
    """Features by number: those whose presence depends on the label."""
    names = [w for w, k in df.items() if k >= MIN_DOCS]
    if not names:
        return {}
    a = np.array([df[w] for w in names], dtype=np.float64)
    b = np.array([df1.get(w, 0) for w in names], dtype=np.float64)
    chi2 = n * (b * n - a * n1) ** 2 / np.maximum(a * (n - a) * n1 * (n - n1), 1)
    order = np.lexsort((names, -chi2))[:MAX_FEATURES]
    return {names[i]: k for k, i in enumerate(order[chi2[order] >= CHI2])}


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Fit on labelled documents (labels: doc_id, toxic); at most max_docs by a hash of the id, whatever the corpus.

    Rows with a null id, text or label are not used. A document with several labels counts with the largest.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    few = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts, marks, held = [], [], 0
    for r in few.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        held += len(r["text"])
        if held > MAX_CHARS:
            break
        texts.append(r["text"])
        marks.append(int(r["toxic"] > 0))
    return fit(texts, marks)


def score(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in carry) + toxicity (0 to 1) and toxic_spans, the sentences that score 0.5 or more.

    Whole texts; null counts as empty. toxic_spans: array of (start, end, score) in code points,
    in the order of the text. Columns of those names are replaced.
    """
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    fields = [("toxicity", pa.float64(), "double"), ("toxic_spans", pa.list_(span), "array<struct<start: int, end: int, score: double>>")]
    carried = [c for c in (docs.columns if carry is None else carry) if c not in [f[0] for f in fields]]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def setup():
        one = shared.value.scorer()

        def work(texts: list[str | None]) -> list[tuple]:
            made = [one(t or "") for t in texts]
            return [(p, [{"start": a, "end": b, "score": q} for a, b, q in hits if q >= 0.5]) for p, hits in made]

        return work

    return map_texts(docs, carried, fields, setup)


def held_out(doc_id: str = "doc_id"):
    """Whether a document's label is kept out of training: crc32 of its id's text modulo 5 is 0 (null id: no)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
