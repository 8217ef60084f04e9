"""Language ID by error-correcting output codes.

Every language gets a codeword of BITS bits; for each bit a binary classifier over hashed byte
n-grams tells the languages with a one from those with a zero. A classifier is a table of
log-odds estimated from n-gram counts over all training documents (one distributed pass; the
model's size does not depend on the corpus). A text's mean log-odds per bit is a margin;
decoding sums a logistic loss of codeword bit times margin, weighted by how well each bit tells
its training languages apart, and takes the language of least loss.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, stash, text_verdict

#: Least bits of a codeword beyond five languages, hashed features, bytes per n-gram, and the gap of losses below which a text is ambiguous.
BITS, SPACE, GRAM, AMBIGUOUS = 15, 1 << 15, 3, 0.02
#: A text whose margins reach less than this share of what its language's own n-grams give is in none of the languages.
FOREIGN = 0.2
#: Languages a model can tell apart.
MAX_LANGS = 128
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
_SLICE = 1_000_000


def codewords(langs: list[str], bits: int = BITS) -> np.ndarray:
    """A (languages x bits) matrix of +1 and -1, rows far apart.

    Few languages (up to 5): all distinct non-trivial splits, each once (the exhaustive code:
    1, 3, 7 or 15 bits for 2 to 5 languages). More: seeded random words, redrawn in favour of the largest least distance.
    """
    n = len(langs)
    if n < 2:
        return np.ones((n, bits), dtype=np.int8)
    if n <= 5:
        splits = [np.array((1, *x), dtype=np.int8) for x in itertools.product((1, -1), repeat=n - 1) if -1 in x]
        return np.stack(splits, axis=1)
    rng, best, width = np.random.default_rng(7), None, max(bits, int(np.ceil(3 * np.log2(n))))
    for _ in range(200):
        code = rng.choice(np.array([1, -1], dtype=np.int8), size=(n, width))
        far = min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) if n <= 64 else len(np.unique(code, axis=0))
        if np.all(np.abs(code.sum(0)) < n) and (best is None or far > best[0]):
            best = (far, code)
    return best[1]


def grams(texts: list[str], space: int = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of all texts in a row, where each text's begin). Lower-cased; digits and signs count as spaces."""
    data = [(" " + t.lower() + "  ").encode("utf-8", "ignore") for t in texts]
    raw = np.frombuffer(b"".join(data), dtype=np.uint8)
    kept = _FOLD[raw].astype(np.uint32)
    h = kept[:-2] * np.uint32(0x9E3779B1) + kept[1:-1] * np.uint32(0x85EBCA77) + kept[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h = (h >> np.uint32(12)) % np.uint32(space)
    sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
    return h, np.concatenate(([0], np.cumsum(sizes)[:-1]))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def in_slices(texts: list[str]) -> Iterator[list[int]]:
    """Indices of texts in runs of bounded size (a longer text goes alone)."""
    run, held = [], 0
    for i, t in enumerate(texts):
        if run and held + len(t) > _SLICE:
            yield run
            run, held = [], 0
        run.append(i)
        held += len(t)
    if run:
        yield run


def has_letter(text: object) -> bool:
    return isinstance(text, str) and LETTER.search(text) is not None


@dataclass(frozen=True)
class Model:
    """langs; codes (langs x bits); table (features x bits) of log-odds; weights of the bits; each language's own mean margins (langs x bits)."""

    langs: list[str]
    codes: np.ndarray
    table: np.ndarray
    weight: np.ndarray
    own: np.ndarray
    space: int

    def margins(self, texts: list[str]) -> np.ndarray:
        """Mean log-odds of each text for each bit."""
        h, at = grams(texts, self.space)
        ends = np.append(at[1:], len(h))
        out = np.empty((len(texts), self.table.shape[1]), dtype=np.float32)
        for i, (lo, hi) in enumerate(zip(at, ends, strict=True)):
            counts = np.bincount(h[lo : hi], minlength=self.space) if hi - lo > 4 * self.space else None
            out[i] = counts.astype(np.float32) @ self.table / (hi - lo) if counts is not None else self.table[h[lo:hi]].mean(axis=0)
        return out

    def reach(self, margins: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Share of the margins that text of the chosen language has on average; about 1 for such text, about 0 for other text."""
        code, own = self.codes[best], self.own[best]
        return (margins * code * self.weight).sum(axis=1) / np.maximum((own * code * self.weight).sum(axis=1), 1e-9)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the nearest codeword, score 0 to 1, gap of losses to the second)."""
        agree = np.einsum("tb,lb->tlb", margins, self.codes)
        loss = (np.log1p(np.exp(-4 * np.clip(agree, -20, 20))) * self.weight).sum(axis=2)
        best = loss.argmin(axis=1)
        odds = np.exp(-8 * (loss - loss.min(axis=1, keepdims=True)))
        ranked = np.sort(loss, axis=1)
        gap = ranked[:, 1] - ranked[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, odds.max(axis=1) / odds.sum(axis=1), gap


def train(docs: DataFrame, bits: int = BITS, space: int = SPACE) -> Model:
    """Fit on all rows of docs (text, lang) with a language and a letter.

    Executors count n-grams per language; what reaches the driver is at most languages x space
    sums, as Arrow columns. Without labelled rows the model knows no language. More than MAX_LANGS languages: an error.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, rows in batch.groupby("lang", sort=False):
                texts = [t for t in rows["text"] if has_letter(t)]
                for part in in_slices(texts):
                    h, _ = grams([texts[i] for i in part], space)
                    seen.setdefault(lang, np.zeros(space, dtype=np.int64))[:] += np.bincount(h, minlength=space)
        for lang, sums in seen.items():
            at = np.nonzero(sums)[0]
            yield pd.DataFrame({"lang": lang, "feature": at.astype("int32"), "n": sums[at]})

    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    counts = stash(rows.mapInPandas(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")), "grams")
    found = counts.select("lang").distinct().limit(MAX_LANGS + 1).collect()
    if len(found) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(r["lang"] for r in found)
    n = np.zeros((len(langs), space))
    for part in counts.toArrow().to_batches():
        names = part.column("lang").dictionary_encode()
        row = np.array([langs.index(x) for x in names.dictionary.to_pylist()], dtype=np.int64)[names.indices.to_numpy()]
        n[row, part.column("feature").to_numpy()] = part.column("n").to_numpy()
    codes = codewords(langs, bits)
    p = (n + 0.5) / (n.sum(axis=1, keepdims=True) + 0.5 * space) if langs else n
    table = np.zeros((space, codes.shape[1]), dtype=np.float32)
    weight, own = np.zeros(codes.shape[1]), np.zeros(codes.shape)
    for b in range(codes.shape[1] if len(langs) > 1 else 0):
        one, two = p[codes[:, b] == 1].mean(axis=0), p[codes[:, b] == -1].mean(axis=0)
        table[:, b] = np.log(one / two)
        own[:, b] = p @ table[:, b]  # of each language's own n-grams
        weight[b] = max(1e-6, (own[:, b] * codes[:, b]).min())
    return Model(langs, codes, table, weight / max(weight.sum(), 1e-9), own, space)


def identify(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in carry) + lang_pred, lang_score (0 to 1) and lang_ambiguous, from the whole text alone.

    Null text, or no letter in it: `und`, score 0, not ambiguous. A model that knows no language
    says `und` of everything. Extra columns are carried along; those three are replaced.
    """
    fields = [("lang_pred", pa.string(), "string"), ("lang_score", pa.float64(), "double"), ("lang_ambiguous", pa.bool_(), "boolean")]
    carried = [c for c in (docs.columns if carry is None else carry) if c not in [f[0] for f in fields]]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[str | None]) -> list[tuple]:
        m = shared.value
        rows: list[tuple] = [(UNKNOWN, 0.0, False)] * len(texts)
        for i, best, score, gap, reach in _decoded(m, texts):
            rows[i] = (m.langs[best], float(score), bool(gap < AMBIGUOUS or reach < FOREIGN))
        return rows

    return map_texts(docs, carried, fields, lambda: work)


def _decoded(model: Model, texts: list[str | None]) -> Iterator[tuple]:
    """(index, language number, score, gap of losses, reach) of each text with a letter, if the model knows a language; with a single one, reach is 1."""
    real = [i for i, t in enumerate(texts) if model.langs and has_letter(t)]
    for part in in_slices([texts[i] for i in real]):
        at = [real[j] for j in part]
        margins = model.margins([texts[i] for i in at])
        best, score, gap = model.decode(margins)
        reach = model.reach(margins, best) if len(model.langs) > 1 else np.ones(len(at))
        yield from zip(at, best, score, gap, reach, strict=True)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept out of training: crc32 of its id's text modulo 4 is 2 (null id: no)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame) -> Model:
    """The model that docs' own labelled rows give, without those held out."""
    return train(docs.where(~held_out()))


def keep_known(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text has no letter or, as decoded, is in none of the languages that docs' labels teach; columns as they were.

    Ambiguity between two known languages keeps a text. Without a language to learn, all texts with a letter stay. Only text goes to Python.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs))

    def keeps(texts: list[str | None]) -> list[bool]:
        m = shared.value
        if not m.langs:
            return [has_letter(t) for t in texts]
        out = [False] * len(texts)
        for i, _, _, _, reach in _decoded(m, texts):
            out[i] = bool(reach >= FOREIGN)
        return out

    return docs.where(text_verdict(lambda: keeps)(docs["text"]))
