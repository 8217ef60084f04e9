"""Quality rules by compression bands.

A document's zstandard ratio (bytes of text to bytes compressed), over the whole text and over
fixed chunks, must lie in a band that depends on the length compressed: text that repeats itself
compresses too well, random or encoded text hardly at all.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import map_texts, text_verdict

#: zstandard level and bytes per chunk.
LEVEL, CHUNK = 3, 4096
#: (bytes up to, least ratio, most ratio); the last holds for all longer texts. Very short texts can't be judged.
BANDS = ((63, 0.0, 4.0), (127, 0.6, 3.0), (255, 0.95, 2.6), (511, 1.15, 3.2), (1023, 1.25, 3.6), (4095, 1.4, 4.2), (16383, 1.45, 5.0), (65535, 1.45, 6.0), (2**62, 1.45, 8.0))
#: A document goes if more than this share of its chunks is outside the chunks' band.
CHUNK_SHARE = 0.3
#: Base rules: least words, most per cent of words in repeated windows of three.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

FIELDS = [
    *((n, pa.int64(), "long") for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    ("base_failed", pa.bool_(), "boolean"), ("ratio", pa.float64(), "double"), ("bad_chunks", pa.int64(), "long"), ("n_chunks", pa.int64(), "long"), ("verdict", pa.string(), "string"), ("kept", pa.bool_(), "boolean"),
]
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


def band(n_bytes: int) -> tuple[float, float]:
    return next((low, high) for top, low, high in BANDS if n_bytes <= top)


def side(n_bytes: int, packed: int) -> int:
    """-1 if data that pack so well are incompressible for their length, 1 if repetitive, else 0."""
    low, high = band(n_bytes)
    ratio = n_bytes / max(1, packed)
    return -1 if ratio < low else int(ratio > high)


def compression(data: bytes, packer: zstandard.ZstdCompressor, chunk: int = CHUNK) -> tuple[float, int, int, str]:
    """(ratio of the whole, chunks outside their band, chunks, verdict). No bytes: ratio 0, kept."""
    if not data:
        return 0.0, 0, 0, "ok"
    packed = len(packer.compress(data))
    whole, bad, n = side(len(data), packed), 0, 0
    if len(data) > chunk:
        for i in range(0, len(data), chunk):
            part = data[i : i + chunk]
            bad += side(len(part), len(packer.compress(part))) != 0
            n += 1
    else:
        bad, n = int(whole != 0), 1
    verdict = ("incompressible", "", "repetitive")[whole + 1] or ("chunks" if bad > CHUNK_SHARE * n else "ok")
    return len(data) / max(1, packed), bad, n, verdict


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows that occur twice or more in the text, the first occurrence included."""
    if len(words) <= window:
        return 0
    grams = list(zip(*[words[i:] for i in range(window)], strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen, twice = set(), set()
    for g in grams:
        (twice if g in seen else seen).add(g)
    covered, upto = 0, 0
    for i, g in enumerate(grams):
        if g in twice:
            covered += i + window - max(i, upto)
            upto = i + window
    return covered


def base_counts(text: str, data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    spaces = len(data) - len(data.translate(None, SPACES))
    lines = [x for x in data.split(b"\n") if x.translate(None, SPACES)]
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words)


def judge(docs: DataFrame, carry: list[str] | None = None, level: int = LEVEL, chunk: int = CHUNK) -> DataFrame:
    """docs' columns (or those in carry) + the base counts and verdicts, one row for each row of docs.

    Null or empty text: all counts 0, base_failed. `kept` is false if the base rules fail, else
    whether the compression bands hold. Columns of docs named like one of the facts are replaced.
    """
    facts = [f[0] for f in FIELDS]
    carried = [c for c in (docs.columns if carry is None else carry) if c not in facts]
    return map_texts(docs, carried, FIELDS, lambda: _judging(level, chunk))


def _judging(level: int, chunk: int):
    packer = zstandard.ZstdCompressor(level=level)

    def row(text: str | None) -> tuple:
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        n, chars, symbols, dups, repeats = base_counts(text, data, data.split())
        failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
        ratio, bad, chunks, verdict = compression(data, packer, chunk)
        return n, chars, symbols, dups, repeats, failed, ratio, bad, chunks, verdict, not failed and verdict == "ok"

    return lambda texts: list(map(row, texts))


def keep_good(docs: DataFrame, level: int = LEVEL, chunk: int = CHUNK) -> DataFrame:
    """The rows of docs that judge() keeps, with their own columns; only the text goes to Python."""

    def setup():
        judging = _judging(level, chunk)
        return lambda texts: [r[-1] for r in judging(texts)]

    return docs.where(text_verdict(setup)(docs["text"]))
