"""Token ids of whole texts by a public tokenizer file (Hugging Face format).

Where the tokenizer lower-cases, drops white space and marks the end of each pre-token, a text's ids
are its pre-tokens' ids in a row. Texts are cut into pre-tokens by array operations on their bytes, the
library encodes each distinct one once per worker (bounded memo), and texts are assembled by
array gathers. Words with anything but ASCII and Latin-1 letters, and other tokenizers' whole texts, go to the library as they are.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back

#: Pre-tokens a worker remembers; code points handled at once.
MEMO_WORDS, SLICE = 800_000, 2_000_000

# Classes of bytes: white space, letter, sign, digit (a pre-token each), and those that leave a word to the library.
_SPACE, _LETTER, _SIGN, _DIGIT, _ODD = range(5)
_CLASS = np.full(256, _ODD, dtype=np.uint8)
_CLASS[list(b" \t\n\x0b\x0c\r")] = _SPACE
_CLASS[[c for c in range(33, 127) if c != ord("'")]] = _SIGN
_CLASS[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
_CLASS[list(b"0123456789")] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] += 32
#: The UTF-8 byte that leads the letters of Latin-1, and which bytes after it are letters (not the signs of times and division).
_LATIN, _FOLLOWS = 0xC3, np.zeros(256, dtype=bool)
_FOLLOWS[0x80:0xC0] = True
_FOLLOWS[[0x97, 0xB7]] = False
#: Texts on which both ways of encoding must agree for the first to be used.
_SAMPLE = ("The Wording, (\"of\") 3.14 a-b--c ... !?x9 ÀÉÎÕÜ straße Ÿ ÿ", "a\n b\t c", "it's 'tis don't <|endoftext|>x <| é İ İx ΑΣ", "a b c \x1c\x01z 东京 q", "")


class Encoder:
    """Ids of texts, as arrays: see encode()."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        suffix = getattr(self.lib.model, "end_of_word_suffix", None)
        self.by_word = bool(suffix)
        self.start = None
        if self.by_word:
            vocab = self.lib.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
            # Added tokens are found inside words too: what begins like one is left to the library.
            self.heads = [t.content.encode()[:2] for t in self.lib.get_added_tokens_decoder().values()]
            self.plain = self._plain()
            self._forget()
            ids, bounds = self._encode(pa.array(_SAMPLE, pa.large_string()))
            self.by_word = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [self._ids(t) for t in _SAMPLE]

    def _ids(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def _plain(self):
        """The same model behind white space alone, for pre-tokens: it spares the library's normalising and splitting. The library itself where it would differ."""
        from tokenizers import Tokenizer, pre_tokenizers

        own = Tokenizer(self.lib.model)
        own.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        letters = [chr(c) for c in range(256) if chr(c).isalpha() and chr(c).islower() and (c < 128 or c >= 0xC0)]
        signs = [chr(c) for c in range(33, 127) if not chr(c).isalpha() and c != 39]
        sample = " ".join([*letters, *signs, "".join(letters), "the", "wording", "...", "!!"])
        return own if own.encode(sample, add_special_tokens=False).ids == self._ids(sample) else self.lib

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.start, self.len, self.pool = array("i"), array("i"), bytearray()

    def _learn(self, keys: pa.Array, odd: np.ndarray) -> None:
        """Remember the ids of new pre-tokens (a thousand at a time, told apart by the marks of word ends) and of odd words."""
        simple = keys.filter(pa.array(~odd))
        for i in range(0, len(simple), 1000):
            some = simple.slice(i, 1000)
            ids = np.asarray(self.plain.encode(b" ".join(some.to_pylist()).decode(), add_special_tokens=False).ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                self._keep(some, ids, np.diff(ends, prepend=0))
            else:
                self._keep_each(some)
        self._keep_each(keys.filter(pa.array(odd)))

    def _keep_each(self, keys: pa.Array) -> None:
        if len(keys):
            made = [np.asarray(e.ids, dtype=np.uint32) for e in self.lib.encode_batch_fast([k.decode() for k in keys.to_pylist()], add_special_tokens=False)]
            self._keep(keys, np.concatenate(made), np.array([len(x) for x in made]))

    def _keep(self, keys: pa.Array, ids: np.ndarray, lens: np.ndarray) -> None:
        self.fresh.append(keys)
        self.start.frombytes((len(self.pool) // 4 + np.cumsum(lens) - lens).astype(np.int32).tobytes())
        self.len.frombytes(lens.astype(np.int32).tobytes())
        self.pool += ids.tobytes()

    def _numbers(self, cut: pa.Array, odd: np.ndarray) -> np.ndarray:
        """The number of each pre-token or odd word among those remembered; new ones are learnt."""
        if len(self.known) > MEMO_WORDS:
            self._forget()
        found = pc.index_in(cut, value_set=self.known)
        if found.null_count:
            missing = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
            coded = cut.take(pa.array(missing)).dictionary_encode()
            flags = np.zeros(len(coded.dictionary), dtype=bool)
            flags[coded.indices.to_numpy()] = odd[missing]
            self.fresh = [self.known]
            self._learn(coded.dictionary, flags)
            new = len(self.known) + np.where(flags, np.sum(~flags) + np.cumsum(flags), np.cumsum(~flags)) - 1  # the simple ones come first
            self.known, self.fresh = pa.concat_arrays(self.fresh), []
            found = pc.coalesce(found, pa.scalar(-1, pa.int32())).to_numpy(zero_copy_only=False).copy()
            found[missing] = new[coded.indices.to_numpy()]
            return found
        return found.to_numpy()

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some texts in a row, bounds) slice by slice; text i of a slice is ids[bounds[i]:bounds[i + 1]]. Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        group = np.cumsum(size) // SLICE
        for cut in np.split(np.arange(len(size)), np.flatnonzero(np.diff(group)) + 1) if len(size) else ():
            some = texts.slice(cut[0], len(cut))
            yield self._encode(some) if self.by_word else self._by_text(some)
            give_back()

    def _by_text(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = [np.asarray(e.ids, dtype=np.uint32) for e in self.lib.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate(got), np.concatenate(([0], np.cumsum([len(x) for x in got])))

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(pre-tokens and odd words in a row, which are odd, index of each text's first one and of the end)."""
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        kind, low = _CLASS[data], _LOWER[data]
        lead = np.flatnonzero(data == _LATIN)
        lead = lead[lead + 1 < len(data)]
        lead = lead[_FOLLOWS[data[lead + 1]]]
        kind[lead] = kind[lead + 1] = _LETTER
        upper = lead[data[lead + 1] < 0xA0 - 1] + 1
        low[upper] += 32
        first = np.ones(len(data), dtype=bool)  # of a pre-token or of a run of white space
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        first[bounds[:-1][bounds[:-1] < len(data)]] = True
        odd = np.flatnonzero(kind == _ODD)
        for head in self.heads:
            at = np.flatnonzero(data[:-1] == head[0])
            odd = np.concatenate((odd, at[data[at + 1] == head[-1]]))
        black = kind != _SPACE
        inside = None
        if len(odd):
            edge = np.zeros(len(data) + 1, dtype=bool)  # where a word begins or white space does
            edge[1:-1] = black[1:] != black[:-1]
            edge[bounds] = True
            edges = np.flatnonzero(edge)
            word = np.unique(np.searchsorted(edges, odd, side="right"))
            step = np.zeros(len(data) + 1, dtype=np.int8)
            np.add.at(step, edges[word - 1], 1)
            np.add.at(step, edges[word], -1)
            inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
            first[inside] = False
            first[edges[word - 1]] = True
            low[inside] = data[inside]
        starts = np.flatnonzero(first & black)
        kept = low[black]
        offsets = np.append(np.flatnonzero(first[black]), len(kept)).astype(np.int64)
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
        return cut, inside[starts] if inside is not None else np.zeros(len(starts), dtype=bool), np.searchsorted(starts, bounds)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut, odd, bounds = self._cut(texts)
        at = self._numbers(cut, odd)
        start, length, pool = np.frombuffer(self.start, np.int32), np.frombuffer(self.len, np.int32), np.frombuffer(self.pool, np.uint32)
        lens = length[at]
        ends = np.cumsum(lens, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(start[at] - (ends - lens), lens)
        where += np.arange(total, dtype=np.int32)
        ids = pool[where] if total else np.zeros(0, np.uint32)
        del start, length, pool  # or the arrays could not grow
        return ids, np.concatenate(([0], ends)).astype(np.int64)[bounds]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and bounds of texts in a row, each followed by end_id if that is given."""
    if end_id is None:
        return ids, bounds
    n = len(bounds) - 1
    moved = bounds + np.arange(n + 1)
    own = np.ones(len(ids) + n, dtype=bool)
    own[moved[1:] - 1] = False
    out = np.full(len(own), end_id, dtype=np.uint32)
    out[own] = ids
    return out, moved
