"""Packing by lexical retrieval against a plain greedy search, and on awkward tables."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from fleetlens.llm import retrieval_packing as rp
from fleetlens.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, length int, sequence_id string, offset string, start string, ids string, n_tokens string"


def docs_of(spark, pairs):
    return spark.createDataFrame([(k, t, 1, "s", "o", "b", "i", "n") for k, t in pairs], SCHEMA).repartition(3)


def whole(pieces, ids_of, capacity):
    """Every id of every document lies in one piece, sequences are gapless and full or powers of two."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == {k for k, ids in ids_of.items() if ids}
    for k, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids_of[k])
            assert r["ids_crc32"] == zlib.crc32(np.asarray(ids_of[k][at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids_of[k])
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)


def test_pieces_hold_all_ids_of_awkward_tables(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("alpha beta gamma delta epsilon zeta".split()) + str(r.randint(0, 30)) for _ in range(r.randint(1, 400))) for _ in range(150)]
    pairs = list(enumerate([*texts, texts[3], texts[3], None, "", " \n", "word " * 30_000, "é東京 <|endoftext|>"])) + [(None, "of no id")]
    lib = Tokenizer.from_file(tokenizer_path())
    ids_of = {k: [*lib.encode(t or "", add_special_tokens=False).ids, 2] for k, t in pairs}
    got = rp.pack_documents(docs_of(spark, pairs), tokenizer_path(), 2)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole(got.collect(), ids_of, 4096)
    whole(rp.pack_documents(docs_of(spark, pairs), tokenizer_path(), None, 64).collect(), {k: v[:-1] for k, v in ids_of.items()}, 64)
    assert rp.pack_documents(docs_of(spark, []), tokenizer_path()).count() == 0


def test_rows_that_repeat_an_id_are_packed_each(spark):
    pairs = [(1, "one two three"), (1, "one two three"), (1, "other words"), (None, None), (None, None)]
    lib = Tokenizer.from_file(tokenizer_path())
    sizes = Counter(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in pairs)
    got = rp.pack_documents(docs_of(spark, pairs), tokenizer_path()).collect()
    assert Counter(r["doc_tokens"] for r in got if r["start"] == 0) == sizes and sum(r["length"] for r in got) == sum(k * n for k, n in sizes.items())


def brute(texts, capacity):
    """The same greedy packing of one shard, scores summed by hand: documents in the order in which they enter the windows."""
    n, mean = len(texts), sum(map(len, texts)) / len(texts)
    counts, holders = [Counter(t) for t in texts], Counter(w for t in texts for w in set(t))

    def weight(d, w):
        c, have = counts[d][w], holders[w]
        return math.log1p((n - have + 0.5) / (have + 0.5)) * c * (rp.K1 + 1) / (c + rp.K1 * (1 - rp.B + rp.B * len(texts[d]) / mean)) if c else 0.0

    free, entered, used = set(range(n)), [], 0

    def place(d):
        nonlocal used
        free.discard(d)
        entered.append(d)
        crossed, used = used + len(texts[d]) + 1 >= capacity, (used + len(texts[d]) + 1) % capacity
        return crossed

    while free:
        seed = min(free)
        place(seed)
        while seed is not None and used:
            asked = sorted(counts[seed], key=lambda w: (-weight(seed, w), w))[: rp.QUERY_TERMS]
            scores = {d: sum(weight(d, w) for w in asked) for d in free}
            near, seed = sorted((d for d in free if scores[d] > 0), key=lambda d: (-round(scores[d], 9), d))[: rp.FETCH], None
            for d in near:
                seed = d
                if place(d) or not used:
                    break
    return entered


def test_a_shard_is_packed_as_by_plain_greedy_search():
    r = random.Random(7)
    texts = [[10 * (i % 6) + r.randint(0, 9) for _ in range(r.randint(1, 40))] + [r.randint(60, 90)] for i in range(120)]
    stats = rp.Statistics(len(texts), sum(map(len, texts)) / len(texts), np.array([sum(w in t for t in texts) for w in range(100)], dtype=float))
    packer = rp.Packer(stats, 2, 128)
    docs = [rp._Doc(i, np.array([*t, 2], dtype="<u2")) for i, t in enumerate(texts)]
    sequences = packer.shard(docs) + packer.rest()
    entered = list(dict.fromkeys(d.doc_id for seq in sequences for d, _, _ in seq))
    assert entered == brute(texts, 128)
    # Windows keep to a subject: far more of their documents share a seed's ten words than by chance (1 in 6).
    same = [(a[0].doc_id % 6) == (b[0].doc_id % 6) for seq in sequences for a, b in zip(seq, seq[1:])]
    assert np.mean(same) > 0.7


def test_a_window_left_open_is_cut_into_powers_of_two():
    packer = rp.Packer(rp.Statistics(1, 1.0, np.ones(100)), None, 64)
    packer.shard([rp._Doc(0, np.arange(45, dtype="<u2"))])
    assert [[(at, n) for _, at, n in seq] for seq in packer.rest()] == [[(0, 32)], [(32, 8)], [(40, 4)], [(44, 1)]]
