"""The prefix trie against plain dictionaries of prefixes, on tables with long copies, ties and nulls, however they are cut."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from fleetlens.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n string, part int, own string, seq string, size string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    held = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = c - (c % 100 if c >= 0 else -(-c % 100))
        held[c] = tuple(own.get(head, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in held.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children, below = defaultdict(list), defaultdict(lambda: [0, 0])
    for p in members:
        if p:
            children[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        kids = children[p]
        below[p][0] = sum(below[k][0] for k in kids) if kids else 1
        below[p][1] = sum(below[k][1] for k in kids) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), *below[p], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(held[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items()
    )


def found(table):
    got = pt.trie(table)
    assert got.columns == COLUMNS
    return sorted(tuple(-1 if x is None else x for x in r) for r in got.collect())


def table_of(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "d", "n", 3, "o", "s", "z") for r in rows], SCHEMA).repartition(parts)


AWKWARD = [
    *[(c, t, "user", f"hello {t}") for c in range(300, 340) for t in range(3)],  # copies of one conversation
    *[(100, t, ("user", "assistant")[t % 2], "äé" * t) for t in range(9)],
    (150, None, None, None), (150, 0, "user", "b"), (150, 0, "user", "a"), (150, 0, None, "a"), (150, 0, "user", "a"),
    (201, 5, "user", "own"),  # its group has no head: turnless, or its own turns alone
    (202, 5, "user", "own"), (203, 5, "user", "own"), (204, 5, "user", "own"),
    (-5, 1, "user", "below zero"), (-105, 1, "user", "below zero"), (0, 0, "user", "head"), (7, 0, "user", "x"),
    (None, 0, "user", "nobody's"), (None, None, None, None),
]


@pytest.mark.parametrize("block", [1, 7, 200_000])
def test_trie_of_awkward_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(pt, "BLOCK_TURNS", block)
    assert found(table_of(spark, AWKWARD)) == brute(AWKWARD)


def test_tables_without_conversations(spark):
    assert found(table_of(spark, [])) == [] and found(table_of(spark, [(None, 1, "user", "x")])) == []


def grown(seed, n):
    r = random.Random(seed)
    made, rows = [], []
    for c in range(n):
        base = list(r.choice(made)) if made and r.random() < 0.7 else []
        v = base[: r.randint(0, len(base))] + [(r.choice(["user", "assistant"]), r.choice("abc") * r.randint(0, 3)) for _ in range(r.randint(0, 5))] or [("user", "x")]
        made.append(v)
        rows += [(c, t, *x) for t, x in enumerate(v)]
    return rows


def test_random_conversations_over_many_partitions_and_levels(spark, monkeypatch):
    rows = grown(3, 400)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    monkeypatch.setattr(pt, "FAN", 3)
    try:
        assert found(table_of(spark, rows)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def brute_nodes(seqs):
    members = defaultdict(list)
    for c, s in seqs:
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    return {p: (len(p), min(m), len(m), sum(len(k) == len(p) + 1 and k[:-1] == p for k in members)) for p, m in members.items()}


def test_forests_cut_anywhere_and_merged_in_any_grouping_agree():
    r = random.Random(9)
    for _ in range(60):
        seqs = sorted((tuple(r.randint(1, 2) for _ in range(r.randint(0, 5))), c) for c in range(r.randint(1, 14)))
        cuts = sorted({0, len(seqs), *(r.randint(0, len(seqs)) for _ in range(3))})
        done, forests = [], []
        for a, b in zip(cuts, cuts[1:]):
            part = seqs[a:b]
            flat = np.array([x for s, _ in part for x in s], dtype=np.int64)
            bounds = np.concatenate(([0], np.cumsum([len(s) for s, _ in part]))).astype(np.int64)
            forests.append(pt.Block(np.array([c for _, c in part]), bounds, flat, flat * 7, np.ones(len(flat), dtype=np.int64)).forest(done))
        while len(forests) > 1:
            at = r.randrange(len(forests) - 1)
            forests[at : at + 2] = [pt.merge(forests[at], forests[at + 1], done)]
        pt.close_path(forests[0].last, forests[0].shared, done)
        pt.close_path(forests[0].first, 0, done)
        nodes = brute_nodes([(c, s) for s, c in seqs])
        assert sorted((x[0], x[6], x[7], x[8]) for x in done) == sorted(nodes.values())
