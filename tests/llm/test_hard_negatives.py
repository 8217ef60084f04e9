"""Hard negatives against a full scan, bounds against all corners, and the curve's own properties."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from fleetlens.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, id string, q string, block string, slot string, rank string, group string, score string"


def table_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "i", "q", "b", "s", "r", "g", "c") for r in rows], SCHEMA).repartition(parts)


def brute(rows, every=50, positives=5, negatives=3):
    held = []
    for k, label, v in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            held.append((hn.NULL_ID if k is None else k, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = Counter()
    for i, (a, label, v) in enumerate(held):
        if a % every or a == hn.NULL_ID:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), k, own) for j, (k, own, w) in enumerate(held) if j != i]
        for p, pid, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fits = sorted(x for x in scored if x[2] != label and 50 * -p <= 100 * -x[0] <= 95 * -p)[:negatives]
            for rank, (s, nid, _) in enumerate(fits, 1):
                out[a, None if pid == hn.NULL_ID else pid, rank, None if nid == hn.NULL_ID else nid, -p, -s] += 1
    return out


def found(table, **how):
    got = hn.mine(table, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r) for r in got.collect())


def clustered(seed, n, d, labels):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, d)) * 0.4
    return [(i, int(r.integers(labels)), (centres[r.integers(6)] + r.normal(size=d) * 0.05).astype(np.float32).tolist()) for i in range(n)]


def test_as_a_full_scan_finds_on_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 16)
    monkeypatch.setattr(hn, "GROUP", 3)
    monkeypatch.setattr(hn, "PAGE", 4)
    rows = clustered(1, 500, 8, 3)
    assert found(table_of(spark, rows), every=20) == brute(rows, every=20)


def test_as_a_full_scan_finds_on_awkward_tables(spark):
    same = [0.5, -0.25, 0.125]
    rows = [
        *[(i, i % 2, same) for i in range(0, 120)],  # one vector, ties by id
        *[(i, 1, [0.5, -0.25 + i / 1000, 0.1]) for i in range(120, 160)],
        (200, 0, [0.5]), (201, 1, []), (250, 0, []), (300, None, same), (350, 0, None), (400, 1, [0.1, None, 0.2]), (401, 1, [float("nan"), 0.1, 0.2]), (450, 0, [float("inf"), 0.0, 0.0]),
        (500, 7, same), (-50, 0, [0.4, -0.3, 0.1]), (None, 0, same), (None, 1, [0.45, -0.2, 0.1]), (50, 0, same), (50, 1, [0.2, -0.25, 0.3]), (3, 1, same),
        (550, 1, [-0.5, 0.25, -0.125]),
    ]
    assert found(table_of(spark, rows)) == brute(rows)


def test_large_components_stay_exact(spark):
    r = random.Random(4)
    rows = [(i, i % 3, [r.choice([1e5, 3e6, -7e6]) * r.random() for _ in range(4)]) for i in range(60)]
    assert found(table_of(spark, rows), every=10) == brute(rows, every=10)


@pytest.mark.parametrize("rows", [[], [(1, 2, [0.5])], [(50, 2, [0.5])], [(50, None, [0.5]), (0, 1, None)]])
def test_tables_without_pairs(spark, rows):
    assert found(table_of(spark, rows)) == Counter()


def test_bounds_hold_and_are_met_at_corners():
    r = np.random.default_rng(3)
    a, blocks = r.integers(-50, 50, (5, 3)), [r.integers(-50, 50, (4, 3)) for _ in range(6)]
    lo, hi = np.array([b.min(axis=0) for b in blocks]), np.array([b.max(axis=0) for b in blocks])
    least, most = hn.bounds(a, lo, hi)
    for i, x in enumerate(a):
        for k, block in enumerate(blocks):
            corners = [sum(v * (h if bit >> j & 1 else low) for j, (v, low, h) in enumerate(zip(x, lo[k], hi[k]))) for bit in range(8)]
            assert least[i, k] == min(corners) and most[i, k] == max(corners)
            assert all(least[i, k] <= x @ v <= most[i, k] for v in block)


def test_the_curve_visits_each_cell_once_by_steps_of_one():
    side = 1 << hn.BITS
    cells = np.array([(x, y) for x in range(side) for y in range(side)])
    scale = 1000
    points = ((cells + 0.5) * (2 * scale + 1) / side - scale).astype(int)
    order = sorted(range(len(cells)), key=lambda i: hn.hilbert_keys(points, scale)[i].tobytes())
    steps = np.abs(np.diff(cells[order], axis=0)).sum(axis=1)
    assert len({k.tobytes() for k in hn.hilbert_keys(points, scale)}) == side * side and (steps == 1).all()


def test_distant_blocks_are_left_unread():
    """On clustered vectors, zone maps keep an anchor away from most blocks once its windows are narrow."""
    rows = clustered(5, 3000, 8, 1)
    q = np.floor(256 * np.array([v for _, _, v in rows])).astype(np.int64)
    q = q[np.argsort([k.tobytes() for k in hn.hilbert_keys(q, int(np.abs(q).max()))])]
    blocks = [q[i : i + 64] for i in range(0, len(q), 64)]
    anchors = q[::100]
    fifth = np.sort(anchors @ q.T, axis=1)[:, -6]
    _, most = hn.bounds(anchors, np.array([b.min(axis=0) for b in blocks]), np.array([b.max(axis=0) for b in blocks]))
    assert (most >= fifth[:, None]).mean() < 0.5
