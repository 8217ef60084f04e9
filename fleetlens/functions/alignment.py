"""Pairing the lines of two copies of a file: exact longest common subsequences in linear space, and blocks that moved."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict, deque
from collections.abc import Hashable, Sequence

import numpy as np

#: Pairs of equal items that are held as chains; two stretches with more of them are halved first, which holds a row of numbers at a time.
CHAINED = 1_000_000


def common_ends(x: Sequence, y: Sequence) -> tuple[int, int]:
    """How many items both begin with, and how many of the others both end with."""
    least = min(len(x), len(y))
    head = 0
    while head < least and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < least - head and x[len(x) - 1 - tail] == y[len(y) - 1 - tail]:
        tail += 1
    return head, tail


def align(x: Sequence[Hashable], y: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Pairs (index in x, index in y) of a longest common subsequence, whatever the sizes."""
    head, tail = common_ends(x, y)
    ends_x, ends_y = len(x) - tail, len(y) - tail
    left, right = set(x[head:ends_x]), set(y[head:ends_y])
    rows = [i for i in range(head, ends_x) if x[i] in right]
    columns = [j for j in range(head, ends_y) if y[j] in left]
    inner = _common([x[i] for i in rows], [y[j] for j in columns])
    return [(i, i) for i in range(head)] + [(rows[i], columns[j]) for i, j in inner] + [(ends_x + k, ends_y + k) for k in range(tail)]


def _common(x: list, y: list) -> list[tuple[int, int]]:
    places: dict = defaultdict(list)
    for j, v in enumerate(y):
        places[v].append(j)
    if len(x) > 1 and sum(len(places.get(v, ())) for v in x) > CHAINED:
        return _halved(x, y)
    # For each item of x its places in y, last first: each extends the shortest chain that ends before it.
    ends: list[int] = []
    links: list[tuple] = []
    for i, v in enumerate(x):
        for j in reversed(places.get(v, ())):
            k = bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    out, at = [], links[-1] if links else None
    while at:
        out.append(at[:2])
        at = at[2]
    return out[::-1]


def _halved(x: list, y: list) -> list[tuple[int, int]]:
    """Where the best path crosses the middle of x: the cut of y with the longest subsequences on both sides (Hirschberg)."""
    middle = len(x) // 2
    before, after = lengths(x[:middle], y), lengths(x[middle:][::-1], y[::-1])[::-1]
    cut = int(np.argmax(before + after))
    return _common(x[:middle], y[:cut]) + [(middle + i, cut + j) for i, j in _common(x[middle:], y[cut:])]


def lengths(x: list, y: list) -> np.ndarray:
    """Length of the longest common subsequence of x with each prefix of y, the empty one first; a row of the table is the bits of one integer."""
    masks: dict = defaultdict(int)
    for j, v in enumerate(y):
        masks[v] |= 1 << j
    full = (1 << len(y)) - 1
    row = full
    for v in x:
        met = row & masks.get(v, 0)
        row = ((row + met) | (row - met)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate(([0], np.cumsum(bits == 0)))


def carried(old: Sequence[Hashable], authored: Sequence[bool], new: Sequence[Hashable], trivial: Sequence[bool]) -> list[int]:
    """For each line of a newer copy the old line it is, or -1.

    Lines are paired in order first. An old line with an author that this leaves out is looked for among the
    new lines without a partner, and with it the block around it as far as it goes on. A trivial line is not looked for on its
    own: next to a line that kept its author, it takes an authored copy of itself that is still missing.
    """
    source = [-1] * len(new)
    left = set(range(len(old)))
    for i, j in align(old, new):
        source[j] = i
        left.discard(i)
    missing = {i for i in left if authored[i]}
    queues: dict = defaultdict(deque)
    for i in sorted(missing):
        queues[old[i]].append(i)

    def first(key: Hashable) -> int:
        """The first missing old line of this text, or -1."""
        queue = queues.get(key)
        while queue and queue[0] not in missing:
            queue.popleft()
        return queue[0] if queue else -1

    def pair(j: int, i: int) -> None:
        source[j] = i
        missing.discard(i)

    for j, key in enumerate(new) if missing else ():
        if source[j] < 0 and not trivial[j] and (i := first(key)) >= 0:
            pair(j, i)
            for step in (1, -1):
                k = 1
                while 0 <= (at := j + k * step) < len(new) and source[at] < 0 and (was := i + k * step) in missing and old[was] == new[at]:
                    pair(at, was)
                    k += 1
    for near, order in ((-1, range(len(new))), (1, range(len(new) - 1, -1, -1))):
        for j in order if missing else ():
            if source[j] < 0 and trivial[j] and 0 <= j + near < len(new) and source[j + near] >= 0 and authored[source[j + near]] and (i := first(new[j])) >= 0:
                pair(j, i)
    return source
