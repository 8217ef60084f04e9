"""Hunks of patches placed in later text: scenarios, and random patches against a literal search."""

import json
import random

import pytest

from fleetlens.operators import backfill, locate
from fleetlens.sources.fixtures import Tables


def tables_with(spark, patches, ranged):
    """Tables of apply_patch reports (id, command) alone, and of the events that have a range."""
    rows = [(i, "PostToolUse", json.dumps({"tool_name": "apply_patch", "tool_input": {"command": c}})) for i, c in patches]
    events = spark.createDataFrame(rows, "id string, event_type string, payload string")
    ranges = spark.createDataFrame([(f"g{e}", e, "f", "/f", 1, 1) for e in ranged], "id string, event_id string, rel_file_path string, file_path string, start_line long, end_line long")
    return Tables(None, events, ranges, None, None, None, None, None)


@pytest.mark.parametrize(
    "hunks, post, lines, lost",
    [
        ([[" a", "+x", " b"]], ["x", "a", "x", "b"], [3], 0),  # context tells which
        ([["+}"], ["+}"]], ["}", "k", "}"], [1, 3], 0),  # a claimed line is not another's
        ([[" a", "+x", "+y", " b"]], ["now", "x", "y", "b"], [2, 3], 0),  # context on one side is gone
        ([[" a", " k", "+x", " k", " b"]], ["q", "k", "x", "k", "r"], [3], 0),  # one line of context is left
        ([["+x"], [" a", "+n"]], ["a", "n", "x"], [3, 2], 0),  # before the cursor: from the top
        ([["-x", " a"]], ["a"], [], 0),  # nothing added
        ([["+x", " a", "+z"]], ["x", "b", "z"], [], 1),  # what stands between added lines counts
        ([["+x\r", " a"]], ["x", "a\r"], [1], 0),
        ([["+x", "\\ No newline at end of file"]], ["x"], [1], 0),
        ([["+x"]], [], [], 1),
        ([["", "+x", ""]], ["", "x", ""], [2], 0),
    ],
)
def test_place_hunks(hunks, post, lines, lost):
    assert locate.place_hunks(hunks, post) == (lines, lost)


def literal(hunks, post):
    """The same by trying every place for every width of context."""
    claimed, found, lost, cursor = set(), [], 0, 0
    for hunk in hunks:
        image = [(x[1:], x[0] == "+") for x in hunk if x[0] != "-"]
        new = [i for i, (_, n) in enumerate(image) if n]
        if not new:
            continue
        hit = None
        for context in (99, 1, 0):
            lo, hi = max(0, new[0] - context), min(len(image), new[-1] + 1 + context)
            for start in (cursor, 0):
                for at in range(start, len(post) - (hi - lo) + 1):
                    if hit is None and all(post[at + k] == image[lo + k][0] for k in range(hi - lo)) and not {at + i - lo for i in new} & claimed:
                        hit = at - lo
            if hit is not None:
                break
        if hit is None:
            lost += 1
            continue
        claimed |= {hit + i for i in new}
        found += [hit + i + 1 for i in new]
        cursor = min(hit + len(image), len(post))
    return found, lost


def test_random_patches_are_placed_as_by_literal_search():
    r = random.Random(6)
    for _ in range(1500):
        post = [r.choice("abc}") for _ in range(r.randint(0, 12))]
        hunks = [[r.choice(" +-+") + r.choice("abc}") for _ in range(r.randint(1, 5))] for _ in range(r.randint(1, 4))]
        assert locate.place_hunks(hunks, post) == literal(hunks, post)


def test_patches_without_ranges_are_placed_in_their_files(spark):
    command = "*** Begin Patch\n*** Update File: a.py\n@@ def\n one\n+two\n*** Add File: b.py\n+x\n+y\n*** Update File: old.py\n*** Move to: c.py\n@@\n+z\n*** Delete File: d.py\n*** Update File: a.py\n@@\n+five\n*** End Patch"
    T = tables_with(spark, [("e1", command), ("e2", command), ("e3", None)], ranged=["e2"])
    texts = spark.createDataFrame([("e1", "a.py", "src/a.py", "one\ntwo\nthree\nfive\n"), ("e1", "b.py", "src/b.py", "x\ny"), ("e1", "c.py", None, None), ("e2", "a.py", "src/a.py", "one\ntwo\n")], "event_id string, file_path string, rel_file_path string, text string")
    got = backfill.fill_patch_ranges(T, texts).where("event_id = 'e1'")
    assert sorted((r["rel_file_path"], r["start_line"], r["end_line"]) for r in got.collect()) == [("src/a.py", 2, 2), ("src/a.py", 4, 4), ("src/b.py", 1, 2)]
    placed = locate.place_patches(locate.patch_hunks(spark.createDataFrame([("e1", command)], "event_id string, command string")).join(texts, ["event_id", "file_path"]))
    assert sorted((r["file_path"], r["added"], r["removed"], r["unlocated"]) for r in placed.collect()) == [("a.py", 2, 0, 0), ("b.py", 2, 0, 0), ("c.py", 1, 0, 1)]


def test_lines_that_old_and_new_share_are_no_change(spark):
    edits = [
        ("e1", "top\nkeep\nnew 1\nmid\nnew 2\nend\n", [("keep\nold\nmid\nend", "keep\nnew 1\nmid\nnew 2\nend")]),
        ("e2", "a\r\nb\r\n", [("a\n", "a\nb\n"), ("x\ny", "")]),  # found with carriage returns folded; a deletion
        ("e3", "nothing of it", [("p\nq", "p\nr\ns")]),  # not found, counted
        ("e4", "z\nz\n", [("", "z\n"), ("", "z\n")]),  # each takes its own place
        ("e5", None, [(None, "v")]),
    ]
    df = spark.createDataFrame(edits, "event_id string, text string, edits array<struct<old_string:string,new_string:string>>")
    got = {(r["event_id"], r["edit"]): (r["added"], r["removed"], [tuple(s) for s in r["spans"]]) for r in locate.edit_changes(df).collect()}
    assert got == {
        ("e1", 0): (2, 1, [(3, 3), (5, 5)]), ("e2", 0): (1, 0, [(2, 2)]), ("e2", 1): (0, 2, []), ("e3", 0): (2, 1, []),
        ("e4", 0): (1, 0, [(1, 1)]), ("e4", 1): (1, 0, [(2, 2)]), ("e5", 0): (1, 0, []),
    }
