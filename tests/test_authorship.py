"""Authorship maps, looks and content attribution: one scenario each, random histories against a plain model, streams against the batch fold."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import alignment
from fleetlens.operators import attribution, authorship, changes, content
from fleetlens.streaming import stateful

RAW = (
    "file string, seq long, kind string, event_id string, session_id string, ts long, began long, as_of long, text string, spans array<struct<a:int,b:int>>, "
    "seeds array<struct<a:int,b:int,event_id:string,session_id:string,agent_slug:string,ts:long>>, commit_id string, committed_at long, added array<int>, base_text string, credits boolean"
)
S = 1_000_000


def raw(seq, kind, text, event=None, session=None, spans=(), as_of=None, began=None, commit=None, added=(), base=None, credits=None, seeds=(), file="f"):
    at = (seq if as_of is None else as_of) * S
    return (file, seq, kind, event, session, at, at if began is None else began * S, at, "".join(f"{x}\n" for x in text), list(spans), list(seeds), commit, at, list(added), None if base is None else "\n".join(base), credits)


def steps(spark, rows):
    made = spark.createDataFrame(rows, RAW)
    return made.withColumns({"lines": authorship.text_lines(F.col("text")), "base": authorship.text_lines(F.col("base_text"))})


def edit(seq, text, event, spans, **more):
    return raw(seq, "edit", text, event, more.pop("session", f"s-{event}"), spans, **more)


def owners(spark, rows):
    got = authorship.fold(steps(spark, rows)).where("kind = 'map'").orderBy("file", "line").collect()
    return [r["event_id"] for r in got]


def test_lines_pair_as_by_plain_dynamic_programming():
    def longest(x, y):
        d = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                d[i + 1][j + 1] = d[i][j] + 1 if a == b else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    r = random.Random(1)
    held = alignment.CHAINED
    try:
        for _ in range(600):
            alignment.CHAINED = r.choice([0, 2, 10, held])
            x, y = ([r.randint(0, 4) for _ in range(r.randint(0, 12))] for _ in "xy")
            met = alignment.align(x, y)
            assert all(x[i] == y[j] for i, j in met) and all(a < c and b < d for (a, b), (c, d) in zip(met, met[1:])) and len(met) == longest(x, y)
            assert list(alignment.lengths(x, y)) == [longest(x, y[:k]) for k in range(len(y) + 1)]
    finally:
        alignment.CHAINED = held


def test_two_large_stretches_of_few_kinds_of_lines_are_paired_in_full():
    r = random.Random(2)
    x = [r.randint(0, 3) for _ in range(3000)]
    assert alignment.align(x, x[:1500] + [9] + x[1500:]) == [(i, i + (i >= 1500)) for i in range(3000)]
    y = [r.randint(0, 3) for _ in range(3000)]
    assert len(alignment.align(x, y)) == alignment.lengths(x, y)[-1] > 1500




@pytest.mark.parametrize(
    "rows, expected",
    [
        # a hand insert above pushes lines down; the next edit sees it
        ([edit(1, ["x1", "x2"], "e1", [(1, 2)]), edit(2, ["by hand", "x1", "x2", "y"], "e2", [(4, 4)])], [None, "e1", "e1", "e2"]),
        # a line rewritten by hand is nobody's
        ([edit(1, ["x1", "x2"], "e1", [(1, 2)]), edit(2, ["x1", "changed", "y"], "e2", [(3, 3)])], ["e1", None, "e2"]),
        # other white space is the same line
        ([edit(1, ["if a:", "b = 1"], "e1", [(1, 2)]), edit(2, ["  if a:", "\tb  =  1", "y"], "e2", [(3, 3)])], ["e1", "e1", "e2"]),
        # a block moved by hand, with the brace inside it
        ([edit(1, ["f() {", "one", "}", "g() {", "two", "}", "tail 1", "tail 2", "tail 3"], "e1", [(1, 3)]), edit(2, ["g() {", "two", "}", "tail 1", "tail 2", "tail 3", "f() {", "one", "}", "y"], "e2", [(10, 10)])], [None, None, None, None, None, None, "e1", "e1", "e1", "e2"]),
        # two agents, the later one writes over a line
        ([edit(1, ["x1", "x2"], "e1", [(1, 2)]), edit(2, ["x1", "x2", "z"], "e2", [(2, 3)])], ["e1", "e2", "e2"]),
        # an edit without a session writes nobody's lines, and its lines lose their author
        ([edit(1, ["x1"], "e1", [(1, 1)]), raw(2, "edit", ["x1", "q"], "e2", None, [(2, 2)])], ["e1", None]),
        # a late edit claims its lines, but not those of an event that began after it
        ([edit(1, ["x1", "x2"], "e1", [(1, 2)], as_of=1), edit(2, ["x1", "x2", "new"], "e3", [(3, 3)], as_of=9), edit(3, ["x1", "new"], "e2", [(1, 2)], as_of=5)], ["e2", "e1", "e3"]),
        # a bare snapshot gets its authors from uncommitted ranges, the latest last, without the event at hand
        ([raw(1, "snapshot", ["x1", "x2", "x3"]), edit(2, ["x1", "x2", "x3", "y"], "e9", [(4, 4)], seeds=[(1, 2, "e1", "s1", "codex", 1), (2, 3, "e2", "s2", "codex", 2), (1, 3, "e9", "s9", "codex", 3), (1, 1, "e0", None, "codex", 4)])], ["e1", "e2", "e2", "e9"]),
        # spans outside the text, and an empty copy
        ([edit(1, ["x1"], "e1", [(-3, 7)])], ["e1"]),
        ([edit(1, ["x1"], "e1", [(1, 1)]), edit(2, [], "e2", [(1, 1)])], []),
    ],
)
def test_scenarios(spark, rows, expected):
    assert owners(spark, rows) == expected


def test_looks_credit_what_neither_map_nor_base_has(spark):
    rows = [
        edit(1, ["x1", "x2"], "e1", [(1, 2)], session="s"),
        raw(2, "look", ["x1", "made", "base", "other"], "shell", "s", base=["base"], credits=True),
        raw(3, "look", ["x1", "made", "base", "other", "by hand"], "prompt", "s", base=["base"], credits=False),
        edit(4, ["x1", "made"], "late", [(2, 2)], as_of=2, began=2),
    ]
    folded = authorship.fold(steps(spark, rows)).cache()
    assert [r["event_id"] for r in folded.where("kind = 'map'").orderBy("line").collect()] == ["e1", "late", None, "shell", None]
    assert sorted((r["kind"], r["by"], r["line"]) for r in folded.where("kind <> 'map'").collect()) == [("look", "shell", 2), ("look", "shell", 4), ("rework", "shell", 2), ("taken", "late", 2)]
    settled = {r["event_id"]: (r["lines_generated"], r["lines_reworked"], [tuple(s) for s in r["spans"]]) for r in authorship.settled_credits(folded).collect()}
    assert settled == {"shell": (1, 1, [(4, 4)])}


def test_look_gates(spark):
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    rows = [
        ("r", "first", "shell", "s", at(0), at(0), False, True, True), ("r", "good", "shell", "s", at(5), at(6), False, True, True), ("r", "old", "shell", "s", at(10), at(21), False, True, True),
        ("r", "moves", "shell", "s", at(30), at(30), True, True, True), ("r", "prompt", "prompt", "s", at(31), at(31), False, True, True), ("r", "nobody", "shell", None, at(32), at(32), False, True, True),
        ("r", "pulled", "shell", "s", at(33), at(33), False, True, False), ("r", "blind", "shell", "s", at(34), at(34), False, False, True), ("r", "after", "shell", "s", at(35), at(35), False, True, True),
        ("r", "again", "shell", "s", at(36), at(36), False, True, True), ("r", "far", "shell", "s", at(36 + 15 * 1440), at(36 + 15 * 1440), False, True, True), ("q", "own", "shell", "s", at(1), at(1), False, True, True),
    ]
    got = authorship.look_gates(spark.createDataFrame(rows, "repo_id string, event_id string, kind string, session_id string, fired_at timestamp, looked_at timestamp, moves_content boolean, answered boolean, plain boolean"))
    assert {r["event_id"] for r in got.where("credits").collect()} == {"good", "again"}


def credits(spark, rows, parents, carried=None):
    made = content.map_credits(steps(spark, rows), spark.createDataFrame(parents, "id string, parent string"), carried)
    return sorted((r["commit_id"], r["line"], r["event_id"]) for r in made.where("counts").collect())


def test_commits_are_credited_by_content(spark):
    text = ["by hand", "x1", "x2", "y"]
    rows = [
        edit(1, ["x1", "x2"], "e1", [(1, 2)]), edit(2, ["x1", "x2", "y"], "e2", [(3, 3)]),
        raw(3, "commit", text, commit="c1", added=[1, 2, 4]),  # only what is staged
        raw(4, "commit", text, commit="c2", added=[1, 2, 3, 4]),  # its child adds them again: counted but for the line that c1 left out
        raw(5, "commit", text, commit="c3", added=[2, 3]),  # another branch counts them
        edit(6, ["x1", "x2", "y", "z"], "e3", [(4, 4)], began=9),
        raw(7, "commit", ["x1", "z"], commit="c4", added=[1, 2], as_of=8),  # made before e3 began
    ]
    parents = [("c0", None), ("c1", "c0"), ("c2", "c1"), ("c3", "c0"), ("c4", "c3")]
    assert credits(spark, rows, parents) == [("c1", 2, "e1"), ("c1", 4, "e2"), ("c2", 3, "e1"), ("c3", 2, "e1"), ("c3", 3, "e1")]
    # c2 carries c1, say an amend: then c1 is no ancestor, whatever parents say.
    carried = spark.createDataFrame([("c2", "c1")], "commit_id string, carried_id string")
    assert ("c2", 2, "e1") in credits(spark, rows, parents, carried)


def test_pairs_on_one_chain(spark):
    r = random.Random(4)
    parent = {f"c{i}": f"c{r.randint(max(0, i - 3), i - 1)}" if i and r.random() < 0.97 else None for i in range(300)} | {"lost": "unknown"}

    def above(c, depth):
        out = []
        while c in parent and parent[c] is not None and len(out) < depth:
            c = parent[c]
            out.append(c)
        return out

    pairs = [(f"c{r.randint(0, 299)}", f"c{r.randint(0, 299)}") for _ in range(600)] + [(f"c{i}", x) for i in range(250, 300) for x in above(f"c{i}", 300)[-3:]] + [("lost", "unknown"), ("c1", "c1")]
    made = spark.createDataFrame(pairs, "id string, ancestor string")
    for depth in (20, 500):
        got = {tuple(x) for x in content.on_chain(made, spark.createDataFrame(list(parent.items()), "id string, parent string"), depth).select("id", "ancestor").collect()}
        assert got == {p for p in pairs if p[1] in above(p[0], depth) and p[1] in parent}


def test_lines_inherited_from_rewritten_commits(spark):
    rest = spark.createDataFrame([("c", "f", i, n) for i, n in [(1, 10), (2, 20), (5, 30), (6, 40)]], "commit_id string, file_path string, line int, norm long")
    originals = spark.createDataFrame(
        [("c", "o1", 0, "f", 1, 20, "s1"), ("c", "o1", 0, "f", 2, 99, "s1"), ("c", "o2", 1, "f", 1, 10, "s2"), ("c", "o2", 1, "f", 2, 20, "s2"), ("c", "o2", 1, "f", 3, 40, "s3"), ("c", "o2", 1, "g", 1, 10, "s3")],
        "commit_id string, carried_id string, place long, file_path string, line int, norm long, session_id string",
    )
    assert sorted((r["line"], r["session_id"], r["carried_id"]) for r in content.inherited_lines(rest, originals).collect()) == [(1, "s2", "o2"), (2, "s1", "o1"), (6, "s3", "o2")]


def test_every_combination_of_records_chooses_a_method(spark):
    since, rows, expected = dt.datetime(2024, 1, 10), {k: [] for k in ("files", "commits", "mapped", "recorded", "credited", "carried")}, {}
    for i in range(32):
        new, has_map, carries, lines, credit = (bool(i >> k & 1) for k in range(5))
        c, f = f"c{i}", f"f{i}"
        rows["files"].append((c, f))
        rows["commits"].append((c, "r", since if new else since - dt.timedelta(seconds=1)))
        rows["mapped"] += [("r", f)] if has_map else []
        rows["carried"] += [(c, f"o{i}")] if carries else []
        rows["recorded"] += [(f"o{i}", f)] if lines else []
        rows["credited"] += [(f"o{i}", f, 3)] if credit else [(f"o{i}", f, 0)]
        expected[c] = new and not (carries and credit and not lines) and (has_map or (carries and lines))
    types = {"files": "commit_id string, file_path string", "commits": "id string, repo_id string, committed_at timestamp", "mapped": "repo_id string, file_path string", "recorded": "commit_id string, file_path string", "credited": "commit_id string, file_path string, lines_attributed long", "carried": "commit_id string, carried_id string"}
    t = {k: spark.createDataFrame(v, types[k]) for k, v in rows.items()}
    got = content.method(t["files"], t["commits"], since, t["mapped"], t["recorded"], t["credited"], t["carried"])
    assert {r["commit_id"]: r["by_content"] for r in got.collect()} == expected


def history(seed, files=3, n=12):
    """Edits of a few files, handled in an order of their own, so some come late."""
    r, rows = random.Random(seed), []
    for f in range(files):
        text, made = [f"l{i}" for i in range(4)], []
        for k in range(n):
            at, size = r.randint(0, len(text)), r.randint(1, 3)
            new = [f"{f}-{k}-{i}" if r.random() < 0.8 else "}" for i in range(size)]
            text = text[:at] + new + text[at + r.randint(0, 2) :]
            made.append((k, list(text), [(at + 1, at + size)]))
        order = list(range(n))
        for k in range(0, n - 2, 4):
            order[k], order[k + 2] = order[k + 2], order[k]
        for seq, k in enumerate(order):
            at, lines, spans = made[k]
            rows.append(edit(seq, lines, f"e{f}-{at}", spans, as_of=at, began=at, file=f"f{f}"))
    return rows


def in_batches(spark, table, parts, run):
    """What a query writes over a stream of the table's parts, a file each."""
    where, out = tempfile.mkdtemp(prefix="spark-"), []
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{where}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    key, value = stateful.STATE_STORE
    spark.conf.set(key, value)
    query = run(stream).writeStream.foreachBatch(lambda df, k: out.extend((k, r) for r in df.collect())).option("checkpointLocation", f"{where}/c").outputMode("update").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(60)
    finally:
        query.stop()
        spark.conf.unset(key)
    return out


def test_a_stream_of_edits_keeps_the_map_that_a_batch_folds(spark):
    table = steps(spark, history(5))
    batch = authorship.fold(table)
    expected = sorted((r["file"], r["line"], r["event_id"], r["hash"]) for r in batch.where("kind = 'map'").collect())
    taken = sorted((r["by"], r["event_id"], r["line"]) for r in batch.where("kind = 'taken'").collect())
    rows = in_batches(spark, table, [table.where(f"seq >= {a} and seq < {b}") for a, b in ((0, 3), (3, 4), (4, 9), (9, 12))], lambda s: stateful.authorship_stream(s, None))
    last = {}
    for k, r in rows:
        if r["kind"] == "map":
            last.setdefault((r["file"], k), []).append((r["file"], r["line"], r["event_id"], r["hash"]))
    newest = {f: max(k for g, k in last if g == f) for f, _ in last}
    assert sorted(x for f, k in newest.items() for x in last[f, k]) == expected and len(expected) > 20
    assert sorted((r["by"], r["event_id"], r["line"]) for _, r in rows if r["kind"] == "taken") == taken


def test_a_stream_of_edits_reworks_what_a_batch_reworks(spark):
    r, rows = random.Random(8), []
    for k in range(30):
        s, f = f"s{k % 2}", f"f{k % 3}"
        rows += [(s, f, k, f"e{k:02}", "added", r.choice("abcd"), None) for _ in range(r.randint(0, 3))]
        rows += [(s, f, k, f"e{k:02}", "removed", x, r.randint(1, 3)) for x in r.sample("abcd", r.randint(0, 3))]
    lines = spark.createDataFrame(rows, "session_id string, file string, at int, event_id string, kind string, text string, copies int")
    expected = sorted(map(tuple, changes.rework(lines).collect()))
    table = changes.edit_steps(lines)
    got = in_batches(spark, table, [table.where(f"at >= {a} and at < {a + 10}") for a in (0, 10, 20)], lambda s: stateful.rework_stream(s, None, None))
    assert sorted(tuple(r) for _, r in got) == expected and sum(x[4] for x in expected) > 3


def test_looks_wait_for_the_watermark(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    look = lambda event, s, **more: ("r", event, more.get("kind", "shell"), "x", at(s), more.get("moves"), more.get("answered"), None)
    schema = "repo_id string, event_id string, kind string, session_id string, fired_at timestamp, moves_content boolean, answered boolean, plain boolean"
    batches = [[look("one", 0), look("two", 1)], [look("three", 100)], [look("four", 200, moves=True), look("five", 201)], [look("six", 400)]]
    parts = [spark.createDataFrame(b, schema) for b in batches]
    got = in_batches(spark, parts[0], parts, stateful.look_stream)
    found = {r["event_id"]: r for _, r in got}
    # The first look sees nothing before it; the one that no later event's watermark passes still waits.
    assert "six" not in found and {k for k, r in found.items() if r["credits"]} == {"two", "three", "five"}
    assert all(r["looked_ms"] >= r["fired_ms"] + 500 for r in found.values())


def test_roll_up_keeps_a_row_for_every_session_that_was_looked_at(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    files = [("c", "A", "f", at(5), at(9), 2, 4, "position"), ("c", "A", "g", at(3), at(4), 1, 1, "content"), ("c", "B", "f", at(1), at(1), 1, 0, "position"), ("c", "D", "f", at(2), at(2), 1, 3, "churn")]
    of = spark.createDataFrame(files, "commit_id string, session_id string, file_path string, first_event_ts timestamp, last_event_ts timestamp, event_count long, lines_attributed long, method string")
    candidates = spark.createDataFrame([("c", "A", at(6)), ("c", "B", at(1)), ("c", "B", at(8))], "commit_id string, session_id string, ts timestamp")
    sessions = spark.createDataFrame([("A", "codex", "m"), ("B", "pi", None)], "id string, agent_slug string, model_slug string")
    before = spark.createDataFrame([("c", "A", "codex", "m", at(0), at(0), "old", "old"), ("c", "Z", "cursor", "z", at(0), at(7), "was", "so")], "commit_id string, session_id string, agent_slug string, model_slug string, first_event_ts timestamp, last_event_ts timestamp, attribution_source string, confidence string")
    got = {r["session_id"]: tuple(r)[2:] for r in attribution.roll_up(of, candidates, sessions, before).collect()}
    assert got == {
        "A": ("codex", "m", at(3), at(9), 3, 2, 5, *attribution.BY_CONTENT), "B": ("pi", None, at(1), at(8), 0, 0, 0, *attribution.BY_POSITION),
        "D": (None, None, at(2), at(2), 1, 1, 3, *attribution.BY_CHURN), "Z": ("cursor", "z", at(0), at(7), 0, 0, 0, "was", "so"),
    }
