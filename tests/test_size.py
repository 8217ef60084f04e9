"""Work that must not grow with what a question leaves out: spans that only count at their ends, and files that nobody asks about."""

import datetime as dt
import random

from fleetlens.operators import attribution, blame, maintenance, metrics
from fleetlens.sources import git
from fleetlens.sources.fixtures import Tables, load

T0 = dt.datetime(2026, 1, 1)
FAR = 3_000_000_000  # more lines than an array can hold


def made(spark, files):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    empty = spark.createDataFrame([], "x int")
    return Tables(**{n: empty for n in Tables.__dataclass_fields__} | {
        "events": spark.createDataFrame([("e1", "S", "r", at(1)), ("e2", "T", "r", at(2))], "id string, session_id string, repo_id string, ts timestamp"),
        "ranges": spark.createDataFrame([("e1", "f", 1, 3), ("e2", "f", 3, 4)], "event_id string, rel_file_path string, start_line long, end_line long"),
        "commits": spark.createDataFrame([("c1", "r", at(2)), ("c2", "r", at(2)), ("c3", "r", at(9))], "id string, repo_id string, committed_at timestamp"),
        "commit_files": spark.createDataFrame(files, "commit_id string, file_path string, lines_added long"),
    })


def test_added_lines_are_not_spread_for_attribution(spark):
    T = made(spark, [("c1", "f", FAR), ("c2", "f", 3), ("c3", "f", 5), ("c3", "g", FAR)])
    got = sorted(tuple(x) for x in attribution.owned(T).select("commit_id", "line", "event_id").collect())
    assert got == [("c1", 1, "e1"), ("c1", 2, "e1"), ("c1", 3, "e2"), ("c1", 4, "e2"), ("c2", 1, "e1"), ("c2", 2, "e1"), ("c2", 3, "e2")]
    rows = {(x["commit_id"], x["session_id"]): (x["event_count"], x["files_touched"], x["lines_attributed"]) for x in attribution.attribute_sessions(T).collect()}
    assert rows == {("c1", "S"): (1, 1, 2), ("c1", "T"): (1, 1, 2), ("c2", "S"): (1, 1, 2), ("c2", "T"): (1, 1, 1)}


def test_latest_lines_spread_only_the_newest_of_a_length(spark):
    T = made(spark, [("c1", "f", 4), ("c2", "f", 4), ("c3", "f", 2), ("c3", "g", 1)])
    lines = blame.latest_lines(T)
    assert sorted(tuple(x) for x in lines.select("file_path", "line", "commit_id").collect()) == [("f", 1, "c3"), ("f", 2, "c3"), ("f", 3, "c2"), ("f", 4, "c2"), ("g", 1, "c3")]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate explode"):]  # commits are thinned out before lines are made


def test_blame_leaves_out_files_that_have_no_line(spark):
    T = made(spark, [("c1", "f", 2)])
    shown = blame.latest_lines(T).select("repo_id", "file_path", "line", "commit_id").toDF("repo_id", "file_path", "final_line", "commit_id").withColumn("orig_line", blame.F.col("final_line"))
    who = "event_id string, session_id string, agent_slug string, model_slug string, ts string"
    none = lambda schema: spark.createDataFrame([], schema)
    notes = spark.createDataFrame([("c1", 2, "f", 2, 2, "pi", "s", None, "1"), ("c9", 2, "f", 1, FAR, "pi", "no", None, "1"), ("c1", 2, "h", 1, FAR, "pi", "no", None, "1")], "commit_id string, v int, file_path string, start_line long, end_line long, agent string, session string, model string, ts string")
    got = blame.credit(
        shown, none(f"repo_id string, file_path string, commit_id string, start_line long, end_line long, {who}"), none("commit_id string, file_path string, line long, session_id string, agent_slug string, model_slug string, ts string"),
        none("commit_id string, file_path string"), notes, none(f"repo_id string, file_path string, line long, {who}, counted_in array<string>"),
    )
    assert sorted(tuple(x) for x in got.select("final_line", "source", "session_id").collect()) == [(1, None, None), (2, "note", "s")]


def test_the_only_author_of_a_span_against_brute_force(spark):
    rng = random.Random(3)
    at = lambda s: T0 + dt.timedelta(hours=s)
    commits = [(rng.choice("rq"), rng.choice(["a", "b", None]), rng.randrange(60)) for _ in range(50)]
    spans = [(f"s{i}", rng.choice("rq"), a, a + rng.randrange(8)) for i in range(120) for a in [rng.randrange(60)]] + [("none", None, 1, 2), ("open", "r", 1, None), ("back", "r", 5, 4)]
    want = {}
    for s, repo, a, b in spans:
        who = {w for r, w, t in commits if r == repo and w and b is not None and a <= t <= b}
        if len(who) == 1:
            want[s] = who.pop()
    sessions = spark.createDataFrame([(s, r, at(a), None if b is None else at(b)) for s, r, a, b in spans], "id string, repo_id string, started_at timestamp, ended_at timestamp")
    made = maintenance.session_engineer(sessions, spark.createDataFrame([(r, w, at(t)) for r, w, t in commits], "repo_id string, author_email string, committed_at timestamp"))
    assert len(want) > 20 and {x["session_id"]: x["engineer_email"] for x in made.collect()} == want
    # Commits and spans share no join: pairs of a busy repository and day would be their product.
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_a_run_of_added_lines_is_one_row_of_python(spark):
    diff = "--- a/x\n+++ b/x\n@@ -1,2 +1,5 @@\n a\n+b\n++c\n+\n-d\n\\ No newline at end of file\n+e\n+++ b/y\n@@ -0,0 +7,2 @@\n++++ z\n+f"
    assert list(git._added(diff)) == [("x", 2, "+b\n++c\n+"), ("x", 5, "+e"), ("y", 7, "++++ z\n+f")]
    rows = git.parse_unified_diff(spark.createDataFrame([("c", diff), ("d", None)], "commit_id string, diff string")).collect()
    assert sorted(tuple(r) for r in rows) == [("c", "x", 2, "b"), ("c", "x", 3, "+c"), ("c", "x", 4, ""), ("c", "x", 5, "e"), ("c", "y", 7, "+++ z"), ("c", "y", 8, "f")]


def test_sessions_join_summed_line_items_and_edits_are_scored_once(spark):
    T = load(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for table in (T.commit_sessions, T.extra["commit_session_files"]):
        assert "Join Inner" in plan(table) and "Aggregate" not in plan(table)[: plan(table).index("Join Inner")]
    assert "tool_name" not in plan(metrics.breakdown(T, by="agent"))
