"""The telemetry operators on constructed inputs with known answers."""

import base64
import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import columns
from fleetlens.operators import attribution, backfill, blame, changes, edits, filters, locate, maintenance, metrics, normalize, sessions
from fleetlens.plans import derived, registry
from fleetlens.sources import envelopes, git
from fleetlens.sources.fixtures import Tables
from fleetlens.streaming import ingest

T0 = dt.datetime(2026, 10, 10, 12)
EVENT = "id string, session_id string, ts timestamp, event_type string, agent_slug string, file_path string, repo_id string, rel_file_path string, lines_added long, lines_generated long, lines_reworked long, payload string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def event(i, session, seconds, kind="PostToolUse", agent="claude-code", file=None, generated=None, reworked=None, tool=None, text=None, added=None):
    payload = {k: v for k, v in {"tool_name": tool, "tool_input": {"new_string": text} if text else None}.items() if v}
    return (i, session, at(seconds), kind, agent, file and f"/w/r/{file}", "r", file, added, generated, reworked, json.dumps(payload))


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        event("e1", "A", 0, tool="Edit", file="a.py", generated=5, reworked=2), event("e2", "A", 20, tool="Read"), event("e3", "A", 1000, tool="Write", file="b.py", text="x\ny\n"),
        event("e4", "B", 0, "afterFileEdit", "cursor", file="c.py", text="1\n2\n3\n"), event("e5", "B", 5, agent="cursor", tool="Write", file="c.py", text="1\n"), event("e6", "B", 6, agent="cursor", tool="Write", file="c.py", text="1\n"),
        event("e7", "C", 0, tool="Bash"), event("e8", "A", 30, "Stop"), event("e9", "B", 7, tool="apply_patch", agent="codex", file="d.py", added=9),
    ]
    session = "id string, agent_slug string, model_slug string, repo_id string, engineer_email string, engineer_name string, started_at timestamp, ended_at timestamp, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long"
    made = [(s, a, m, "r", e, e, at(0), end, i, i, i, i) for s, a, m, e, end, i in (("A", "claude-code", "m", "x@y", at(1000), 10), ("B", "cursor", None, None, None, None), ("C", "claude-code", "m", "x@y", at(10), 5))]
    commits = [("c1", "r", "s1", "x@y", "x", at(500), 10, 0, 1), ("c2", "r", "s2", "x@y", "x", at(2000), 3, 0, 1)]
    return Tables(
        sessions=spark.createDataFrame(made, session), events=spark.createDataFrame(rows, EVENT),
        ranges=spark.createDataFrame([("g1", "e1", "a.py", "/w/r/a.py", 3, 7), ("g2", "e3", "b.py", "/w/r/b.py", 5, 4)], "id string, event_id string, rel_file_path string, file_path string, start_line long, end_line long"),
        commits=spark.createDataFrame(commits, "id string, repo_id string, sha string, author_email string, author_name string, committed_at timestamp, lines_added long, lines_removed long, files_changed long"),
        commit_files=spark.createDataFrame([("c1", "a.py", 5, 0), ("c2", "a.py", 9, 0)], "commit_id string, file_path string, lines_added long, lines_removed long"),
        commit_sessions=spark.createDataFrame([("c1", "A", "claude-code", "m", 1, 4), ("c1", "C", "claude-code", "m", 1, 0)], "commit_id string, session_id string, agent_slug string, model_slug string, event_count long, lines_attributed long"),
        prompts=spark.createDataFrame([("A", 1, at(-5), "claude-code", "do it"), ("A", 2, at(10), "claude-code", "do it"), ("A", 3, None, "claude-code", "x 50%_")], "session_id string, seq long, ts timestamp, agent_slug string, prompt_text string"),
        repositories=spark.createDataFrame([("r", "/w/r", "git@h:o/p.git", "p"), ("q", "/w/r/sub", "", "q")], "id string, root_path string, remote_url string, name string"),
    )


def got(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_scored_edits(tables):
    scored = {r["id"]: (r["lines"], r["lines_written"], r["lines_replaced"]) for r in edits.ai_edits_scored(tables).collect()}
    assert scored == {"e1": (3, 5, 2), "e3": (2, 2, 0), "e4": (3, 3, 0), "e6": (1, 1, 0), "e9": (9, 9, 0)}  # e5 repeats e4 within five seconds, e6 comes after six


def test_active_time_and_concurrency(tables):
    assert got(metrics.session_active(tables), "session_id", "active_minutes") == [("A", (20 + 10 + 300) / 60), ("B", 7 / 60), ("C", 0.0)]
    assert metrics.max_concurrent(tables).head()[0] == 3
    assert metrics.token_totals(tables.having(sessions=tables.sessions.where("id = 'B'"))).head()[0] is None


def test_outcomes_and_filters(tables):
    assert got(metrics.session_outcomes(tables), "session_id", "outcome") == [("A", "shipped"), ("B", "edited"), ("C", "explored")]
    f = filters.Filters(dt.date(2026, 10, 10), dt.date(2026, 10, 11))
    assert f.days() == 2 and f.prior().end == dt.date(2026, 10, 9)
    assert got(filters.Filters(search="50%_").session_list(tables), "id") == [("A",)] and got(filters.Filters(search="DO IT").session_list(tables), "id") == [("A",)]
    assert filters.Filters(models=("m",)).session_list(tables).count() == 2 and filters.Filters(models=("unknown",)).sessions(tables.sessions).count() == 1


def test_position_attribution(tables):
    assert got(attribution.attribute_sessions(tables), "commit_id", "session_id", "lines_attributed", "files_touched") == [("c1", "A", 3, 1)]  # lines 3 to 5 of 3 to 7
    assert got(attribution.line_runs(attribution.owned_lines(attribution.candidate_ranges(tables), attribution.added_lines(tables)), ["commit_id"]), "commit_id", "runs") == [("c1", "3-5")]
    assert got(attribution.attribute_by_churn(tables), "lines_attributed") == [(5,)]


def test_attribution_counts_every_added_line(tables, spark):
    long = tables.having(
        ranges=spark.createDataFrame([("g1", "e1", "a.py", "/w/r/a.py", 3, 200)], tables.ranges.schema),
        commit_files=spark.createDataFrame([("c1", "a.py", 150, 0)], tables.commit_files.schema),
    )
    assert got(attribution.attribute_files(long), "commit_id", "lines_attributed") == [("c1", 148)]
    assert got(attribution.attribute_sessions(long), "commit_id", "session_id", "lines_attributed") == [("c1", "A", 148)]
    rows = blame.blame(long, blame.latest_lines(long))
    assert got(blame.blame_summary(rows), "total", "ai_lines") == [(150, 148)] and got(blame.blame_sessions(rows), "session_id", "lines") == [("A", 148)]


def test_closure_reaches_any_depth(spark):
    chain = spark.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(40)], "id string, parent string")
    for depth in (1, 5, 7, 39):
        assert attribution.ancestor_closure(chain, depth).count() == sum(min(i, depth) for i in range(40))


def test_ancestors_reach_five_hundred_steps(spark, tables):
    commits = spark.createDataFrame([(f"c{i:03}", "r", at(i)) for i in range(520)], "id string, repo_id string, committed_at timestamp")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(registry, "load", lambda spark, sf_dir: tables.having(commits=commits))
        made = {(r["id"], r["ancestor"], r["steps"]) for r in registry.QUERIES["ancestors"](spark, "").collect()}
    assert made == {(f"c{i:03}", f"c{i - k:03}", k) for i in range(520) for k in range(1, min(i, 500) + 1)}


def test_carried_commits(spark, tables):
    lines = [("c1", "a.py", f"line {i}") for i in range(4)] + [("c2", "a.py", f" line {i}") for i in range(3)] + [("c2", "a.py", "}")]
    made = attribution.carried_overlap(spark.createDataFrame(lines, "commit_id string, file_path string, text string"), tables.commits, attribution.checkout_groups(tables.repositories))
    assert got(made, "commit_id", "carried_id", "shared", "of") == [("c2", "c1", 3, 4)]


def test_turns_and_prompts(tables):
    turns = got(sessions.build_turns(tables), "session_id", "turn", "prompts", "tools", "open")
    assert turns == [("A", 0, 2, 2, False), ("A", 1, 0, 1, True), ("B", 0, 0, 4, True), ("C", 0, 0, 1, True)]
    assert got(sessions.classify_prompts(tables.prompts).where("seq < 3"), "seq", "kind", "resend_s")[1] == (2, "resend", 15)
    assert [r["seq"] for r in attribution.prompt_before(tables.events.where("session_id = 'A'"), tables.prompts).orderBy("event_id").collect()] == [1, 2, 2, 2]


def test_maintenance(tables, spark):
    rows = tables.events.unionByName(spark.createDataFrame([("p", "P", at(0), "PostToolUse", "codex", None, None, None, None, None, None, '{"cursor_version":"1"}')], EVENT))
    clean = maintenance.remove_phantoms(tables.having(events=rows))
    assert clean.events.count() == 9 and clean.sessions.count() == 3
    assert maintenance.orphan_sessions(rows, tables.sessions).count() == 1
    kept = maintenance.prune(tables, at(40), 0)
    assert {r["id"] for r in kept.events.collect()} == {"e1", "e3"}
    table = spark.createDataFrame([(1, None), (2, at(0)), (3, None)], "id int, synced_at timestamp")
    pending = maintenance.select_pending(table)
    assert got(pending, "id") == [(1,), (3,)] and maintenance.select_pending(maintenance.mark_synced(table, pending, at(9))).count() == 0


def test_normalising(spark, tables):
    send = lambda agent, text, when="2026-01-01T00:00:00Z": (agent, "/w", when, base64.b64encode(text.encode()).decode())
    rows = spark.createDataFrame([send("pi", '{"hook_event_name":"agentStop","session_id":"1","model":5}'), send("pi", " "), send("pi", "not json"), send("pi", "{}", "never"), send("codex", '{"cursor_version":"2","session_id":"1"}')], envelopes.ENVELOPE)
    events = normalize.parse_envelopes(rows)
    assert got(events.where("agent_slug = 'pi'").fillna("-"), "event_type", "session_id", "model", "payload") == [("-", "-", "-", '{"raw":"not json"}'), ("Stop", "1", "-", '{"hook_event_name":"agentStop","session_id":"1","model":5}'), ("hook_misfire", "-", "-", "-")]
    assert normalize.drop_cross_delivered(events).where("agent_slug = 'codex'").count() == 0
    assert got(normalize.resolve_session_ids(events.where("session_id is not null")), "session_id") == [("1",), ("codex:1",)]
    paths = spark.createDataFrame([("1", "/w/r/a/b.py"), ("2", "/w/r/sub/c.py"), ("3", "/x"), ("4", None)], "id string, file_path string")
    assert got(normalize.resolve_paths(paths, tables.repositories).fillna("-"), "id", "repo", "rel") == [("1", "r", "a/b.py"), ("2", "q", "c.py"), ("3", "-", "-"), ("4", "-", "-")]
    patch = "*** Begin Patch\n*** Update File: a.py\n@@\n-x\n+y\n+z\n*** Add File: b.py\n+1\n*** Update File: old.py\n*** Move to: new.py\n+q\n*** Delete File: gone.py\n*** Update File: a.py\n+w\n*** End Patch"
    assert got(normalize.patch_files(spark.createDataFrame([("e", patch)], "event_id string, command string")), "file_path", "added", "removed") == [("a.py", 3, 1), ("b.py", 1, 0), ("new.py", 1, 0)]
    shell = [("1", "echo hi > out.txt 2>&1"), ("2", "cat x | tee -a log.md >/dev/null"), ("3", "sed -i 's/a/b/' f.py"), ("4", "ls $X > $Y")]
    assert got(normalize.shell_writes(spark.createDataFrame(shell, "event_id string, command string")), "event_id", "file_path") == [("1", "out.txt"), ("2", "log.md"), ("3", "f.py")]


def test_trimming_is_idempotent_and_redaction_leaks_nothing(spark):
    held = json.dumps({"tool_name": "Bash", "tool_response": {"stdout": "s" * 9000, "stderr": "e" * 5000, "ok": True, "n": 3}, "tool_input": {"command": "secret", "new_string": "a\nb\n"}, "prompt": "secret", "model": "m"})
    df = spark.createDataFrame([("1", held, None), ("2", '{"a": 1}', 4), ("3", None, None)], "id string, payload string, lines_added long")
    once = normalize.trim_payloads(df)
    first = {r["id"]: r for r in once.collect()}
    assert first["2"]["payload"] == '{"a": 1}' and first["1"]["dropped_bytes"] > 10_000 and json.loads(first["1"]["payload"])["tool_response"] == {"stderr": "e" * 1984 + "[...truncated 3016 bytes]", "ok": True, "n": 3}
    assert got(normalize.trim_payloads(once).fillna("-"), "id", "payload") == got(once.fillna("-"), "id", "payload")
    bare = {r["id"]: r for r in normalize.redact_events(df).collect()}
    assert "secret" not in bare["1"]["payload"] and bare["1"]["lines_added"] == 2 and bare["2"]["lines_added"] == 4 and bare["3"]["payload"] is None


def test_columns(spark):
    texts = [("❯ hello ", "hello"), ("<command-name>x", None), ("  ", None), ("<environment_context>", None), ("Caveat: the messages below were generated by", None), ("<system-reminder>x", "<system-reminder>x")]
    assert [r[0] for r in spark.createDataFrame(texts, "t string, w string").select(columns.clean_prompt(F.col("t"))).collect()] == [w for _, w in texts]
    content = [('"a b"', "a b"), ('[{"type":"text","text":"x"},{"type":"image"},{"type":"text","text":"y"}]', "x\ny")]
    assert [r[0] for r in spark.createDataFrame(content, "t string, w string").select(columns.flatten_content(F.col("t"))).collect()] == [w for _, w in content]
    one = spark.range(1)
    assert one.select(columns.is_trivial(F.lit(" }{ ")), columns.is_trivial(F.lit("é"))).head() == (True, False)
    assert one.select(columns.line_hash(F.lit("a\r")) == columns.line_hash(F.lit("a")), columns.norm_hash(F.lit("a b")) == columns.norm_hash(F.lit("ab"))).head() == (True, True)
    assert one.select(columns.moves_content(F.lit("git stash pop")), columns.moves_content(F.lit("git status")), columns.commits(F.lit("x && git commit -m y"))).head() == (True, False, True)
    said = [("git log -- src/merge.py", False), ("git log --grep=commit", False), ("git -C a/b --no-pager checkout main", True), ("sudo /usr/bin/git -c k=v rebase x", True), ("digit merge", False), ("(git stash apply)", True), ("git stash list", False), ("\\git merge x", True), ('"$(which git)" pull', True), ("git; merge", False), ("git add apply && ls", False), ("git.exe -C d am", True), ("git\nrevert x", True), ("legit merge", False), ('"/opt/Git Tools/bin/git" pull', True)]
    assert [r[0] for r in spark.createDataFrame(said, "t string, w boolean").select(columns.moves_content(F.col("t"))).collect()] == [w for _, w in said]
    assert not one.select(columns.commits(F.lit("git log --grep=commit"))).head()[0]
    tools = {"exec": "shell", "NotebookEdit": "edit", "view_image": "read", "SubagentHandback": "agent", "collaboration_x": "agent", "webrun": "web", "mcp__a": "mcp", "x": "other"}
    assert {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in tools], "t string").select("t", columns.tool_family(F.col("t"))).collect()} == tools
    shapes = [("devin", "PostToolUse", '{"tool_name":"multiedit"}', "MultiEdit"), ("pi", "PostToolUse", '{"tool_name":"edit"}', None), ("cursor", "PostToolUse", '{"tool_name":"Edit"}', None), ("cursor", "afterFileEdit", '{"edits":[]}', "MultiEdit"), ("cursor", "afterFileEdit", '{"new_string":"x"}', "Edit"), ("cursor", "afterFileEdit", '{"content":"x"}', "Write"), ("cursor", "afterFileEdit", '{"content":1}', None), ("codex", "PostToolUse", '{"tool_name":"apply_patch"}', "apply_patch")]
    assert [r[0] for r in spark.createDataFrame(shapes, "a string, e string, p string, w string").select(columns.range_tool(F.col("a"), F.col("e"), F.col("p"))).collect()] == [w for *_, w in shapes]
    assert one.select(columns.repo_name(F.lit("git@h:o/name.git"), F.lit("/a/b")), columns.repo_name(F.lit(None).cast("string"), F.lit("/a/b"))).head() == ("name", "b")


def test_git_text(spark):
    diff = "--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n keep\n-+++ b/no\n++++ b/yes\n+two\n\\ No newline at end of file\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-bye"
    assert got(git.parse_unified_diff(spark.createDataFrame([("c", diff)], "commit_id string, diff string")), "file_path", "line_no", "text") == [("x", 2, "+++ b/yes"), ("x", 3, "two")]
    sha = "a" * 40
    porcelain = [f"{sha} 4 1 2", "author Ann", "\tone", f"{sha} 5 2", "\ttwo"]
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(porcelain)], "file_path string, n int, value string")
    assert got(git.parse_blame(lines), "final_line", "orig_line", "content", "author") == [(1, 4, "one", "Ann"), (2, 5, "two", "Ann")]
    assert got(git.parse_numstat(spark.createDataFrame([("c", "-\t-\tbin"), ("c", "3\t1\ta b")], "commit_id string, value string")), "file_path", "lines_added") == [("a b", 3), ("bin", 0)]


def test_derived_diffs_hold_every_added_line(tables, spark):
    long = tables.having(commit_files=spark.createDataFrame([("c1", "a.py", 150, 0), ("c1", "b.py", 0, 2)], tables.commit_files.schema))
    assert got(git.parse_unified_diff(derived.diffs(long)), "file_path", "line_no", "text") == [("a.py", i, f"line {i}") for i in range(1, 151)]


def test_transcripts(spark, tmp_path):
    usage = lambda i, o, m="m": json.dumps({"type": "assistant", "timestamp": "2026-01-01T00:00:01Z", "message": {"id": i, "model": m, "usage": {"input_tokens": 1, "output_tokens": o}}})
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps({"type": "user", "timestamp": "2026-01-01T00:00:00Z", "message": {"content": "hi"}}), usage("1", 5), usage("1", 9), "broken {", usage("2", 2, "n"), usage("3", 1), json.dumps({"type": "user", "isMeta": True, "message": {"content": "no"}})]))
    lines = envelopes.read_transcripts(spark, str(tmp_path))
    assert got(envelopes.message_usage(lines), "message_id", "output_tokens") == [("1", 5), ("2", 2), ("3", 1)]
    r = envelopes.transcript_summary(lines).head()
    assert (r["model"], r["output_tokens"], r["assistant_messages"]) == ("m", 12, 3)
    assert got(envelopes.transcript_prompts(lines), "seq", "prompt_text") == [(1, "hi")]


def test_version_diff_is_a_minimal_patch(spark):
    r = random.Random(1)
    texts = ["\n".join(r.choice("abcdef") for _ in range(r.randint(0, 12))) for _ in range(40)]
    pairs = changes.successive_versions(spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, version int, text string"))
    made = changes.version_diff(pairs).collect()
    for p in pairs.collect():
        a, b = changes._lines(p["before"]), changes._lines(p["after"])
        gone = {x["line"] for x in made if x["version"] == p["version"] and x["kind"] == "removed"}
        new = {x["line"] for x in made if x["version"] == p["version"] and x["kind"] == "added"}
        assert [x for i, x in enumerate(a, 1) if i not in gone] == [x for i, x in enumerate(b, 1) if i not in new]
    hunks = spark.createDataFrame([("e", 0, 5, [" k", "+a", "-b", "+c"])], "event_id string, hunk int, new_start long, lines array<string>")
    assert got(changes.hunk_changes(hunks), "kind", "line", "text") == [("added", 6, "a"), ("added", 7, "c"), ("removed", 7, "b")]


def test_rework_counts_only_own_lines(spark):
    rows = [("s", "f", 1, "1", "added", "mine", None), ("s", "f", 2, "2", "removed", "mine", 1), ("s", "f", 2, "2", "added", "new", None), ("s", "f", 3, "3", "removed", "other", 1), ("s", "f", 4, "4", "removed", "new", 3)]
    made = changes.rework(spark.createDataFrame(rows, "session_id string, file string, at int, event_id string, kind string, text string, copies int"))
    assert got(made, "event_id", "generated", "reworked") == [("1", 1, 0), ("2", 1, 1), ("3", 0, 0), ("4", 0, 0)]


def test_stream_equals_batch(spark, tables, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"agent": "pi", "cwd": "/", "received_at": f"2026-01-01T00:0{i % 10}:00Z", "payload": base64.b64encode(json.dumps({"session_id": f"s{i % 2}", "hook_event_name": "stop"}).encode()).decode()} for i in range(10)]
    (src / "1.json").write_text("\n".join(json.dumps(x) for x in rows) + "\nbroken\n")
    (src / "2.json").write_text("\n".join(json.dumps(x) for x in rows[:4]))  # a replay
    stream = envelopes.read_envelopes(spark, str(src), streaming=True)
    ingest.start_ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    events = spark.read.parquet(str(tmp_path / "out"))
    assert events.count() == 10
    files = spark.readStream.schema(events.schema).parquet(str(tmp_path / "out"))
    ingest.running_active(files).writeStream.format("memory").queryName("active").outputMode("update").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start().awaitTermination()
    last = {r["session_id"]: r["active_us"] / 6e7 for r in spark.table("active").groupBy("session_id").agg(F.max("active_us").alias("active_us")).collect()}
    assert last == {r["session_id"]: r["active_minutes"] for r in metrics.session_active(tables.having(events=events)).collect()}


def test_split_of_an_edit_tells_a_missing_key_from_null(spark):
    split = json.dumps([{"file_path": "a", "lines_generated": 5, "lines_reworked": 1}, {"repo_id": None, "file_path": "b", "lines_generated": 2, "lines_reworked": 9}, {"repo_id": "q", "rel_file_path": "c", "lines_generated": 1}])
    df = spark.createDataFrame([("1", "s", "r", split), ("2", "s", "r", split), ("3", "s", "r", None)], "id string, session_id string, repo_id string, file_lines string")
    assert got(edits.edit_file_lines(df).fillna("-"), "repo_id", "file_path", "edits", "lines") == [("-", "b", 2, 0), ("q", "c", 2, 2), ("r", "a", 2, 8)]


def test_rewrites(spark, tables):
    carried = spark.createDataFrame([("c2", "c1")], "commit_id string, carried_id string")
    assert got(attribution.home_repository(tables.commits, carried), "commit_id", "repo_id") == [("c2", "r")]
    assert attribution.attribution_sources(tables.commits, carried).count() == 2
    files = spark.createDataFrame([("c1", "A", "f", 5), ("c2", "A", "f", 5), ("c1", "B", "g", 2)], "commit_id string, session_id string, file_path string, lines_attributed int")
    swap = "old_id string, new_id string, on_branch boolean"
    assert got(attribution.retire_replaced(files, spark.createDataFrame([("c1", "c2", False)], swap)), "commit_id", "session_id", "lines_attributed") == [("c1", "A", 0), ("c1", "B", 2), ("c2", "A", 5)]
    assert got(attribution.retire_replaced(files, spark.createDataFrame([("c1", "c2", None)], swap)), "lines_attributed") == [(2,), (5,), (5,)]
    line = "commit_id string, file_path string, line int, session_id string, by_content boolean"
    merged = attribution.merge_attribution(spark.createDataFrame([("c", "f", 1, "new", False), ("c", "f", 2, "new", False)], line), spark.createDataFrame([("c", "f", 1, "old", True), ("c", "f", 2, "old", False)], line))
    assert got(merged, "line", "session_id") == [(1, "old"), (2, "new")]
    changed = spark.createDataFrame([("r", "a.py", at(501))], "repo_id string, file_path string, since timestamp")
    assert got(attribution.affected_commits(changed, tables), "commit_id") == [("c1",), ("c2",)]


def test_line_origins(spark):
    versions = {1: ["a", "b"], 2: ["x", "a", "b"], 3: ["a", "b", "y"], 4: ["a", "y", "b"]}
    df = spark.createDataFrame([("f", v, "\n".join(t)) for v, t in versions.items()], "file string, version long, text string")
    aligned = changes.version_alignment(changes.successive_versions(df)).withColumn("prior", F.col("version") - 1)
    lines = df.select("file", "version", F.posexplode(F.split("text", "\n")).alias("n", "t")).withColumn("line", F.col("n") + 1).selectExpr("file", "version", "cast(line as bigint) line")
    found = {(r["version"], versions[r["version"]][r["line"] - 1]): r["origin_version"] for r in changes.line_origins(aligned, lines).collect()}
    assert found[4, "a"] == 1 and found[3, "y"] == 3 and found[2, "x"] == 2 and found[3, "b"] == 1


def test_file_path_of_an_event(spark):
    patch = "*** Begin Patch\n*** Update File: p.py\n@@\n+x\n*** End Patch"
    made = [("1", {"tool_input": {"file_path": "a"}}, "a"), ("2", {"file_paths": ["", 5, "b", "c"], "file_path": "d", "tool_input": {"file_paths": ["x"]}}, "b"), ("3", {"tool_name": "apply_patch", "tool_input": {"command": patch}}, "p.py"), ("4", {"tool_name": "Bash", "tool_input": {"command": "echo x > out.txt"}}, "out.txt"), ("5", {"tool_name": "Read"}, None)]
    rows = spark.createDataFrame([(i, "codex", json.dumps(p), None) for i, p, _ in made], "id string, agent_slug string, payload string, file_path string")
    assert got(normalize.with_file_path(rows).fillna("-"), "id", "file_path") == [(i, w or "-") for i, _, w in made]


def test_redaction_keeps_allowed_shapes_only(spark):
    held = {"model": {"prompt": "secret"}, "effort": "high", "workspace_roots": ["/a", "/b"], "file_paths": ["x", {"y": "secret"}], "command": "secret", "tool_input": {"file_path": "f", "command": "secret", "edits": [{"new_string": "a\nb\n"}], "timeout": 5}, "edits": [{"new_string": "c\n"}]}
    rows = spark.createDataFrame([("1", json.dumps(held), None), ("2", "[1]", None), ("3", "{}", None)], "id string, payload string, lines_added long")
    out = {r["id"]: r for r in normalize.redact_events(rows).collect()}
    assert json.loads(out["1"]["payload"]) == {"effort": "high", "workspace_roots": ["/a", "/b"], "tool_input": {"file_path": "f", "timeout": 5}, "redacted": True} and out["1"]["lines_added"] == 3
    assert json.loads(out["2"]["payload"]) == {"redacted": True, "raw_dropped": True} and json.loads(out["3"]["payload"]) == {"redacted": True}


def test_edits_are_located_once_each(spark):
    e = lambda *news: [("old", n) for n in news]
    rows = [("1", "a\nb\nx\nb\n", e("b\n", "b\n", "zz\n", "")), ("2", "p\r\nq\r\n", e("p\nq\n")), ("3", None, e("x")), ("4", "xaaay", e("aa", "aa"))]
    made = locate.locate_edits(spark.createDataFrame(rows, "event_id string, text string, edits array<struct<old_string:string,new_string:string>>"))
    assert [tuple(r) for r in made.orderBy("event_id", "edit").collect()] == [("1", 0, 2, 2, 1), ("1", 1, 4, 4, 1), ("1", 2, None, None, 1), ("1", 3, None, None, 0), ("2", 0, 1, 2, 2), ("3", 0, None, None, 1), ("4", 0, 1, 1, 1), ("4", 1, None, None, 1)]


def test_writes_against_their_bases(spark):
    rows = [("1", "a\nb\nc\n", "a\nb\n", "z\n", "x\nb\nc\n"), ("2", "a\nb\n", None, None, "q\n"), ("3", "a\n", "x\n", "a\n", None), ("4", "", None, None, "")]
    writes = spark.createDataFrame(rows, "event_id string, text string, snapshot string, head string, later string")
    assert got(locate.nearest_base(writes), "event_id", "base", "added") == [("1", "snapshot", 1), ("2", "none", 2), ("3", "head", 0), ("4", "none", 0)]
    assert got(locate.snapshot_placement(writes), "event_id", "line", "later_line") == [("1", 2, 2), ("1", 3, 3)]
    marks = spark.createDataFrame([(["a", "b", "c", "d"], "e"), (["a"], "a"), (None, "x")], "m array<string>, c string")
    assert [r[0] for r in marks.select(locate.counted_in(F.col("m"), F.col("c"))).collect()] == [["b", "c", "d", "e"], ["a"], ["x"]]
    state = spark.createDataFrame([(1, at(0), 5), (2, at(0) - dt.timedelta(days=31), 5), (3, at(0), 2 << 20)], "id long, updated_at timestamp, size_bytes long")
    assert got(locate.expire(state, at(0)), "id") == [(1,)]


def test_backfills(spark, tables):
    prompt = "session_id string, seq long, ts timestamp, agent_slug string, prompt_text string"
    stored, script = spark.createDataFrame([("A", 2, at(1), "x", "one")], prompt), spark.createDataFrame([("A", 1, at(1), "x", "other"), ("B", 1, at(2), "x", "two")], prompt)
    hooks = spark.createDataFrame([("B", None, at(3), "x", "no"), ("C", None, at(5), "x", "later"), ("C", None, at(4), "x", "first")], prompt)
    assert got(backfill.fill_prompts(stored, script, hooks), "session_id", "seq", "prompt_text") == [("A", 2, "one"), ("B", 1, "two"), ("C", 1, "first"), ("C", 2, "later")]
    fresh = spark.createDataFrame([("A", 2, at(9), "x", "again"), ("A", None, at(9), "x", "new"), ("D", None, at(9), "x", "d")], prompt)
    assert got(backfill.upsert_prompts(stored, fresh), "session_id", "seq", "prompt_text") == [("A", 2, "one"), ("A", 3, "new"), ("D", 1, "d")]
    summaries = spark.createDataFrame([("B", "m9", 1, 2, 3, 4), ("A", "no", 9, 9, 9, 9)], "session_id string, model_slug string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long")
    assert got(backfill.fill_sessions(tables.sessions, summaries).where("id in ('A', 'B')"), "id", "model_slug", "output_tokens") == [("A", "m", 10), ("B", "m9", 2)]
    bare = tables.having(ranges=tables.ranges.withColumn("rel_file_path", F.when(F.col("id") == "g2", F.col("rel_file_path"))))
    assert got(backfill.fill_rel_paths(bare.ranges, tables.events), "id", "rel_file_path") == [("g1", "a.py"), ("g2", "b.py")]
    found = spark.createDataFrame([("e1", 0, 1, 2), ("e9", 0, 4, 6), ("e9", 1, None, None)], "event_id string, edit int, start_line int, end_line int")
    assert got(backfill.fill_ranges(tables, found), "event_id", "start_line") == [("e1", 3), ("e3", 5), ("e9", 4)]
    once = backfill.repair(tables, summaries)
    twice = backfill.repair(once, summaries)
    for name in ("sessions", "events", "ranges"):
        assert sorted(map(str, getattr(once, name).collect())) == sorted(map(str, getattr(twice, name).collect()))


def test_credit_by_file_and_lead_time(spark, tables):
    assert got(sessions.file_rows(tables), "file_path", "generated", "committed") == [("a.py", 3, 3), ("b.py", 2, 0), ("c.py", 4, 0), ("d.py", 9, 0)]
    rows = spark.createDataFrame([("c1", "A", at(0), 4), ("c1", "B", at(-90_000), 1), ("c2", "A", at(1500), 2), ("c2", "C", at(0), 0)], "commit_id string, session_id string, last_event_ts timestamp, lines_attributed long")
    credited = tables.having(commit_sessions=rows)
    assert tuple(metrics.lead_time(credited).head()) == (3, 2, 1)
    by = lambda **f: metrics.lead_time(credited, filters.Filters(**f)).head()["total"]
    assert [by(agents=("cursor",)), by(models=("unknown",)), by(engineers=("x@y",)), by(repos=("q",)), by(start=at(1500).date())] == [1, 1, 2, 0, 3]
    stats = {r["session_id"]: r for r in sessions.session_stats(tables).collect()}
    assert stats["B"]["wall_minutes"] is None and stats["A"]["commits"] == 1 and stats["A"]["committed"] == 4 and stats["A"]["files"] == 2
    assert sessions.session_count(tables).head()["n"] == 3
    now, before = (spark.createDataFrame([v], "active_minutes double, edits long") for v in ((10.1, 5), (10.0, 0)))
    assert got(metrics.with_delta(now, before).fillna("-"), "metric", "trend") == [("active_minutes", "flat"), ("edits", "-")]


def test_recorded_lines_and_ancestors_of_rewrites(spark, tables):
    owned = spark.createDataFrame([("c1", "a.py", 1, "A", "e1", at(0)), ("c1", "a.py", 2, "C", "e7", at(0))], "commit_id string, file_path string, line long, session_id string, event_id string, ts timestamp")
    texts = spark.createDataFrame([("c1", "a.py", 1, "x = 1"), ("c1", "a.py", 2, "y")], "commit_id string, file_path string, line long, text string")
    files = spark.createDataFrame([("c1", "C", "a.py", 0)], "commit_id string, session_id string, file_path string, lines_attributed long")
    kept = attribution.recorded_lines(owned, texts, tables.having(extra={"commit_session_files": files}))
    assert got(kept, "line", "session_id", "model_slug") == [(1, "A", "m")] and attribution.recorded_lines(owned, texts, tables).count() == 2
    lines = spark.createDataFrame([("c1", "a.py", "one"), ("c2", "a.py", "one")], "commit_id string, file_path string, text string")
    groups, above = attribution.checkout_groups(tables.repositories), spark.createDataFrame([("c2", "c1")], "id string, ancestor string")
    assert attribution.carried_overlap(lines, tables.commits, groups).count() == 1 and attribution.carried_overlap(lines, tables.commits, groups, above).count() == 0
    assert got(groups, "repo_id", "group_id") == [("q", "q"), ("r", "r")]


def test_turns_begin_and_end_as_sessions_do(spark, tables):
    tool = lambda i, s, t, name, kind="PostToolUse": event(i, s, t, kind, tool=name)
    rows = [
        tool("a1", "A", -9, "Read"), event("a2", "A", 100, "Stop"), tool("a3", "A", 150, None), tool("a4", "A", 160, "Bash"), event("a5", "A", 200, "Stop"), event("a6", "A", 200, "Stop"), tool("a7", "A", 900, "Bash"), tool("a8", "A", 5000, "Bash"),
        event("b1", "B", 50, "Stop"),
    ]
    asks = [("A", 2, at(120), "g", "later in time"), ("A", 1, at(130), "g", "This session is being continued from a previous conversation"), ("A", 3, at(170), "g", "first"), ("A", 4, at(140), "g", "second")]
    T = tables.having(
        events=spark.createDataFrame(rows, EVENT), prompts=spark.createDataFrame(asks, tables.prompts.schema),
        ranges=spark.createDataFrame([("g1", "a4", None, "/w/r/a.py", 1, 2)], tables.ranges.schema),
    )
    us = lambda s: None if s is None else int((at(s) - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    turns = got(sessions.build_turns(T).fillna(-1, ["ended_us"]), "session_id", "turn", "started_us", "ended_us", "prompts", "tools", "shell", "edit", "open")
    assert turns == [
        ("A", 0, us(0), us(100), 0, 1, 0, 0, False),  # no prompt: from the session's start
        ("A", 1, us(120), us(200), 4, 2, 0, 1, False),  # the first user prompt by its number; a call with ranges is an edit, one without a name counts
        ("A", 2, us(200), us(200), 0, 0, 0, 0, False),  # a second Stop at once
        ("A", 3, us(200), us(1000), 0, 1, 1, 0, True),  # up to the session's end
        ("B", 0, us(0), us(50), 0, 0, 0, 0, False),
        ("C", 0, us(10), -1, 0, 0, 0, 0, True) if tables.sessions.where("id = 'C'").head()["ended_at"] is None else ("C", 0, us(0), us(10), 0, 0, 0, 0, True),
    ]
    landed = tables.having(commit_sessions=spark.createDataFrame([("c1", "A", "claude-code", "m", 1, 4)], tables.commit_sessions.schema), events=T.events, prompts=T.prompts, ranges=T.ranges)
    assert got(sessions.commit_turns(landed), "commit_id", "turn") == [("c1", 3)]
    start = landed.having(commits=tables.commits.withColumn("committed_at", F.lit(at(0))))
    assert [r["turn"] for r in sessions.commit_turns(start).collect()] == [None]


def test_files_of_edits_by_split_ranges_or_event(spark, tables):
    split = json.dumps([{"file_path": "/w/r/x", "rel_file_path": "x", "lines_generated": 5, "lines_reworked": 1}, {"repo_id": None, "file_path": "/tmp/y", "lines_generated": 2, "lines_reworked": 9}])
    rows = [
        (*event("s", "A", 0, tool="Edit", file="z.py", generated=7), split), (*event("two", "A", 5, tool="apply_patch", file="m.py", added=9), None), (*event("measured", "A", 9, tool="apply_patch", file="m.py", generated=4), "not json"),
        (*event("shell", "A", 12, tool="Bash", generated=3), None), (*event("none", "A", 15, tool="Edit", text="a\n"), None),
    ]
    spans = [("g1", "two", "m.py", "/w/r/m.py", 1, 3), ("g2", "two", "n.py", "/w/r/n.py", 4, 4), ("g3", "two", None, "/tmp/o", 1, 2), ("g4", "measured", "m.py", "/w/r/m.py", 1, 1), ("g5", "measured", "n.py", "/w/r/n.py", 1, 1), ("g6", "shell", None, "/tmp/o", 1, 3)]
    T = tables.having(events=spark.createDataFrame(rows, EVENT + ", file_lines string"), ranges=spark.createDataFrame(spans, tables.ranges.schema))
    made = sorted((r["id"], r["file_path"], r["repo_id"] or "-", r["lines"]) for r in sessions.edit_files(T).collect())
    assert made == [("measured", "m.py", "r", 4), ("s", "/tmp/y", "-", -7), ("s", "x", "r", 4), ("shell", "/tmp/o", "-", 3), ("two", "/tmp/o", "-", 2), ("two", "m.py", "r", 3), ("two", "n.py", "r", 1)]
    credited = spark.createDataFrame([("c1", "A", "m.py", 9), ("c1", "A", "gone.py", 0)], "commit_id string, session_id string, file_path string, lines_attributed long")
    found = got(sessions.file_rows(T, credited).fillna("-", ["repo_id"]), "repo_id", "file_path", "generated", "committed", "edits")
    assert found == [("-", "/tmp/o", 5, 0, 2), ("-", "/tmp/y", 0, 0, 1), ("r", "gone.py", 0, 0, 0), ("r", "m.py", 9, 9, 2), ("r", "n.py", 1, 0, 1), ("r", "x", 4, 0, 1)]


def test_calls_without_a_name_or_a_session_are_calls(spark, tables):
    rows = [event("1", "A", 0, tool="Bash"), event("2", None, 1, tool="Read"), event("3", "A", 2), event("4", "B", 3, agent="cursor", tool="Bash"), event("5", "A", 4, "hook_misfire")]
    T = tables.having(events=spark.createDataFrame(rows, EVENT))
    assert got(metrics.tool_mix(T), "agent_slug", "family", "calls") == [("claude-code", "other", 1), ("claude-code", "read", 1), ("claude-code", "shell", 1), ("cursor", "shell", 1)]
    assert got(metrics.tool_calls_of(T, filters.Filters(engineers=("x@y",))), "id") == [("1",), ("3",)]
    assert got(metrics.tool_calls_of(T, filters.Filters(models=("unknown",))), "id") == [("2",), ("4",)]


def test_trimming_cuts_long_strings_at_any_depth_and_counts_on():
    text = "é" * 200_000
    once = json.loads(normalize.trimmed(json.dumps({"a": [{"b": text}], "toolResult": [1], "tool_response": None, "n": 1.5})))
    cut = once["a"][0]["b"]
    assert cut.startswith("é" * 1000) and len(cut.encode()) <= normalize.STRING_BYTES and once["toolResult"] is None and once["n"] == 1.5
    again = json.dumps(once, ensure_ascii=False, separators=(",", ":"))
    assert normalize.trimmed(again) == again
    first = once[normalize.TRIM_KEY]["dropped_bytes"]
    more = json.loads(normalize.trimmed(json.dumps(once | {"tool_output": "x" * 100})))
    assert more[normalize.TRIM_KEY]["dropped_bytes"] == first + 98
    assert normalize.trimmed("x" * 300_000) == "x" * normalize.STRING_BYTES and normalize.trimmed('{"a": ') == '{"a": ' and normalize.trimmed("[1]") == "[1]"


def test_copilot_payloads_are_known_by_path_or_keys(spark):
    made = [
        ({"transcript_path": "C:\\x\\GitHub.Copilot-Chat\\t"}, True), ({"transcriptPath": "/a/session-state/i/events.jsonl"}, True), ({"transcript_path": "/a/session-state/i/other"}, False), ({"transcript_path": "/a/.copilot/t"}, False),
        ({"toolArgs": None}, True), ({"tool_result": {"text_result_for_llm": None}}, True), ({"tool_result": "text_result_for_llm"}, False), ({}, False),
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, (p, _) in enumerate(made)], "i int, p string")
    assert [r[0] for r in df.orderBy("i").select(normalize.from_copilot(F.col("p"))).collect()] == [w for _, w in made]


def test_notes_of_both_versions(spark):
    runs = [("c1", "a", 10, 12, "codex", "s", "m", "t1", True), ("c1", "a", 9, 9, "pi", "s2", None, "t2", True), ("c1", "b", 1, 1, "pi", "s2", None, None, True), ("c2", "a", 1, 2, "pi", "s", "m", "t", False), ("c2", "b", 1, 2, "pi", "s", "m", "t", True)]
    made = spark.createDataFrame(runs, "commit_id string, file_path string, start_line long, end_line long, agent string, session string, model string, ts string, exact boolean")
    notes = git.build_notes(made)
    first = json.loads(notes.where("commit_id = 'c1'").head()["note"])
    assert first == {"v": 2, "commit": "c1", "files": {"a": [{"lines": "9", "agent": "pi", "session": "s2", "ts": "t2"}, {"lines": "10-12", "agent": "codex", "session": "s", "model": "m", "ts": "t1"}], "b": [{"lines": "1", "agent": "pi", "session": "s2"}]}}
    odd = spark.createDataFrame([("x", "no"), ("y", '{"v":1,"commit":"y","files":{"f":[{"lines":"4-"},{"lines":"7"}]}}')], "commit_id string, note string")
    back = git.read_notes(notes.unionByName(odd))
    assert sorted((r["commit_id"], r["v"], r["file_path"], r["start_line"], r["end_line"]) for r in back.collect()) == [("c1", 2, "a", 9, 9), ("c1", 2, "a", 10, 12), ("c1", 2, "b", 1, 1), ("c2", 1, "a", 1, 2), ("c2", 1, "b", 1, 2), ("y", 1, "f", 7, 7)]
