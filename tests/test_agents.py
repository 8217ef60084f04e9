import base64
import json
import time

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import agents, normalize
from fleetlens.sources import envelopes
from fleetlens.streaming import ingest

COPILOT = [
    ({"toolName": "create", "toolArgs": '{"path": "a.py", "file_text": "x\\n"}', "toolResult": {"r": 1}, "sessionId": "s"}, ("PostToolUse", "Write", "create", {"file_path": "a.py", "content": "x\n"})),
    ({"hook_event_name": "PostToolUse", "tool_name": "apply_patch", "tool_input": "*** Begin Patch\n*** End Patch"}, ("PostToolUse", "apply_patch", None, {"command": "*** Begin Patch\n*** End Patch"})),
    ({"tool_name": "edit", "tool_input": {"path": "a", "old_str": "", "new_str": "y"}}, ("PreToolUse", "Edit", "edit", {"file_path": "a", "old_string": "", "new_string": "y"})),
    ({"tool_name": "run_in_terminal", "tool_input": {"command": "ls", "n": 1}}, ("PreToolUse", "Bash", "run_in_terminal", {"command": "ls", "n": 1})),
    ({"tool_name": "m", "tool_input": {"replacements": [{"filePath": "a", "oldString": "1", "newString": "2"}, 5, {"filePath": "a", "oldString": "3"}]}}, ("PreToolUse", "MultiEdit", "m", {"file_path": "a", "edits": [{"old_string": "1", "new_string": "2"}, {"old_string": "3", "new_string": ""}]})),
    ({"tool_name": "m", "tool_input": {"replacements": [{"filePath": "a", "oldString": "1\n2\n", "newString": "3"}, {"filePath": "b", "newString": "\n"}]}}, ("PreToolUse", "apply_patch", "m", {"command": "*** Begin Patch\n*** Update File: a\n@@\n-1\n-2\n+3\n*** Update File: b\n@@\n+\n*** End Patch\n"})),
    ({"tool_name": "list_dir", "tool_input": {"path": "/w"}}, ("PreToolUse", "list_dir", None, {"path": "/w"})),
    ({"tool_name": "view", "tool_input": {"filePath": "q", "n": [1]}}, ("PreToolUse", "view", None, {"filePath": "q", "n": [1], "file_path": "q"})),
    ({"prompt": "hi"}, ("UserPromptSubmit", None, None, None)),
    ({"stopReason": "end", "tool_input": None}, ("Stop", None, None, None)),
]
PATCH = "--- a\n+++ a\n@@ -1,2 +1,3 @@\n x\n-y\n+z\n+w\n@@ -9 +10 @@ f\n-q\n"
PI = [
    ({"tool_name": "edit", "tool_input": {"path": "@a", "edits": [{"oldText": "1", "newText": "2"}]}, "tool_response": {"patch": PATCH, "k": 1}}, "Edit", {"file_path": "a", "old_string": "1", "new_string": "2"}, {"k": 1, "structuredPatch": [{"oldStart": 1, "newStart": 1, "lines": [" x", "-y", "+z", "+w"]}, {"oldStart": 9, "newStart": 10, "lines": ["-q"]}]}),
    ({"tool_name": "edit", "tool_input": {"path": "~/a", "edits": [{"oldText": "1", "newText": "2"}, {"oldText": 5}], "oldText": "", "newText": "n"}, "tool_response": {"patch": PATCH + "junk"}}, "MultiEdit", {"file_path": "/home/u/a", "edits": [{"old_string": "1", "new_string": "2"}, {"old_string": "", "new_string": "n"}]}, {}),
    ({"tool_name": "read", "tool_input": {"path": "a", "limit": 3, "x": 1}}, "Read", {"file_path": "a", "limit": 3}, None),
    ({"tool_name": "write", "tool_input": {"path": " "}}, "write", {"path": " "}, None),
    ({"tool_name": "bash", "tool_input": {"command": "ls"}}, "Bash", {"command": "ls"}, None),
]
SCHEMA = "n int, agent_slug string, cwd string, payload string"


def normalized(spark, rows):
    return {r["n"]: r["payload"] for r in agents.normalize_payloads(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_copilot_tools_are_told_by_their_arguments(spark):
    got = normalized(spark, [(n, "github-copilot", "/w", json.dumps(p)) for n, (p, _) in enumerate(COPILOT)])
    for n, (_, want) in enumerate(COPILOT):
        p = json.loads(got[n])
        assert (p.get("hook_event_name"), p.get("tool_name"), p.get("copilot_tool_name"), p.get("tool_input")) == want, n


def test_pi_tools_and_patches(spark):
    got = normalized(spark, [(n, "pi", "/home/u/r", json.dumps(p)) for n, (p, *_) in enumerate(PI)])
    for n, (sent, tool, args, response) in enumerate(PI):
        p = json.loads(got[n])
        assert (p["tool_name"], p["tool_input"], p.get("tool_response")) == (tool, args, response), n
        assert p.get("pi_tool_name") == (None if tool == sent["tool_name"] else sent["tool_name"])


@pytest.mark.parametrize("agent", ["github-copilot", "pi", "codex", None])
def test_other_payloads_stay(spark, agent):
    rows = [(0, agent, None, None), (1, agent, None, ""), (2, agent, None, "not json"), (3, agent, None, "[1]"), (4, agent, None, "{}")]
    assert normalized(spark, rows) == {n: p for n, _, _, p in rows}
    assert normalized(spark, [(5, "codex", None, '{"toolName": "edit"}')]) == {5: '{"toolName": "edit"}'}


def test_ingest_lands_events_in_canonical_form(spark, tmp_path):
    """Events of agents with other tool names and shapes are named by their canonical form, in batch and stream alike; what another agent's hook delivers again is dropped."""
    sent = [
        ("github-copilot", {"sessionId": "c", "toolName": "create", "toolArgs": json.dumps({"path": "/w/a.py", "file_text": "x\ny\n"}), "toolResult": "done", "timestamp": 1}),
        ("claude-code", {"session_id": "x", "toolArgs": "{}", "hook_event_name": "PostToolUse"}),
        ("pi", {"session_id": "p", "hook_event_name": "PostToolUse", "tool_name": "edit", "tool_input": {"path": "/w/b.py", "oldText": "a", "newText": "b"}}),
        ("codex", {"session_id": "k", "hook_event_name": "stop"}),
        ("pi", "  "),
    ]
    text = [p if isinstance(p, str) else json.dumps(p) for _, p in sent]
    rows = [(a, "/w", f"2026-01-01T00:00:0{i}Z", base64.b64encode(t.encode()).decode()) for i, ((a, _), t) in enumerate(zip(sent, text))]
    made = spark.createDataFrame(rows, envelopes.ENVELOPE)
    ingest.land(normalize.decode_envelopes(made), str(tmp_path / "staged"), str(tmp_path / "batch"))
    j = lambda path: F.get_json_object("payload", path)
    seen = lambda where: sorted(tuple(r) for r in spark.read.parquet(where).select("agent_slug", F.coalesce("session_id", F.lit("-")), "event_type", F.coalesce(j("$.tool_name"), F.lit("-")), F.coalesce(j("$.tool_input.file_path"), F.lit("-")), F.coalesce(j("$.tool_input.new_string"), j("$.tool_input.content"), F.lit("-"))).collect())
    expected = [("codex", "k", "stop", "-", "-", "-"), ("github-copilot", "c", "PostToolUse", "Write", "/w/a.py", "x\ny\n"), ("pi", "-", "hook_misfire", "-", "-", "-"), ("pi", "p", "PostToolUse", "Edit", "/w/b.py", "b")]
    assert seen(str(tmp_path / "batch")) == expected
    made.write.json(str(tmp_path / "in"))
    ingest.start_ingest(envelopes.read_envelopes(spark, str(tmp_path / "in"), streaming=True), str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    assert seen(str(tmp_path / "out")) == expected
    # A filter on a payload that has been landed plans at once.
    began = time.time()
    spark.read.parquet(str(tmp_path / "out")).where(j("$.tool_name") == "Edit").count()
    assert time.time() - began < 20
