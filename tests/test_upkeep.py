import datetime as dt
import json

from fleetlens.operators import attribution, edits
from fleetlens.sources import envelopes
from fleetlens.sources.fixtures import Tables
from fleetlens.streaming import upkeep

T0 = dt.datetime(2026, 3, 1)
EVENT = "id string, session_id string, ts timestamp, event_type string, agent_slug string, repo_id string, file_path string, rel_file_path string, payload string"


def event(i, session, seconds, kind="PostToolUse", agent="cursor", file="a", payload=None):
    return (i, session, T0 + dt.timedelta(seconds=seconds), kind, agent, "r", file and f"/w/r/{file}", file, payload)


def stream(spark, folder):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(folder))


def add(spark, folder, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(folder))


def test_stream_drops_what_the_batch_drops(spark, tmp_path):
    rows = [event("1", "A", 10, "afterFileEdit"), event("2", "A", 15), event("3", "A", 16), event("4", None, 10), event("5", None, 12, "afterFileEdit"), event("6", "A", 10, file="b"), event("7", "A", 10, agent="codex"), event("8", "A", 5), event("9", "B", 10), event("n", "A", 11, file=None), event("k", "A", 11, kind=None)]
    add(spark, tmp_path / "in", rows)
    add(spark, tmp_path / "in", [event("z", "Z", 50_000, "Stop", file=None)])
    add(spark, tmp_path / "in", [event("y", "Z", 50_001, "Stop", file=None)])
    upkeep.drop_duplicates(stream(spark, tmp_path / "in"), "10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    want = {r["id"] for r in edits.drop_duplicates(spark.read.parquet(str(tmp_path / "in"))).collect()}
    got = [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) == want == {"1", "3", "5", "6", "7", "9", "n", "k", "y", "z"}


def test_stop_updates_sessions(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    say = lambda text: json.dumps({"type": "user", "timestamp": "2026-03-01T00:00:00Z", "message": {"content": text}})
    answer = lambda i, o: json.dumps({"type": "assistant", "timestamp": "2026-03-01T00:01:00Z", "message": {"id": i, "model": "m", "usage": {"input_tokens": 1, "output_tokens": o}}})
    (folder / "a.jsonl").write_text("\n".join([say("hi"), answer("1", 5)]))
    (folder / "b.jsonl").write_text(answer("1", 70))
    stop = lambda i, s: event(i, s, s == "B", "Stop", "pi", None, json.dumps({"transcript_path": f"{folder}/{s.lower()}.jsonl"}))
    run = lambda: upkeep.start_session_updates(stream(spark, tmp_path / "in"), lambda: envelopes.read_transcripts(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    add(spark, tmp_path / "in", [stop("1", "A"), event("2", "B", 0, "Stop"), event("3", None, 0, "Stop")])
    run()
    (folder / "a.jsonl").write_text("\n".join([say("hi"), answer("1", 5), say("more"), answer("2", 6)]))
    add(spark, tmp_path / "in", [stop("4", "A")])
    run()
    assert [(r["session_id"], r["model"], r["output_tokens"]) for r in upkeep.session_updates(spark, str(tmp_path / "out")).collect()] == [("A", "m", 11)]
    assert sorted((r["session_id"], r["seq"], r["prompt_text"]) for r in upkeep.session_prompts(spark, str(tmp_path / "out")).collect()) == [("A", 1, "hi"), ("A", 2, "more")]


def test_late_edits_attribute_commits_again(spark, tmp_path):
    empty = spark.createDataFrame([], "x int")
    commits = spark.createDataFrame([("c1", "r", T0 + dt.timedelta(seconds=100)), ("c2", "r", T0 + dt.timedelta(seconds=200))], "id string, repo_id string, committed_at timestamp")
    files = spark.createDataFrame([("c1", "a", 4), ("c1", "b", 2), ("c2", "a", 3)], "commit_id string, file_path string, lines_added long")
    spans = spark.createDataFrame([("1", "a", 1, 2), ("2", "b", 1, 2), ("3", "a", 2, 4), ("4", "a", 1, 1)], "event_id string, rel_file_path string, start_line long, end_line long")

    def tables():
        made = {n: empty for n in Tables.__dataclass_fields__} | {"events": spark.read.parquet(str(tmp_path / "in")), "ranges": spans, "commits": commits, "commit_files": files}
        return Tables(**made)

    run = lambda: upkeep.start_reattribution(stream(spark, tmp_path / "in"), tables, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    read = lambda df: sorted((r["commit_id"], r["session_id"], r["file_path"], r["event_count"], r["lines_attributed"]) for r in df.collect())
    add(spark, tmp_path / "in", [event("1", "A", 10), event("2", "A", 20, file="b")])
    run()
    assert read(upkeep.attributed_files(spark, str(tmp_path / "out"))) == read(attribution.attribute_files(tables())) == [("c1", "A", "a", 1, 2), ("c1", "A", "b", 1, 2)]
    add(spark, tmp_path / "in", [event("3", "B", 30), event("4", "B", 150)])
    run()
    assert read(upkeep.attributed_files(spark, str(tmp_path / "out"))) == read(attribution.attribute_files(tables())) == [("c1", "A", "a", 1, 1), ("c1", "A", "b", 1, 2), ("c1", "B", "a", 1, 3), ("c2", "B", "a", 1, 1)]
