"""Blame by record, range, note and map: what settles a line, and what overrides it."""

from fleetlens.operators import blame

WHO = "event_id string, session_id string, agent_slug string, model_slug string, ts string"


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_each_source_has_its_place(spark):
    by = lambda e, ts="1": (e, f"s-{e}", "codex", "m", ts)
    lines = [
        ("r", "f", 1, 11, "recorded"), ("r", "f", 2, 12, "recorded"), ("r", "f", 3, 11, "nothing"), ("r", "f", 4, 11, "ranged"), ("r", "f", 5, 15, "ranged"), ("r", "f", 6, 11, "noted"), ("r", "f", 7, 19, "noted"),
        ("r", "f", 8, 8, None), ("r", "f", 9, 9, None), ("r", "g", 1, 1, None), ("r", "f", 10, 11, "counted"), ("r", "f", 11, 12, "counted"), ("r", "f", 12, 11, "unknown"), ("q", "f", 1, 11, "ranged"),
    ]
    ranged = [
        ("r", "f", "recorded", 11, 12, *by("no")), ("r", "f", "nothing", 11, 12, *by("no")), ("r", "f", "ranged", 10, 12, *by("old", "1")), ("r", "f", "ranged", 11, 11, *by("new", "2")), ("r", "f", None, 1, 9, *by("no")),
        ("r", "g", None, 1, 1, *by("loose")), ("r", "f", "counted", 11, 12, *by("range")), ("r", "f", "ranged", 20, 20, *by("far", "3")),
    ]
    recorded = [("recorded", "f", 11, "s-rec", "pi", None, "1")]
    notes = [("noted", 2, "f", 10, 12, None, "s-note", None, "1"), ("noted", 1, "f", 11, 11, "pi", "s-later", "m", "2"), ("ranged", 2, "f", 15, 15, "pi", "no", None, "1"), ("nothing", 2, "f", 11, 11, "pi", "no", None, "1")]
    mapped = [("r", "f", 8, *by("mine"), []), ("r", "f", 9, None, None, None, None, None, []), ("r", "f", 10, *by("edit"), ["counted"]), ("r", "f", 11, *by("edit"), ["other"]), ("r", "f", 4, *by("no"), [])]
    got = blame.credit(
        table(spark, lines, "repo_id string, file_path string, final_line long, orig_line long, commit_id string"), table(spark, ranged, f"repo_id string, file_path string, commit_id string, start_line long, end_line long, {WHO}"),
        table(spark, recorded, "commit_id string, file_path string, line long, session_id string, agent_slug string, model_slug string, ts string"), table(spark, [("nothing", "f")], "commit_id string, file_path string"),
        table(spark, notes, "commit_id string, v int, file_path string, start_line long, end_line long, agent string, session string, model string, ts string"), table(spark, mapped, f"repo_id string, file_path string, line long, {WHO}, counted_in array<string>"),
    )
    rows = {(r["repo_id"], r["file_path"], r["final_line"]): (r["source"], r["session_id"]) for r in got.collect()}
    assert len(rows) == len(lines) and rows == {
        ("r", "f", 1): ("record", "s-rec"), ("r", "f", 2): (None, None), ("r", "f", 3): (None, None), ("r", "f", 4): ("range", "s-new"), ("r", "f", 5): (None, None), ("r", "f", 6): ("note", "s-later"), ("r", "f", 7): (None, None),
        ("r", "f", 8): ("map", "s-mine"), ("r", "f", 9): (None, None), ("r", "g", 1): ("range", "s-loose"), ("r", "f", 10): ("map", "s-edit"), ("r", "f", 11): ("range", "s-range"), ("r", "f", 12): (None, None), ("q", "f", 1): (None, None),
    }
