"""Blame: which session wrote each line that a file has now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.fixtures import Tables
from .attribution import commit_of_edit, owned as owned_of


def latest_lines(T: Tables, lines: DataFrame | None = None) -> DataFrame:
    """(repo_id, file_path, line, commit_id): stands in for git blame, the newest commit that added each line; same time: the largest id."""
    of = T.commits.select(F.col("id").alias("commit_id"), "repo_id", "committed_at")
    newest = F.max(F.struct("committed_at", "commit_id")).alias("c")
    if lines is None:
        # Of commits that add as many lines (1 to n) to a file only the newest can hold one; no other is spread to lines.
        longest = T.commit_files.where("lines_added > 0").join(of, "commit_id").groupBy("repo_id", "file_path", "lines_added").agg(newest)
        dated = longest.select("repo_id", "file_path", "c.*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("lines_added").cast("bigint"))).alias("line"))
    else:
        dated = lines.join(of, "commit_id")
    return dated.groupBy("repo_id", "file_path", "line").agg(newest).select("repo_id", "file_path", "line", "c.commit_id")


def blame(T: Tables, blame_lines: DataFrame, owned: DataFrame | None = None) -> DataFrame:
    """blame_lines (repo_id, file_path, line, commit_id) + session_id, event_id, ts of the edit that wrote the line; null if no agent did.

    Ranges are spread to lines first, so this is an equi-join on commit, file and line.
    """
    own = owned_of(T) if owned is None else owned
    return blame_lines.join(own, ["commit_id", "file_path", "line"], "left").select("repo_id", "file_path", "line", "commit_id", "session_id", "event_id", "ts")


def blame_summary(rows: DataFrame) -> DataFrame:
    """(repo_id, file_path, total, ai_lines, ai_percent, sessions) per file."""
    sums = rows.groupBy("repo_id", "file_path").agg(F.count(F.lit(1)).alias("total"), F.count("session_id").alias("ai_lines"), F.countDistinct("session_id").alias("sessions"))
    return sums.withColumn("ai_percent", F.col("ai_lines") * 100.0 / F.col("total"))


def blame_sessions(rows: DataFrame) -> DataFrame:
    """(repo_id, file_path, session_id, lines, first_line) of the sessions that wrote lines, in order of appearance."""
    return rows.where("session_id is not null").groupBy("repo_id", "file_path", "session_id").agg(F.count(F.lit(1)).alias("lines"), F.min("line").alias("first_line"))


_WHO = ["event_id", "session_id", "agent_slug", "model_slug", "ts"]
_KEY = ["repo_id", "file_path", "commit_id"]


def ranged_edits(T: Tables) -> DataFrame:
    """(repo_id, file_path, commit_id, start_line, end_line, event_id, session_id, agent_slug, model_slug, ts): ranges with the first commit of their repository at or after the edit, null while there is none."""
    of = T.events.where("repo_id is not null").select(F.col("id").alias("event_id"), "session_id", "repo_id", "agent_slug", F.col("ts").cast("string").alias("ts"))
    model = T.sessions.select(F.col("id").alias("session_id"), "model_slug")
    spans = T.ranges.where("end_line >= start_line").select("event_id", F.col("rel_file_path").alias("file_path"), "start_line", "end_line")
    return spans.join(of, "event_id").join(model, "session_id", "left").join(commit_of_edit(T), "event_id", "left").select(*_KEY, "start_line", "end_line", *_WHO)


def credit(lines: DataFrame, ranged: DataFrame, recorded: DataFrame, empty: DataFrame, notes: DataFrame, mapped: DataFrame) -> DataFrame:
    """lines + source (map, record, range or note; null if no agent wrote the line), event_id, session_id, agent_slug, model_slug, ts.

    lines: (repo_id, file_path, final_line, orig_line, commit_id), as git blames them; commit_id is null where a line is in no commit.
    A commit's record settles its file: recorded (commit_id, file_path, line, session_id, agent_slug, model_slug, ts) has its lines, empty (commit_id,
    file_path) the files that it is known to be credited nothing in. Else the latest of its ranged edits counts whose span has the original line;
    where the file has none of that commit, its note does (read_notes). The map (mapped: repo_id, file_path, line as shown, event_id, session_id,
    agent_slug, model_slug, ts, counted_in; a row for every line of files that have a map) overrides: for a line in no commit it alone decides, for
    another it does if it counted the line in that commit. Spans are spread to lines first, so all joins are equi-joins.
    """
    pair = ["commit_id", "file_path"]
    # What is on record or noted for other files than these lines' is left out before it is spread to lines or sorted.
    files = lines.select(*pair).distinct()
    recorded, empty, notes = (d.join(files, pair, "left_semi") for d in (recorded, empty, notes))
    wanted = lines.select(*_KEY, "orig_line").distinct()
    spread = lambda d: d.withColumn("orig_line", F.explode(F.sequence("start_line", "end_line")))
    # Null commits meet as one key of their own.
    keyed = lambda d: d.withColumn("commit_id", F.coalesce("commit_id", F.lit("")))
    who = F.struct(*_WHO)
    by_range = keyed(spread(ranged)).join(keyed(wanted).distinct(), [*_KEY, "orig_line"], "left_semi").groupBy(*_KEY, "orig_line").agg(F.max_by(who, F.struct("ts", "event_id")).alias("by_range"))
    by_record = recorded.withColumn("event_id", F.lit(None).cast("string")).groupBy(*pair, F.col("line").alias("orig_line")).agg(F.max_by(who, F.struct("ts", "session_id")).alias("by_record"))
    settled = recorded.select(*pair).unionByName(empty.select(*pair)).distinct().withColumn("settled", F.lit(True))
    local = ranged.where("commit_id is not null").select(*_KEY).distinct().withColumn("local", F.lit(True))
    noted = spread(notes).select(*pair, "orig_line", F.struct(F.lit(None).cast("string").alias("event_id"), F.col("session").alias("session_id"), F.coalesce("agent", F.lit("unknown")).alias("agent_slug"), F.col("model").alias("model_slug"), "ts").alias("by_note"), F.struct("ts", "start_line").alias("__o"))
    by_note = noted.groupBy(*pair, "orig_line").agg(F.max_by("by_note", "__o").alias("by_note"))
    own = mapped.select("repo_id", "file_path", F.col("line").alias("final_line"), F.when(F.col("session_id").isNotNull(), who).alias("by_map"), "counted_in", F.lit(True).alias("has_map"))
    rows = keyed(lines).join(by_range, [*_KEY, "orig_line"], "left").join(local, _KEY, "left").join(by_record, [*pair, "orig_line"], "left").join(settled, pair, "left")
    rows = rows.join(by_note, [*pair, "orig_line"], "left").join(own, ["repo_id", "file_path", "final_line"], "left")
    loose = F.col("commit_id") == ""
    mapped_here = F.when(loose | F.array_contains("counted_in", F.col("commit_id")), F.col("by_map"))
    found = F.coalesce(
        mapped_here,
        F.when(loose & F.col("has_map").isNotNull(), F.lit(None)).when(F.col("settled"), F.col("by_record")).when(F.col("local") | loose, F.col("by_range")).otherwise(F.col("by_note")),
    )
    source = F.when(found.isNull(), F.lit(None)).when(mapped_here.isNotNull(), "map").when(F.col("settled"), "record").when(F.col("local") | loose, "range").otherwise("note")
    made = rows.withColumns({"source": source, "found": found})
    return made.select("repo_id", "file_path", "final_line", "orig_line", F.nullif("commit_id", F.lit("")).alias("commit_id"), "source", *(F.col(f"found.{n}").alias(n) for n in _WHO))
