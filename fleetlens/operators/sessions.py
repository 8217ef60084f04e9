"""Views of single sessions: lists, timelines, prompts and turns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import duration_ms, json_text, tool_family
from ..sources.fixtures import Tables
from .attribution import attribute_files
from .edits import ai_edits_scored, split_lines
from .filters import Filters
from .metrics import session_active, session_outcomes

COMPACTION = "This session is being continued from a previous conversation"
RESEND_S, LATE_COMMIT_S = 180, 120


def session_facts(T: Tables, ids: DataFrame) -> DataFrame:
    """(id, first_prompt, prompts, active_minutes, edits, files, generated, committed, commits, outcome) for the sessions in ids (id)."""
    pick = ids.select(F.col("id").alias("session_id"))
    own = lambda df: df.join(pick, "session_id", "left_semi")
    asked = own(T.prompts)
    real = ~F.col("prompt_text").startswith(COMPACTION)
    prompts = asked.groupBy("session_id").agg(F.count(F.lit(1)).alias("prompts"), F.substring(F.min_by("prompt_text", F.when(real, F.col("seq"))), 1, 500).alias("first_prompt"))
    edits = own(ai_edits_scored(T)).groupBy("session_id").agg(F.count(F.lit(1)).alias("edits"), F.countDistinct("file_path").alias("files"), F.sum("lines").alias("generated"))
    landed = own(T.commit_sessions).groupBy("session_id").agg(F.sum("lines_attributed").alias("committed"), F.countDistinct(F.when(F.col("lines_attributed") > 0, F.col("commit_id"))).alias("commits"))
    rows = pick
    for part in (prompts, own(session_active(T)), edits, landed, own(session_outcomes(T))):
        rows = rows.join(part, "session_id", "left")
    return rows.withColumnRenamed("session_id", "id").fillna(0, ["prompts", "active_minutes", "edits", "files", "generated", "committed", "commits"])


def list_sessions(T: Tables, f: Filters | None = None, page: int = 1, per_page: int = 50) -> DataFrame:
    """A page of sessions, newest first; only the page's sessions are aggregated."""
    found = (f or Filters()).session_list(T)
    shown = found.orderBy(F.desc("started_at"), F.desc("id")).offset((page - 1) * per_page).limit(per_page).select("id", "agent_slug", "model_slug", "repo_id", "started_at", "ended_at")
    return shown.join(session_facts(T, shown), "id")


def session_detail(T: Tables, ids: DataFrame | None = None) -> DataFrame:
    """The same facts for all sessions, or for those in ids (id)."""
    rows = T.sessions if ids is None else T.sessions.join(ids, "id", "left_semi")
    return rows.select("id", "agent_slug", "model_slug", "repo_id", "started_at", "ended_at").join(session_facts(T, rows), "id")


def files_touched(T: Tables) -> DataFrame:
    """(session_id, file_path, edits, lines): by the event's own file."""
    return ai_edits_scored(T).where("session_id is not null").groupBy("session_id", "file_path").agg(F.count(F.lit(1)).alias("edits"), F.sum("lines").alias("lines"))


def session_commits(T: Tables) -> DataFrame:
    """(session_id, commit_id, repo_id, committed_at, lines_attributed): commits with attributed lines."""
    own = T.commit_sessions.where("lines_attributed > 0").select("session_id", "commit_id", "lines_attributed")
    return own.join(T.commits.select(F.col("id").alias("commit_id"), "repo_id", "committed_at"), "commit_id").select("session_id", "commit_id", "repo_id", "committed_at", "lines_attributed")


def transcript_paths(T: Tables) -> DataFrame:
    """(session_id, transcript_path): the latest path that a session's events name."""
    path = json_text(F.col("payload"), "$.transcript_path")
    return T.events.where("session_id is not null").withColumn("p", path).where("p is not null").groupBy("session_id").agg(F.max_by("p", F.struct("ts", "id")).alias("transcript_path"))


def tool_calls(T: Tables) -> DataFrame:
    """Timeline rows of tool reports and file edits: id, session_id, ts, tool (null for file edits), family, ms, file, lines_written (0 if it is no AI edit), summary, has_stderr, ranged.

    file: the path in the repository, else a range's, else the event's own.
    """
    j = lambda path: json_text(F.col("payload"), path)
    by = F.struct("id")
    named = T.ranges.groupBy(F.col("event_id").alias("id")).agg(F.min_by("rel_file_path", F.when(F.col("rel_file_path").isNotNull(), by)).alias("__rel"), F.min_by("file_path", by).alias("__abs"))
    wrote = ai_edits_scored(T).select("id", "lines_written")
    rows = T.events.where("event_type in ('PostToolUse', 'afterFileEdit') and session_id is not null").join(named.withColumn("ranged", F.lit(True)), "id", "left").join(wrote, "id", "left")
    file = F.coalesce("rel_file_path", "__rel", "__abs", "file_path")
    summary = F.substring(F.coalesce(j("$.tool_input.command"), j("$.tool_input.description"), j("$.tool_input.pattern"), j("$.tool_input.prompt"), file), 1, 200)
    return rows.select(
        "id", "session_id", "ts", j("$.tool_name").alias("tool"), F.coalesce(tool_family(j("$.tool_name")), F.lit("other")).alias("family"), duration_ms(F.col("payload")).alias("ms"), file.alias("file"),
        F.coalesce("lines_written", F.lit(0)).alias("lines_written"), summary.alias("summary"), (F.coalesce(j("$.tool_response.stderr"), F.lit("")) != "").alias("has_stderr"), F.coalesce("ranged", F.lit(False)).alias("ranged"),
    )


def stops(T: Tables) -> DataFrame:
    """(id, session_id, ts, message, effort, permission_mode) of turn ends."""
    j = lambda path: json_text(F.col("payload"), path)
    return T.events.where("event_type = 'Stop' and session_id is not null").select("id", "session_id", "ts", j("$.last_assistant_message").alias("message"), j("$.effort.level").alias("effort"), j("$.permission_mode").alias("permission_mode"))


def classify_prompts(prompts: DataFrame) -> DataFrame:
    """prompts + kind: compaction, resend (the same text within three minutes of the one before), or user; and resend_s, seconds since the one before."""
    order = Window.partitionBy("session_id").orderBy("seq")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))
    again = (F.lag("prompt_text").over(order) == F.col("prompt_text")) & (F.col("gap") >= 0) & (F.col("gap") < RESEND_S * 1_000_000)
    kind = F.when(F.col("prompt_text").startswith(COMPACTION), "compaction").when(again, "resend").otherwise("user")
    return prompts.withColumn("gap", gap).withColumn("kind", kind).withColumn("resend_s", F.when(F.col("kind") == "resend", F.greatest(F.round(F.col("gap") / 1_000_000), F.lit(0.0)).cast("long"))).drop("gap")


def build_turns(T: Tables) -> DataFrame:
    """(session_id, turn, started_us, ended_us, prompts, tools, shell, edit, read, tool_ms, open): turns end at Stops.

    Turn k is what comes after Stop k - 1, up to Stop k; the first takes all earlier rows too. Prompts or calls after
    the last Stop make an open turn, up to the session's end if it has one; a session without a Stop is one open turn. A turn
    begins at its first user prompt (by seq), else its first prompt of any kind, else at the Stop before it or the session's
    start. Calls are tool reports and file edits; one that has line ranges is an edit. Prompts without a time join none.
    """
    us, none = F.unix_micros("ts").alias("us"), F.lit(None)
    asks = classify_prompts(T.prompts).where("ts is not null").select("session_id", us, F.lit("prompt").alias("what"), F.col("kind").alias("detail"), none.cast("double").alias("ms"), "seq")
    family = F.when(F.col("ranged"), "edit").otherwise(F.col("family"))
    calls = tool_calls(T).select("session_id", us, F.lit("tool").alias("what"), family.alias("detail"), "ms", none.cast("bigint").alias("seq"))
    ends = stops(T).select("session_id", us, F.lit("stop").alias("what"), none.cast("string").alias("detail"), none.cast("double").alias("ms"), none.cast("bigint").alias("seq"))
    before = Window.partitionBy("session_id").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    counted = reduce(DataFrame.unionByName, [asks, calls, ends]).withColumn("before", F.coalesce(F.sum((F.col("what") == "stop").cast("long")).over(before), F.lit(0)))
    # Stops of one moment end turns of their own, of which the later ones are empty.
    nth = F.row_number().over(Window.partitionBy("session_id", "us", "what").orderBy(F.lit(0))) - 1
    of_session = T.sessions.select(F.col("id").alias("session_id"), F.unix_micros("started_at").alias("begun"), F.unix_micros("ended_at").alias("over"))
    marks = of_session.select("session_id", F.lit(0).cast("bigint").alias("turn"), F.lit(True).alias("first"))
    rows = counted.withColumn("turn", F.col("before") + F.when(F.col("what") == "stop", nth).otherwise(0))
    of = lambda what, detail=None: F.count_if((F.col("what") == what) & (F.col("detail") == detail if detail else F.lit(True)))
    first = lambda ok: F.min_by("us", F.when(ok, F.col("seq")))
    closed = rows.where("what = 'stop'").groupBy("session_id", "turn").agg(F.max("us").alias("stop_us"))
    last = closed.groupBy("session_id").agg((F.max("turn") + 1).alias("stops"), F.max("stop_us").alias("last_stop"))
    held = rows.where("what <> 'stop'").join(of_session.select("session_id", "over"), "session_id").join(last, "session_id", "left")
    # An open turn's rows end with the session, but for those of a session's first moments.
    inside = held.withColumn("late", (F.col("turn") >= F.coalesce("stops", F.lit(0))) & (F.col("us") > F.col("over")))
    own = inside.withColumns({n: F.when(~F.coalesce("late", F.lit(False)), F.col(n)) for n in ("what", "detail", "ms", "seq")}).groupBy("session_id", "turn").agg(
        F.coalesce(first((F.col("what") == "prompt") & (F.col("detail") == "user")), first(F.col("what") == "prompt")).alias("asked"), of("prompt").alias("prompts"), of("tool").alias("tools"),
        of("tool", "shell").alias("shell"), of("tool", "edit").alias("edit"), of("tool", "read").alias("read"), F.coalesce(F.sum("ms"), F.lit(0.0)).alias("tool_ms"),
    )
    turns = marks.select("session_id", "turn").unionByName(closed.select("session_id", "turn")).unionByName(own.select("session_id", "turn")).distinct()
    made = turns.join(closed, ["session_id", "turn"], "left").join(own, ["session_id", "turn"], "left").join(of_session, "session_id")
    since = F.coalesce(F.lag("stop_us").over(Window.partitionBy("session_id").orderBy("turn")), "begun")
    return made.withColumn("since", since).select(
        "session_id", "turn", F.coalesce("asked", "since").alias("started_us"), F.coalesce("stop_us", "over").alias("ended_us"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("prompts", "tools", "shell", "edit", "read")),
        F.coalesce("tool_ms", F.lit(0.0)).alias("tool_ms"), F.col("stop_us").isNull().alias("open"),
    )


def turn_durations(turns: DataFrame) -> DataFrame:
    """turns + duration_ms, never below 0; null while open."""
    return turns.withColumn("duration_ms", F.when(F.col("ended_us").isNotNull(), F.greatest((F.col("ended_us") - F.col("started_us")) / 1000, F.lit(0.0))))


def commit_turns(T: Tables) -> DataFrame:
    """(session_id, commit_id, turn): the earliest turn that ends within two minutes before the commit or later; the last takes the rest; not after the session's start: null.

    Turns and commits of a session lie on one line of time, and a window finds the next turn's limit: no commit meets every turn.
    """
    turns = build_turns(T).select("session_id", "turn", (F.col("ended_us") + LATE_COMMIT_S * 1_000_000).alias("limit"))
    last = turns.groupBy("session_id").agg(F.max("turn").alias("last"))
    own = session_commits(T).select("session_id", "commit_id", F.unix_micros("committed_at").alias("at"))
    marks = turns.where("limit is not null").select("session_id", F.lit(None).cast("string").alias("commit_id"), F.col("limit").alias("at"), "turn")
    both = own.withColumn("turn", F.lit(None).cast("long")).unionByName(marks)
    after = Window.partitionBy("session_id").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    hits = both.withColumn("hit", F.min("turn").over(after)).where("commit_id is not null").drop("turn")
    begun = T.sessions.select(F.col("id").alias("session_id"), F.unix_micros("started_at").alias("begun"))
    placed = hits.join(last, "session_id", "left").join(begun, "session_id")
    return placed.select("session_id", "commit_id", F.when(F.col("at") > F.col("begun"), F.coalesce("hit", "last")).alias("turn"))


def edit_files(T: Tables) -> DataFrame:
    """(session_id, id, repo_id, file_path, lines): what each AI edit of a session wrote, file by file.

    An edit with a measured split (events.file_lines) has a row per element, in that element's repository (the event's where it
    names none). One that its client didn't measure, with ranges in several files, has a row per file, with its ranges' lines. Any other has
    one row, on its own file or its first range's; a repository counts only with a path in it. Edits that name no file have none.
    """
    edits = ai_edits_scored(T).where("session_id is not null").select("id", "session_id", "repo_id", "rel_file_path", F.col("file_path").alias("own"), "lines")
    event = T.events if "file_lines" in T.events.columns else T.events.withColumn("file_lines", F.lit(None).cast("string"))
    split = F.when(F.try_parse_json("file_lines").isNotNull(), F.col("file_lines"))
    rows = edits.join(event.select("id", F.col("lines_generated").alias("measured"), split.alias("file_lines")), "id")
    size = F.col("new_text_lines") if "new_text_lines" in T.ranges.columns else F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))
    spans = T.ranges.select(F.col("id").alias("range_id"), F.col("event_id").alias("id"), F.col("rel_file_path").alias("rel"), F.coalesce("rel_file_path", "file_path").alias("f"), F.col("file_path").alias("abs"), size.alias("n"))
    of_event = spans.groupBy("id").agg(F.min_by("rel", F.when(F.col("rel").isNotNull(), F.col("range_id"))).alias("first_rel"), F.min_by("abs", "range_id").alias("first_abs"), F.countDistinct("f").alias("files"))
    held = rows.join(of_event, "id", "left")
    by_ranges = F.col("file_lines").isNull() & F.col("measured").isNull() & (F.coalesce("files", F.lit(0)) > 1)
    columns = ["session_id", "id", "repo_id", "file_path", "lines"]
    measured = split_lines(held.where("file_lines is not null").select("id", "session_id", "repo_id", "file_lines")).select(*columns)
    ranged = held.where(by_ranges).select("session_id", "id", "repo_id").join(spans, "id").groupBy("session_id", "id", F.col("f").alias("file_path")).agg(F.max(F.when(F.col("rel").isNotNull(), F.col("repo_id"))).alias("repo_id"), F.sum("n").alias("lines"))
    rel = F.coalesce("rel_file_path", "first_rel")
    plain = held.where(F.col("file_lines").isNull() & ~by_ranges).select("session_id", "id", F.when(rel.isNotNull(), F.col("repo_id")).alias("repo_id"), F.coalesce(rel, "first_abs", "own").alias("file_path"), "lines")
    return measured.unionByName(ranged.select(*columns)).unionByName(plain).where("file_path is not null")


def file_rows(T: Tables, credited: DataFrame | None = None) -> DataFrame:
    """(session_id, repo_id, file_path, generated, committed, edits): what a session wrote to a file against what commits credit it with there; generated is at least committed.

    credited: (commit_id, session_id, file_path, lines_attributed); T's recorded commit_session_files if not given, else by position. A file
    that is credited with no lines keeps its row.
    """
    none = F.lit("")  # stands for no repository where keys meet
    wrote = edit_files(T).groupBy("session_id", F.coalesce("repo_id", none).alias("repo"), "file_path").agg(F.greatest(F.sum("lines"), F.lit(0)).alias("generated"), F.count(F.lit(1)).alias("edits"))
    rows = credited if credited is not None else T.extra.get("commit_session_files")
    rows = attribute_files(T) if rows is None else rows
    made = T.commits.select(F.col("id").alias("commit_id"), F.coalesce("repo_id", none).alias("repo"))
    kept = rows.join(made, "commit_id").groupBy("session_id", "repo", "file_path").agg(F.sum("lines_attributed").alias("committed"))
    both = wrote.join(kept, ["session_id", "repo", "file_path"], "full_outer").fillna(0, ["generated", "committed", "edits"])
    return both.select("session_id", F.nullif("repo", none).alias("repo_id"), "file_path", F.greatest("generated", "committed").alias("generated"), "committed", "edits")


def session_count(T: Tables, f: Filters | None = None) -> DataFrame:
    """One row: n, the sessions that the list would show, of the filter's outcome if it has one."""
    found = (f or Filters()).session_list(T).select(F.col("id").alias("session_id"))
    if f and f.outcome:
        found = found.join(session_outcomes(T).where(F.col("outcome") == f.outcome), "session_id", "left_semi")
    return found.agg(F.count(F.lit(1)).alias("n"))


def session_stats(T: Tables, usage: DataFrame | None = None) -> DataFrame:
    """A row a session: wall_minutes (null while it runs, never below 0), active_minutes, prompts typed, turns, tool_calls, edits, files, commits, committed, generated, output_tokens.

    output_tokens falls back to the sum over usage (session_id, output_tokens) read from transcripts.
    """
    wall = F.greatest((F.unix_micros("ended_at") - F.unix_micros("started_at")) / 60_000_000, F.lit(0.0))
    rows = T.sessions.select(F.col("id").alias("session_id"), F.when(F.col("ended_at").isNotNull(), wall).alias("wall_minutes"), F.col("output_tokens").alias("__own"))
    count = F.count(F.lit(1))
    parts = [
        session_active(T), classify_prompts(T.prompts).where("kind = 'user' and ts is not null").groupBy("session_id").agg(count.alias("prompts")), build_turns(T).groupBy("session_id").agg(count.alias("turns")),
        tool_calls(T).groupBy("session_id").agg(count.alias("tool_calls")), ai_edits_scored(T).groupBy("session_id").agg(count.alias("edits")),
        file_rows(T).groupBy("session_id").agg(count.alias("files"), F.sum("generated").alias("generated")), session_commits(T).groupBy("session_id").agg(count.alias("commits"), F.sum("lines_attributed").alias("committed")),
    ]
    for part in parts:
        rows = rows.join(part, "session_id", "left")
    rows = rows.fillna(0, ["active_minutes", "prompts", "turns", "tool_calls", "edits", "files", "generated", "commits", "committed"])
    if usage is None:
        return rows.withColumnRenamed("__own", "output_tokens")
    read = usage.groupBy("session_id").agg(F.sum("output_tokens").alias("__read"))
    return rows.join(read, "session_id", "left").withColumn("output_tokens", F.coalesce("__own", "__read")).drop("__own", "__read")


def idle_gaps(T: Tables, minutes: int = 8) -> DataFrame:
    """(session_id, gaps, idle_ms, active_ms): gaps between distinct event times that are longer than the threshold, and the time outside them."""
    times = T.events.where("session_id is not null").select("session_id", F.unix_micros("ts").alias("us")).distinct()
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("session_id").orderBy("us"))
    long = F.col("gap") > minutes * 60_000_000
    return times.withColumn("gap", gap).groupBy("session_id").agg(F.count_if(long).alias("gaps"), (F.coalesce(F.sum(F.when(long, F.col("gap"))), F.lit(0)) / 1000).alias("idle_ms"), (F.coalesce(F.sum(F.when(~long, F.col("gap"))), F.lit(0)) / 1000).alias("active_ms"))


def turn_blocks(T: Tables) -> DataFrame:
    """(session_id, turn, filled): closed turns, and whether an edit fell inside."""
    us = F.unix_micros("ts").alias("us")
    marks = stops(T).select("session_id", us, F.lit(1).alias("stop")).unionByName(ai_edits_scored(T).where("session_id is not null").select("session_id", us, F.lit(0).alias("stop")))
    before = Window.partitionBy("session_id").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    rows = marks.withColumn("turn", F.coalesce(F.sum("stop").over(before), F.lit(0)))
    return rows.groupBy("session_id", "turn").agg(F.max("stop").alias("closed"), (F.min("stop") == 0).alias("filled")).where("closed = 1").select("session_id", "turn", "filled")
