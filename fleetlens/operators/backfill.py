"""Repairs that fill what older records lack, and the order in which they run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import event_type_col
from ..sources.fixtures import Tables
from .locate import patch_hunks, place_patches
from .maintenance import build_sessions, orphan_sessions, remove_phantoms, session_engineer, session_repo

TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")


def fill_sessions(sessions: DataFrame, summaries: DataFrame) -> DataFrame:
    """sessions whose model and tokens, where null, come from transcripts' summaries (session_id, model_slug, tokens); columns as they were."""
    of = summaries.select(F.col("session_id").alias("id"), *[F.col(c).alias(f"__{c}") for c in ("model_slug", *TOKENS)])
    own = {c: F.coalesce(F.col(c), F.col(f"__{c}").cast(sessions.schema[c].dataType)) for c in ("model_slug", *TOKENS)}
    return sessions.join(of, "id", "left").select(*[own[c].alias(c) if c in own else F.col(c) for c in sessions.columns])


def fill_prompts(stored: DataFrame, transcript: DataFrame, hooks: DataFrame) -> DataFrame:
    """stored prompts + those of transcripts for sessions without any, + those of hooks (no seq) for sessions still without, numbered by time.

    All: session_id, ts, agent_slug, prompt_text; stored and transcript also seq.
    """
    columns = ["session_id", "seq", "ts", "agent_slug", "prompt_text"]
    rows = stored.select(columns)
    rows = rows.unionByName(transcript.select(columns).join(stored.select("session_id").distinct(), "session_id", "left_anti"))
    order = Window.partitionBy("session_id").orderBy("ts", "prompt_text")
    left = hooks.join(rows.select("session_id").distinct(), "session_id", "left_anti").withColumn("seq", F.row_number().over(order).cast("long"))
    return rows.unionByName(left.select(columns))


def upsert_prompts(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """stored + fresh prompts whose (session_id, seq) isn't there; those without seq follow the session's last, by time. Doing it again with numbered rows changes nothing."""
    columns = ["session_id", "seq", "ts", "agent_slug", "prompt_text"]
    numbered = fresh.where("seq is not null").select(columns).dropDuplicates(["session_id", "seq"]).join(stored.select("session_id", "seq"), ["session_id", "seq"], "left_anti")
    known = stored.select(columns).unionByName(numbered.select(columns))
    last = known.groupBy("session_id").agg(F.max("seq").alias("__last"))
    order = Window.partitionBy("session_id").orderBy("ts", "prompt_text")
    rest = fresh.where("seq is null").join(last, "session_id", "left").withColumn("seq", (F.coalesce("__last", F.lit(0)) + F.row_number().over(order)).cast("long"))
    return known.unionByName(rest.select(columns))


def fill_rel_paths(ranges: DataFrame, events: DataFrame) -> DataFrame:
    """ranges whose rel_file_path, where null, is that of their event if both name the same file; columns as they were."""
    of = events.where("rel_file_path is not null").select(F.col("id").alias("event_id"), F.col("file_path").alias("__file"), F.col("rel_file_path").alias("__rel"))
    same = F.col("file_path").isNull() | (F.col("file_path") == F.col("__file"))
    return ranges.join(of, "event_id", "left").withColumn("rel_file_path", F.coalesce("rel_file_path", F.when(same, F.col("__rel")))).select(*ranges.columns)


def fill_ranges(T: Tables, located: DataFrame) -> DataFrame:
    """ranges + those that locate_edits found (event_id, edit, start_line, end_line) for events that have none."""
    bare = located.where("start_line is not null").join(T.ranges.select("event_id"), "event_id", "left_anti")
    of = T.events.select(F.col("id").alias("event_id"), "rel_file_path", "file_path")
    fresh = bare.join(of, "event_id").select(F.concat_ws("#", "event_id", F.col("edit").cast("string")).alias("id"), "event_id", "rel_file_path", "file_path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))
    return T.ranges.unionByName(fresh)


def fill_patch_ranges(T: Tables, texts: DataFrame) -> DataFrame:
    """ranges + those of patches without any: tool reports of apply_patch, placed in each file's text (event_id, file_path as the patch names it, rel_file_path, text)."""
    patch = F.coalesce(F.get_json_object("payload", "$.tool_input.command"), F.get_json_object("payload", "$.tool_input.patch"))
    named = T.events.where("event_type = 'PostToolUse'").where(F.get_json_object("payload", "$.tool_name") == "apply_patch").select(F.col("id").alias("event_id"), patch.alias("command"))
    bare = named.where("command is not null").join(T.ranges.select("event_id"), "event_id", "left_anti")
    placed = place_patches(patch_hunks(bare).join(texts, ["event_id", "file_path"]))
    spans = placed.select("event_id", "file_path", F.posexplode("spans").alias("n", "s")).join(texts.select("event_id", "file_path", "rel_file_path"), ["event_id", "file_path"])
    return T.ranges.unionByName(spans.select(F.concat_ws("#", "event_id", "file_path", F.col("n").cast("string")).alias("id"), "event_id", "rel_file_path", "file_path", F.col("s.a").cast("long").alias("start_line"), F.col("s.b").cast("long").alias("end_line")))


def drop_repeated_ranges(T: Tables) -> DataFrame:
    """ranges without those of tool reports that repeat a file edit (edits.drop_duplicates)."""
    from .edits import drop_duplicates

    kept = drop_duplicates(T.events).select(F.col("id").alias("event_id"))
    return T.ranges.join(kept, "event_id", "left_semi")


def repair(T: Tables, summaries: DataFrame | None = None) -> Tables:
    """T after all repairs, in the order that each needs: event names, phantoms, sessions of orphan events, relative paths, repeated ranges, then each session's repository, engineer, model and tokens. Doing it again changes nothing."""
    T = T.having(events=T.events.withColumn("event_type", event_type_col(F.col("event_type"))))
    T = remove_phantoms(T)
    found = orphan_sessions(T.events, T.sessions)
    T = T.having(sessions=T.sessions.unionByName(found, allowMissingColumns=True))
    T = T.having(ranges=fill_rel_paths(T.ranges, T.events))
    T = T.having(ranges=drop_repeated_ranges(T))
    seen = build_sessions(T.events).select("id", F.col("model_slug").alias("__m"))
    most, author = session_repo(T.events).withColumnsRenamed({"session_id": "id", "repo_id": "__r"}), session_engineer(T.sessions, T.commits).withColumnsRenamed({"session_id": "id", "engineer_email": "__e"})
    filled = T.sessions.join(most, "id", "left").join(author, "id", "left").join(seen, "id", "left")
    own = {"repo_id": F.coalesce("__r", "repo_id"), "engineer_email": F.coalesce("engineer_email", "__e"), "model_slug": F.coalesce("model_slug", "__m")}
    sessions = filled.select(*[own[c].alias(c) if c in own else F.col(c) for c in T.sessions.columns])
    return T.having(sessions=fill_sessions(sessions, summaries) if summaries is not None else sessions)
