"""Which events are AI edits, and how many lines each of them wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import EDIT_TOOLS, json_text, newlines
from ..sources.fixtures import Tables
from .filters import UNKNOWN, Filters

#: Seconds within which a tool report repeats a file-edit report.
DUPLICATE_S = 5


def range_lines(ranges: DataFrame) -> DataFrame:
    """(event_id, range_lines): lines that an event's ranges name; empty ranges name none."""
    return ranges.groupBy("event_id").agg(F.sum(F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))).alias("range_lines"))


def is_edit(tool: Column, has_range: Column) -> Column:
    measured = (F.coalesce("lines_generated", F.lit(0)) > 0) | (F.coalesce("lines_reworked", F.lit(0)) > 0)
    return F.coalesce((F.col("event_type") == "afterFileEdit") | ((F.col("event_type") == "PostToolUse") & (tool.isin(*EDIT_TOOLS) | has_range | measured)), F.lit(False))


def drop_duplicates(events: DataFrame) -> DataFrame:
    """events without cursor tool reports within five seconds of a cursor file edit of the same file and session (null equals null).

    An equi-join on buckets of five seconds: each file edit is put in its own bucket and both neighbours.
    """
    width = DUPLICATE_S * 1_000_000
    us = F.unix_micros("ts")
    edits = events.where("agent_slug = 'cursor' and event_type = 'afterFileEdit'").select(
        F.col("file_path").alias("__file"), F.coalesce("session_id", F.lit("")).alias("__session"), us.alias("__us"),
        F.explode(F.array(*[F.floor(us / width) + d for d in (-1, 0, 1)])).alias("__bucket"),
    )
    keyed = events.withColumns({"__k": F.coalesce("session_id", F.lit("")), "__t": us, "__b": F.floor(us / width)})
    same = (
        (F.col("agent_slug") == "cursor") & (F.col("event_type") == "PostToolUse") & (F.col("file_path") == F.col("__file")) & (F.col("__k") == F.col("__session"))
        & (F.col("__b") == F.col("__bucket")) & (F.abs(F.col("__t") - F.col("__us")) <= width)
    )
    return keyed.join(edits, same, "left_anti").select(*events.columns)


def ai_edits_scored(T: Tables, f: Filters | None = None) -> DataFrame:
    """One row per AI edit: id, session_id, ts, agent_slug, model, repo_id, file_path, rel_file_path, engineer_email, lines (net of rework), lines_written, lines_replaced.

    Lines: measured if the client measured, else what ranges name, else a patch's added
    lines, else the line ends of the new text.
    """
    tool = json_text(F.col("payload"), "$.tool_name")
    held = T.events.withColumn("__tool", tool).join(range_lines(T.ranges), T.events["id"] == F.col("event_id"), "left").drop("event_id")
    edits = drop_duplicates(held.where(is_edit(F.col("__tool"), F.col("range_lines").isNotNull())))
    typed = newlines(json_text(F.col("payload"), "$.tool_input.new_string")) + newlines(json_text(F.col("payload"), "$.tool_input.content"))
    legacy = F.when(F.col("range_lines") > 0, F.col("range_lines")).when(F.col("__tool") == "apply_patch", F.coalesce("lines_added", F.lit(0))).otherwise(typed)
    written = F.coalesce("lines_generated", legacy)
    replaced = F.when(F.col("lines_generated").isNotNull(), F.coalesce("lines_reworked", F.lit(0))).otherwise(F.lit(0))
    of = T.sessions.select(F.col("id").alias("session_id"), F.col("model_slug").alias("__model"), "engineer_email")
    scored = edits.join(of, "session_id", "left").select(
        "id", "session_id", "ts", "agent_slug", F.coalesce("__model", json_text(F.col("payload"), "$.model"), F.lit(UNKNOWN)).alias("model"), "repo_id", "file_path", "rel_file_path", "engineer_email",
        (written - replaced).cast("long").alias("lines"), written.cast("long").alias("lines_written"), replaced.cast("long").alias("lines_replaced"),
    )
    return f.events(scored) if f else scored


def split_lines(events: DataFrame) -> DataFrame:
    """(id, session_id, repo_id, file_path, lines) of each element of measured splits: events (id, session_id, repo_id, file_lines JSON), net of rework.

    An element without the key repo_id belongs to the event's repository; one whose repo_id is null belongs to none.
    """
    parts = events.where("file_lines is not null").select("id", "session_id", F.col("repo_id").alias("__repo"), F.explode(F.from_json("file_lines", "array<map<string,variant>>")).alias("m"))
    text = lambda k: F.try_variant_get(F.element_at("m", F.lit(k)), "$", "string")
    number = lambda k: F.coalesce(F.try_variant_get(F.element_at("m", F.lit(k)), "$", "long"), F.lit(0))
    repo = F.when(F.map_contains_key("m", F.lit("repo_id")), text("repo_id")).otherwise(F.col("__repo"))
    return parts.select("id", "session_id", repo.alias("repo_id"), F.coalesce(text("rel_file_path"), text("file_path")).alias("file_path"), (number("lines_generated") - number("lines_reworked")).alias("lines"))


def edit_file_lines(events: DataFrame) -> DataFrame:
    """(session_id, repo_id, file_path, edits, lines) from measured splits (see split_lines). Lines of a file are never below 0."""
    return split_lines(events).groupBy("session_id", "repo_id", "file_path").agg(F.countDistinct("id").alias("edits"), F.greatest(F.sum("lines"), F.lit(0)).alias("lines"))
