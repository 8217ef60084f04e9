"""Repair, retention and export of the tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.fixtures import Tables


def build_sessions(events: DataFrame) -> DataFrame:
    """(id, agent_slug, model_slug, repo_id, started_at, ended_at) from events: the newest known model, the first known repository."""
    model = F.get_json_object("payload", "$.model")
    order = F.struct("ts", "id")
    return events.where("session_id is not null").groupBy(F.col("session_id").alias("id")).agg(
        F.min_by("agent_slug", order).alias("agent_slug"), F.max_by(model, F.when(model.isNotNull(), order)).alias("model_slug"), F.min_by("repo_id", F.when(F.col("repo_id").isNotNull(), order)).alias("repo_id"),
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
    )


def orphan_sessions(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions to add: those that events name and the table lacks."""
    return build_sessions(events.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_anti"))


def session_repo(events: DataFrame) -> DataFrame:
    """(session_id, repo_id): the repository of most of a session's events; ties by name."""
    counts = events.where("session_id is not null and repo_id is not null").groupBy("session_id", "repo_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("session_id").agg(F.min_by("repo_id", F.struct(-F.col("n"), "repo_id")).alias("repo_id"))


def session_engineer(sessions: DataFrame, commits: DataFrame) -> DataFrame:
    """(session_id, engineer_email): the only author of the commits in a session's repository and span; none or several: no row.

    A repository's commits in order fall into runs of one author each. A span has one author if it has a commit and the run at its end began
    no later than its first commit. Both come from running counts over commits and the spans' ends in one order, so no commit meets a span in a join.
    """
    held = sessions.where("repo_id is not null and started_at is not null and ended_at >= started_at").select("id", "repo_id", "started_at", "ended_at")
    # At one time: a span's start (0), commits (1), its end (2).
    ends = held.select("repo_id", F.col("id").alias("session_id"), F.inline(F.array(*[F.struct(F.unix_micros(c).alias("at"), F.lit(turn).alias("turn")) for c, turn in (("started_at", 0), ("ended_at", 2))])))
    made = commits.where("author_email is not null and committed_at is not null").select("repo_id", F.unix_micros("committed_at").alias("at"), F.lit(1).alias("turn"), "author_email")
    order = Window.partitionBy("repo_id").orderBy("at", "turn", "author_email")
    sofar, before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    points = ends.unionByName(made, allowMissingColumns=True).withColumns({"n": F.count("author_email").over(sofar), "author": F.last("author_email", True).over(sofar), "other": F.last("author_email", True).over(before)})
    runs = points.withColumn("began", F.max(F.when((F.col("turn") == 1) & ~F.col("author_email").eqNullSafe(F.col("other")), F.col("n"))).over(sofar))
    last = lambda c: F.max(F.when(F.col("turn") == 2, F.col(c)))
    spans = runs.where("turn <> 1").groupBy("session_id").agg(F.max(F.when(F.col("turn") == 0, F.col("n"))).alias("before"), last("n").alias("n"), last("began").alias("began"), last("author").alias("engineer_email"))
    return spans.where("n > before and began <= before + 1").select("session_id", "engineer_email")


def remove_phantoms(T: Tables) -> Tables:
    """T without events that another agent's hook sent for cursor, and without sessions that had no others; their prompts, ranges and attribution go too."""
    marked = T.events.withColumn("phantom", (F.coalesce(F.get_json_object("payload", "$.cursor_version"), F.lit("")) != "") & (F.col("agent_slug") != "cursor"))
    gone = marked.where("session_id is not null").groupBy("session_id").agg(F.min(F.col("phantom").cast("int")).alias("all")).where("all = 1").select("session_id")
    lost = marked.where("phantom").select(F.col("id").alias("event_id"))
    of = gone.withColumnRenamed("session_id", "id")
    return T.having(
        events=marked.where("not phantom").drop("phantom"), sessions=T.sessions.join(of, "id", "left_anti"), ranges=T.ranges.join(lost, "event_id", "left_anti"),
        prompts=T.prompts.join(gone, "session_id", "left_anti"), commit_sessions=T.commit_sessions.join(gone, "session_id", "left_anti"),
    )


def prune(T: Tables, now: dt.datetime, days: int = 365, require_synced: bool = False) -> Tables:
    """T without events older than the cutoff that no range refers to, and without prompts as old (by created_at, if there is one, where ts is null).

    With require_synced only rows go that have been exported (synced_at).
    """
    cutoff = F.lit(now - dt.timedelta(days=days))
    sent = F.col("synced_at").isNotNull() if require_synced else F.lit(True)
    old = T.events.where((F.col("ts") < cutoff) & sent).join(T.ranges.select(F.col("event_id").alias("id")), "id", "left_anti").select("id")
    asked = F.coalesce("ts", "created_at") if "created_at" in T.prompts.columns else F.col("ts")
    return T.having(events=T.events.join(old, "id", "left_anti"), prompts=T.prompts.where(~F.coalesce((asked < cutoff) & sent, F.lit(False))))


def prune_counts(T: Tables, now: dt.datetime, days: int = 365) -> DataFrame:
    """(table_name, rows) that prune would remove."""
    kept = prune(T, now, days)
    count = lambda name, df, rest: df.agg(F.count(F.lit(1)).alias("n")).crossJoin(rest.agg(F.count(F.lit(1)).alias("m"))).select(F.lit(name).alias("table_name"), (F.col("n") - F.col("m")).alias("rows"))
    return count("events", T.events, kept.events).unionByName(count("prompts", T.prompts, kept.prompts))


def select_pending(table: DataFrame, limit: int = 1000) -> DataFrame:
    """Rows not yet exported, the oldest `limit` by id, without the mark itself."""
    return table.where("synced_at is null").orderBy("id").limit(limit).drop("synced_at")


def mark_synced(table: DataFrame, keys: DataFrame, at: dt.datetime) -> DataFrame:
    """table with the rows of keys (id) marked as exported."""
    sent = keys.select("id").distinct().withColumn("__sent", F.lit(True))
    return table.join(sent, "id", "left").withColumn("synced_at", F.when(F.col("__sent"), F.lit(at)).otherwise(F.col("synced_at"))).drop("__sent")


def latest_rows(landed: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last copy of each row of an append-only landing zone."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return landed.withColumn("__r", last).where("__r = 1").drop("__r")


def export_status(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, pending, total) over tables with synced_at."""
    rows = [t.agg(F.count_if(F.col("synced_at").isNull()).alias("pending"), F.count(F.lit(1)).alias("total")).select(F.lit(n).alias("table_name"), "pending", "total") for n, t in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def inspect_events(events: DataFrame, agent: str | None = None, event_type: str | None = None, session: str | None = None, since: dt.datetime | None = None, limit: int = 10) -> DataFrame:
    """Raw events that match, newest first, at most `limit` (1 to 1000)."""
    found = events
    for column, value in (("agent_slug", agent), ("event_type", event_type), ("session_id", session)):
        if value:
            found = found.where(F.col(column) == value)
    if since:
        found = found.where(F.col("ts") >= F.lit(since))
    return found.orderBy(F.desc("ts"), F.desc("id")).limit(max(1, min(1000, limit)))
