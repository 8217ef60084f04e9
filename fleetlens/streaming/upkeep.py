"""Streams that keep derived tables current: duplicates dropped, sessions closed at Stop, commits attributed again after late edits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..functions.columns import pick_string
from ..operators import attribution
from ..operators.edits import DUPLICATE_S
from ..sources.envelopes import transcript_prompts, transcript_summary
from ..sources.fixtures import Tables


def drop_duplicates(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of events without cursor tool reports within five seconds of a cursor file edit of the same file and session (null equals null).

    A tool report is held back until the watermark has passed the seconds in which a file edit could still
    make it a duplicate; other events pass at once. Events later than the watermark are dropped.
    """
    marked = events.withWatermark("ts", late)
    cursor = F.coalesce(F.col("agent_slug") == "cursor", F.lit(False))
    tool = cursor & F.coalesce(F.col("event_type") == "PostToolUse", F.lit(False)) & F.col("file_path").isNotNull()
    edits = marked.where(cursor & (F.col("event_type") == "afterFileEdit") & F.col("file_path").isNotNull()).select(F.col("file_path").alias("__file"), F.coalesce("session_id", F.lit("")).alias("__session"), F.col("ts").alias("__ts"))
    held = marked.where(tool).withColumn("__key", F.coalesce("session_id", F.lit("")))
    near = F.expr(f"file_path = __file AND __key = __session AND __ts >= ts - interval {DUPLICATE_S} seconds AND __ts <= ts + interval {DUPLICATE_S} seconds")
    kept = held.join(edits, near, "left_outer").where("__ts is null").select(*events.columns)
    return marked.where(~tool).select(*events.columns).unionByName(kept)


def _write(rows: DataFrame, out: str, batch: int) -> None:
    """A batch's rows in a folder of its own, so that a repeated batch replaces itself."""
    rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def start_session_updates(events: DataFrame, transcripts: Callable[[], DataFrame], out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """At each Stop of a stream of events (session_id, agent_slug, ts, event_type, payload), write what its session's transcript says to out.

    transcripts gives the lines (file, n, line) as they stand at the batch; only files that a Stop of the batch names are summed.
    sessions: session_id, model, first_ts, last_ts, input_tokens, output_tokens, and prompts: session_id, agent_slug, seq, prompt_text.
    Totals are of whole transcripts, so a repeated Stop repeats them. Read with session_updates and session_prompts.
    """
    path = pick_string(F.col("payload"), "$.transcript_path", "$.transcriptPath")
    stops = events.where("event_type = 'Stop' and session_id is not null").select("session_id", "agent_slug", "ts", path.alias("path")).where("path is not null")

    def update(rows: DataFrame, batch: int) -> None:
        named = rows.groupBy("session_id").agg(F.max_by(F.struct("path", "agent_slug"), F.struct("ts", "path")).alias("s")).select("session_id", "s.*")
        lines = transcripts().withColumn("path", F.regexp_replace("file", r"^\w+:(//[^/]*)?", "")).join(named.select("path").distinct(), "path", "left_semi")
        lines = lines.select(F.col("path").alias("file"), "n", "line")
        of = named.withColumnRenamed("path", "file")
        _write(of.join(transcript_summary(lines), "file").select("session_id", "model", "first_ts", "last_ts", "input_tokens", "output_tokens"), f"{out}/sessions", batch)
        _write(of.join(transcript_prompts(lines), "file").select("session_id", "agent_slug", "seq", "prompt_text"), f"{out}/prompts", batch)

    writer = stops.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def session_updates(spark: SparkSession, out: str) -> DataFrame:
    """(session_id, model, first_ts, last_ts, input_tokens, output_tokens): of every column the value of the last batch that had one."""
    rows = spark.read.parquet(f"{out}/sessions")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("batch"))).alias(c) for c in rows.columns if c not in ("session_id", "batch")]
    return rows.groupBy("session_id").agg(*last)


def session_prompts(spark: SparkSession, out: str) -> DataFrame:
    """(session_id, agent_slug, seq, prompt_text): each prompt once, as the last batch read it."""
    rows = spark.read.parquet(f"{out}/prompts")
    return rows.groupBy("session_id", "seq").agg(F.max_by(F.struct("agent_slug", "prompt_text"), "batch").alias("p")).select("session_id", "p.agent_slug", "seq", "p.prompt_text")


def start_reattribution(events: DataFrame, tables: Callable[[], Tables], out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """For a stream of edits (repo_id, rel_file_path, ts), attribute again the commits whose files they touched before the commit was made.

    tables gives what is stored at the batch, its edits included. Only the batch's commits are worked out, each as
    a whole; out gets their rows (commit_id, session_id, file_path, event_count, lines_attributed) and a row of nulls for commits
    that no session owns a line of, so that rows of an earlier batch don't outlive them. Read with attributed_files.
    """
    touched = events.where("repo_id is not null and rel_file_path is not null").select("repo_id", F.col("rel_file_path").alias("file_path"), "ts")

    def again(rows: DataFrame, batch: int) -> None:
        T = tables()
        commits = attribution.affected_commits(rows.groupBy("repo_id", "file_path").agg(F.min("ts").alias("since")), T)
        files = T.commit_files.join(commits, "commit_id", "left_semi")
        owned = attribution.attribute_files(T, attribution.added_lines(T.having(commit_files=files)))
        _write(commits.join(owned, "commit_id", "left"), out, batch)

    writer = touched.writeStream.foreachBatch(again).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def attributed_files(spark: SparkSession, out: str) -> DataFrame:
    """The rows of start_reattribution, each commit as its last batch left it."""
    rows = spark.read.parquet(out)
    newest = F.max("batch").over(Window.partitionBy("commit_id"))
    return rows.withColumn("__newest", newest).where("batch = __newest and session_id is not null").drop("batch", "__newest")
