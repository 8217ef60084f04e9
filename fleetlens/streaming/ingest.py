"""Continuous ingest of envelopes, and running state per session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.agents import normalize_payloads
from ..operators.normalize import decode_envelopes, drop_cross_delivered, name_events, parse_envelopes


def event_stream(envelopes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events of a stream of envelopes, each once: ids are hashes of the envelope, so a replayed one is dropped within the watermark."""
    return drop_cross_delivered(parse_envelopes(envelopes)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def land(decoded: DataFrame, staged: str, out: str) -> None:
    """Write the events of decoded envelopes to out, with every agent's payload in canonical form: the event's name, session and model are those of that form.

    Canonical payloads are written to staged first and read back: what picks fields of them, or filters on them, then
    reads a column and doesn't repeat their expressions. Doing it again replaces what was written.
    """
    normalize_payloads(drop_cross_delivered(decoded)).write.mode("overwrite").parquet(staged)
    name_events(decoded.sparkSession.read.schema("id string, agent_slug string, cwd string, ts timestamp, payload string").parquet(staged)).write.mode("overwrite").parquet(out)


def start_ingest(envelopes: DataFrame, out: str, checkpoint: str, late: str = "1 hour", once: bool = False):
    """Write the stream's events to Parquet in out, a folder batch=k for each batch; a batch that runs again after a failure replaces its folder, so each event is there once.

    Payloads are put in canonical form on the way (see land); the step in between is in out + "-staged" and may go once its batch is done.
    """
    decoded = decode_envelopes(envelopes).withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
    writer = decoded.writeStream.foreachBatch(lambda rows, k: land(rows, f"{out}-staged/batch={k}", f"{out}/batch={k}")).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def running_active(events: DataFrame, idle_minutes: float = 5) -> DataFrame:
    """(session_id, active_us, last_us) of a stream of events (session_id, ts), updated as events come.

    State is a session's last time and sum, so it counts gaps between events in the order in which they arrive,
    sorted within a batch; a late event adds nothing and does not move the last time back.
    """
    cap = int(idle_minutes * 60_000_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, total = state.get if state.exists else (None, 0)
        for at in sorted(x for b in batches for x in b["us"].tolist()):
            if last is not None and at > last:
                total += min(at - last, cap)
            last = at if last is None else max(last, at)
        state.update((last, total))
        yield pd.DataFrame({"session_id": [key[0]], "active_us": [total], "last_us": [last]})

    held = events.where("session_id is not null").select("session_id", F.unix_micros("ts").alias("us"))
    return held.groupBy("session_id").applyInPandasWithState(step, "session_id string, active_us long, last_us long", "last_us long, total_us long", "update", GroupStateTimeout.NoTimeout)


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day window, agent_slug, events, misfires) of a stream, closed once the watermark has passed the day."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "agent_slug").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "hook_misfire").alias("misfires"))
