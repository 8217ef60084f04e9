"""State that follows files, sessions and repositories through a stream: authorship maps, rework ledgers, look gates.

Each is a StatefulProcessor over the same functions that the batch operators fold with, so a stream gives what a batch
gives on the same order of rows. Maps and ledgers that are untouched for KEPT_DAYS go; Spark then runs batches all the time, so
a query that is to end when its input does (availableNow) asks for no such limit.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators import authorship
from ..operators.changes import rework_event

#: How long a map or ledger outlives its last change.
KEPT_DAYS = 30
#: Provider that the state below needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_AUTHOR = "event_id string, session_id string, agent_slug string, ts bigint, began bigint"
_MAP = f"lines array<struct<hash: bigint, norm: bigint, {_AUTHOR.replace(' ', ': ').replace(',:', ',')}, counted_in: array<string>>>, as_of bigint, seen boolean, authored boolean"

_REWORK = "session_id string, file string, event_id string, generated bigint, reworked bigint"
_LOOK = "repo_id string, event_id string, fired_ms bigint, looked_ms bigint, credits boolean"
_MAP_ROW, _REWORK_ROW, _LOOK_ROW = (Row(*(x.split()[0] for x in authorship.fields(s))) for s in (authorship.LINE, _REWORK, _LOOK))


class MapState(StatefulProcessor):
    """A file's authorship map as value state."""

    def __init__(self, kept_days: int | None) -> None:
        self.kept_ms = kept_days and kept_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.map = handle.getValueState("map", _MAP, self.kept_ms)

    def _load(self) -> authorship.FileMap:
        if not self.map.exists():
            return authorship.FileMap()
        lines, as_of, seen, authored = self.map.get()
        owners = [tuple(x[2:7]) if x[2] is not None else None for x in lines]
        return authorship.FileMap([x[0] for x in lines], [x[1] for x in lines], owners, [tuple(x[7]) for x in lines], as_of, seen, authored)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held, out = self._load(), []
        for step in sorted((r.asDict(recursive=True) for r in rows), key=lambda s: (s["seq"], s["event_id"] or "", s["commit_id"] or "")):
            held, made = authorship.advance(held, step)
            out += made
        lines = [(h, n, *(o or (None,) * 5), list(m)) for h, n, o, m in zip(held.hashes, held.norms, held.owners, held.marks, strict=True)]
        self.map.update((lines, held.as_of, held.seen, held.authored))
        for row in out + authorship.map_lines(key[0], held):
            yield _MAP_ROW(*row)

    def close(self) -> None:
        pass


def authorship_stream(steps: DataFrame, kept_days: int | None = KEPT_DAYS) -> DataFrame:
    """The rows of authorship.fold() of a stream of steps (authorship.STEP): each file's map after every batch that touches it, and what the batch's steps did.

    Steps of a batch are applied in the order of seq, batches as they come: a step that comes after later ones is the late
    edit that claims only lines that no later-begun event wrote.
    """
    held = authorship.as_steps(steps.where("file is not null"))
    return held.groupBy("file").transformWithState(MapState(kept_days), authorship.LINE, "update", "ProcessingTime" if kept_days else "None")


class Ledger(StatefulProcessor):
    """Fingerprints of the lines that a session wrote in a file and that still stand."""

    def __init__(self, most: int | None, kept_days: int | None) -> None:
        self.most, self.kept_ms = most, kept_days and kept_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lines = handle.getListState("lines", "h bigint", self.kept_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        ledger = [x[0] for x in self.lines.get()] if self.lines.exists() else []
        for r in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
            generated, reworked, ledger = rework_event(ledger, list(r["added"] or ()), list(r["removed"] or ()), r["before"], self.most)
            yield _REWORK_ROW(*key, r["event_id"], generated, reworked)
        if ledger:
            self.lines.put([(h,) for h in ledger])
        else:
            self.lines.clear()

    def close(self) -> None:
        pass


def rework_stream(edits: DataFrame, most: int | None = None, kept_days: int | None = KEPT_DAYS) -> DataFrame:
    """(session_id, file, event_id, generated, reworked) of a stream of edits (session_id, file, at, event_id, added, removed, before: arrays of fingerprints, as changes.edit_steps makes them).

    A batch's edits are folded in the order (at, event_id), batches as they come.
    """
    return edits.groupBy("session_id", "file").transformWithState(Ledger(most, kept_days), _REWORK, "update", "ProcessingTime" if kept_days else "None")


class LookGate(StatefulProcessor):
    """A repository's looks that wait for their time, and the look before them."""

    def __init__(self, settle_ms: int, oldest_ms: int, widest_ms: int) -> None:
        self.settle_ms, self.oldest_ms, self.widest_ms = settle_ms, oldest_ms, widest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "fired_ms bigint, event_id string", "kind string, session_id string, moves_content boolean, answered boolean, plain boolean")
        self.before = handle.getValueState("before", "looked_ms bigint, blind boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        now, late = timerValues.getCurrentWatermarkInMs(), []
        for r in rows:
            fired = int(r["fired_at"].timestamp() * 1000)
            self.waiting.updateValue((fired, r["event_id"]), (r["kind"], r["session_id"], r["moves_content"], r["answered"], r["plain"]))
            if fired + self.settle_ms <= now:
                late.append(fired)
            else:
                self.handle.registerTimer(fired + self.settle_ms)
        if late:
            yield from self._run(key, now)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        yield from self._run(key, timerValues.getCurrentWatermarkInMs())

    def _run(self, key: tuple, now: int) -> Iterator[Row]:
        """The waiting looks that are due, oldest first."""
        due = sorted(tuple(k) for k in self.waiting.keys() if k[0] + self.settle_ms <= now)
        for fired, event in due:
            kind, session, moves, answered, plain = self.waiting.getValue((fired, event))
            looked, blind = self.before.get() if self.before.exists() else (None, False)
            timely = looked is not None and now - fired <= self.oldest_ms and now - looked <= self.widest_ms
            credits = bool(kind == "shell" and session is not None and not moves and plain and answered and not blind and timely)
            self.before.update((now if answered or looked is None else looked, not answered))
            self.waiting.removeKey((fired, event))
            yield _LOOK_ROW(key[0], event, fired, now, credits)

    def close(self) -> None:
        pass


def look_stream(looks: DataFrame, late: str = "10 seconds", settle_ms: int = 500, oldest_minutes: int = 10, widest_days: int = 14) -> DataFrame:
    """(repo_id, event_id, fired_ms, looked_ms, credits) of a stream of looks (repo_id, event_id, kind, session_id, fired_at, moves_content, answered, plain).

    A look waits until the watermark has passed its call by settle_ms, so that edits fired before have come; that
    moment is when it looks. The rules are those of authorship.look_gates. A look that comes after its time runs at once.
    """
    gate = LookGate(settle_ms, oldest_minutes * 60_000, widest_days * 86_400_000)
    held = looks.where("repo_id is not null").withWatermark("fired_at", late)
    columns = held.select("repo_id", "event_id", "kind", "session_id", "fired_at", F.coalesce("moves_content", F.lit(False)).alias("moves_content"), F.coalesce("answered", F.lit(True)).alias("answered"), F.coalesce("plain", F.lit(True)).alias("plain"))
    return columns.groupBy("repo_id").transformWithState(gate, _LOOK, "update", "EventTime")
