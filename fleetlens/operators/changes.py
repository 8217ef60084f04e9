"""Changes of files: lines of versions paired, and how much of an agent's own work it reworks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.alignment import align, common_ends
from ..functions.columns import line_hash
from .rounds import kept


def hunk_changes(hunks: DataFrame) -> DataFrame:
    """(event_id, kind added or removed, line, text) from hunks (event_id, hunk, new_start, lines array): an added line's number counts the lines of the new side before it."""
    rows = hunks.select("event_id", "hunk", "new_start", F.posexplode("lines").alias("n", "raw"))
    mark = F.substring("raw", 1, 1)
    before = Window.partitionBy("event_id", "hunk").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    line = F.col("new_start") + F.coalesce(F.sum((~mark.isin("-", "\\")).cast("long")).over(before), F.lit(0))
    kind = F.when(mark == "+", "added").when(mark == "-", "removed")
    return rows.select("event_id", kind.alias("kind"), line.alias("line"), F.expr("substring(raw, 2)").alias("text")).where("kind is not null")


def successive_versions(versions: DataFrame) -> DataFrame:
    """(file, version, before, after): each version (file, version, text) with the one before it; identical ones are left out."""
    before = F.lag("text").over(Window.partitionBy("file").orderBy("version"))
    return versions.withColumn("before", before).where("before is not null and before <> text").select("file", "version", "before", F.col("text").alias("after"))


def _lines(text: str) -> list[str]:
    rows = [x.removesuffix("\r") for x in text.split("\n")]
    return rows[:-1] if rows[-1] == "" else rows


def version_alignment(pairs: DataFrame) -> DataFrame:
    """(file, version, old_line, new_line): lines of before and after that are the same, as version_diff pairs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for file, version, a, b in zip(*(batch.column(c).to_pylist() for c in ("file", "version", "before", "after")), strict=True):
                x, y = _lines(a), _lines(b)
                out.extend((file, version, i + 1, j + 1) for i, j in align(x, y))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "version", "old_line", "new_line"])

    return pairs.select(F.col("file").cast("string").alias("file"), F.col("version").cast("long").alias("version"), "before", "after").mapInArrow(run, "file string, version long, old_line long, new_line long")


def version_diff(pairs: DataFrame) -> DataFrame:
    """(file, version, kind, line, text): lines added and removed between before and after; carriage returns and a missing last line end don't count.

    Lines that both begin or end with are trimmed before the middles are aligned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for file, version, a, b in zip(*(batch.column(c).to_pylist() for c in ("file", "version", "before", "after")), strict=True):
                x, y = _lines(a), _lines(b)
                head, tail = common_ends(x, y)
                x, y = x[head : len(x) - tail], y[head : len(y) - tail]
                same = align(x, y)
                left, right = {i for i, _ in same}, {j for _, j in same}
                out.extend((file, version, "removed", head + 1 + i, v) for i, v in enumerate(x) if i not in left)
                out.extend((file, version, "added", head + 1 + j, v) for j, v in enumerate(y) if j not in right)
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "version", "kind", "line", "text"])

    return pairs.select(F.col("file").cast("string").alias("file"), F.col("version").cast("long").alias("version"), "before", "after").mapInArrow(run, "file string, version long, kind string, line long, text string")


def rework_event(own: list[int], added: list[int], removed: list[int], before: list[int] | None, most: int | None = None) -> tuple[int, int, list[int]]:
    """(lines generated, lines reworked, the ledger after) of one event.

    own: fingerprints the session wrote and still stand; before: how many copies of each removed
    line the file had (null: not known). A removed line counts as rework only as far as other copies don't explain it. With `most`, the
    ledger forgets its oldest lines beyond so many.
    """
    mine, gone, there = Counter(own), Counter(removed), Counter(before or ())
    drop = Counter()
    for h, k in gone.items():
        others = max(max(there[h], k) - mine[h], 0) if before is not None else 0
        drop[h] = min(mine[h], max(k - others, 0))
    reworked, kept = drop.total(), []
    for h in own:
        if drop[h]:
            drop[h] -= 1
        else:
            kept.append(h)
    ledger = kept + added
    return len(added), reworked, ledger[-most:] if most else ledger


def edit_steps(changes: DataFrame) -> DataFrame:
    """(session_id, file, at, event_id, added, removed, before) with fingerprints, a row per event and file, from lines (session_id, file, at, event_id, kind, text, copies)."""
    h = line_hash(F.col("text"))
    own = lambda kind: F.collect_list(F.when(F.col("kind") == kind, h))
    copies = F.collect_set(F.when((F.col("kind") == "removed") & (F.coalesce("copies", F.lit(0)) > 0), F.struct(h.alias("h"), F.col("copies").cast("long").alias("n"))))
    spread = lambda found: F.flatten(F.transform(found, lambda x: F.array_repeat(x["h"], x["n"].cast("int"))))
    return changes.groupBy("session_id", "file", "at", "event_id").agg(own("added").alias("added"), own("removed").alias("removed"), spread(copies).alias("before"))


def rework(changes: DataFrame, most: int | None = None) -> DataFrame:
    """(session_id, file, event_id, generated, reworked) by an ordered fold over each session's file.

    changes: (session_id, file, at, event_id, kind, text, copies): lines added and removed by each
    event; copies: how often a removed line stood in the file before. Events are folded in the order
    (at, event_id). Rows come sorted, one event at a time; only the ledger of one session's file is held.
    """
    names = ["session_id", "file", "event_id", "generated", "reworked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ledger = None, []
        for batch in batches:
            out = []
            for session, file, event, added, removed, before in zip(*(batch.column(c).to_pylist() for c in ("session_id", "file", "event_id", "added", "removed", "before")), strict=True):
                if (session, file) != key:
                    key, ledger = (session, file), []
                generated, reworked, ledger = rework_event(ledger, added, removed, before, most)
                out.append((session, file, event, generated, reworked))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*[pa.string()] * 3, pa.int64(), pa.int64()], strict=True)], names=names)

    ordered = edit_steps(changes).repartition("session_id", "file").sortWithinPartitions("session_id", "file", "at", "event_id")
    return ordered.mapInArrow(run, "session_id string, file string, event_id string, generated long, reworked long")


def line_origins(alignment: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, version, line, origin_version, origin_line): the version in which each line (file, version, line) first stood.

    alignment: (file, version, prior, old_line, new_line) pairs each version with its prior one. Pointers to
    the prior version are doubled by self-joins until they reach lines that have no earlier self, so
    a file with many versions takes a logarithmic number of rounds and no group is folded in one task.
    """
    at = lines.select("file", "version", "line")
    up = alignment.select("file", "version", F.col("new_line").alias("line"), F.col("prior").alias("o_version"), F.col("old_line").alias("o_line"))
    held = at.join(up, ["file", "version", "line"], "left").withColumns({"o_version": F.coalesce("o_version", "version"), "o_line": F.coalesce("o_line", "line")})
    while True:
        held = kept(held)
        far = held.select("file", F.col("version").alias("o_version"), F.col("line").alias("o_line"), F.col("o_version").alias("n_version"), F.col("o_line").alias("n_line"))
        next_ = held.join(far, ["file", "o_version", "o_line"]).select("file", "version", "line", F.col("n_version").alias("o_version"), F.col("n_line").alias("o_line"), ((F.col("n_version") != F.col("o_version")) | (F.col("n_line") != F.col("o_line"))).alias("moved"))
        if next_.where("moved").isEmpty():
            return held.select("file", "version", "line", F.col("o_version").alias("origin_version"), F.col("o_line").alias("origin_line"))
        held = next_.drop("moved")
