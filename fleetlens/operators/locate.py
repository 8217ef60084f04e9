"""Where edits and writes stand in a file's text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.alignment import align
from .changes import version_alignment, version_diff

_SPANS = "array<struct<a:int,b:int>>"


def _lines_in(text: Column) -> Column:
    """Lines of a text; an end of line at its end begins no other."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(breaks + F.when(text.endswith("\n"), 0).otherwise(1)).cast("int")


def _place(text: Column, new: Column, claimed: Column) -> Column:
    """First place of new in text (from 1; 0 if none) that overlaps none of the claimed spans. Each step jumps past a claim, so there are no more steps than claims."""
    size = F.length(new)

    def step(at: Column, _: Column) -> Column:
        over = F.filter(claimed, lambda c: (c["a"] < at + size) & (at < c["b"]))
        past = F.array_max(F.transform(over, lambda c: c["b"]))
        return F.when((at == 0) | (F.size(over) == 0), at).otherwise(F.position(new, text, past))

    return F.aggregate(F.sequence(F.lit(0), F.size(claimed)), F.position(new, text), step)


def _spans(text: Column, edits: Column) -> Column:
    """The span of each edit's new string in text, in the order of the edits; a = 0 where there is none."""

    def claim(held: Column, edit: Column) -> Column:
        new = edit["new_string"]
        real = F.filter(held, lambda c: c["a"] > 0)
        at = F.when(F.coalesce(new, F.lit("")) == "", F.lit(0)).otherwise(F.coalesce(_place(text, new, real), F.lit(0)))
        return F.concat(held, F.array(F.struct(at.cast("int").alias("a"), (at + F.when(at > 0, F.length(new)).otherwise(0)).cast("int").alias("b"))))

    return F.aggregate(edits, F.array().cast(_SPANS), claim)


def locate_edits(edits: DataFrame) -> DataFrame:
    """(event_id, edit, start_line, end_line, lines) of events (event_id, text after the edit, edits array<struct<old_string, new_string>>).

    An edit takes the first place of its new string that no edit before it has taken. If line
    ends are told apart and fewer edits are found, carriage returns before line ends count for nothing. An
    edit that isn't found still counts its lines, without start and end; an empty new string
    (a deletion) has 0 lines. Null text finds nothing.
    """
    fold = lambda c: F.replace(c, F.lit("\r\n"), F.lit("\n"))
    text = F.coalesce("text", F.lit(""))
    bent = F.transform("edits", lambda e: F.struct(fold(e["old_string"]).alias("old_string"), fold(e["new_string"]).alias("new_string")))
    found = lambda spans: F.size(F.filter(spans, lambda s: s["a"] > 0))
    rows = edits.select("event_id", "edits", text.alias("text"), _spans(text, F.col("edits")).alias("plain"), _spans(fold(text), bent).alias("folded"))
    use = found(F.col("folded")) > found(F.col("plain"))
    placed = rows.select("event_id", F.when(use, fold(F.col("text"))).otherwise(F.col("text")).alias("text"), F.posexplode(F.arrays_zip("edits", F.when(use, F.col("folded")).otherwise(F.col("plain")).alias("spans"))).alias("edit", "x"))
    lines = _lines_in(F.coalesce("x.edits.new_string", F.lit("")))
    before = F.expr("substring(text, 1, x.spans.a - 1)")
    start = F.when(F.col("x.spans.a") > 0, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1)
    return placed.select("event_id", "edit", start.cast("int").alias("start_line"), (start + F.greatest(lines - 1, F.lit(0))).cast("int").alias("end_line"), lines.alias("lines"))


def nearest_base(writes: DataFrame) -> DataFrame:
    """(event_id, base, added): for whole-file writes (event_id, text, snapshot, head), the base with fewer added lines.

    base is 'snapshot', 'head' or, where both are null, 'none' with all lines of the text added; ties go to the snapshot.
    """
    pairs = writes.select("event_id", "text", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("base"), F.col("snapshot").alias("before")), F.struct(F.lit(1).cast("long").alias("base"), F.col("head").alias("before")))).alias("x"))
    held = pairs.where("x.before is not null").select(F.col("event_id").alias("file"), F.col("x.base").alias("version"), F.col("x.before").alias("before"), F.col("text").alias("after"))
    counts = version_diff(held).groupBy("file", "version").agg(F.count_if(F.col("kind") == "added").alias("n"))
    scored = held.select("file", "version").join(counts, ["file", "version"], "left").groupBy(F.col("file").alias("event_id")).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "version")).alias("b"))
    rows = writes.select("event_id", "text").join(scored, "event_id", "left")
    return rows.select("event_id", F.when(F.col("b.version") == 0, "snapshot").when(F.col("b.version") == 1, "head").otherwise("none").alias("base"), F.coalesce("b.n", _lines_in(F.coalesce("text", F.lit(""))).cast("long")).alias("added"))


def snapshot_placement(writes: DataFrame) -> DataFrame:
    """(event_id, line, later_line): lines of a write (event_id, text) where a later copy (later) of the file has them; nothing if fewer than half are there."""
    pairs = writes.select(F.col("event_id").alias("file"), F.lit(0).cast("long").alias("version"), F.col("text").alias("before"), F.col("later").alias("after")).where("before is not null and after is not null")
    met = version_alignment(pairs)
    share = met.groupBy("file").agg(F.count(F.lit(1)).alias("k")).join(pairs.select("file", _lines_in(F.col("before")).alias("of")), "file").where("2 * k >= of").select("file")
    return met.join(share, "file").select(F.col("file").alias("event_id"), F.col("old_line").alias("line"), F.col("new_line").alias("later_line"))


def countable(events: DataFrame) -> DataFrame:
    """events whose file lies in no repository count 0 generated and reworked lines, measured all the same."""
    inside = lambda c: F.when(F.col("repo_id").isNull() & F.col("file_path").isNotNull(), F.lit(0)).otherwise(F.col(c)).cast(events.schema[c].dataType)
    return events.withColumns({c: inside(c) for c in ("lines_generated", "lines_reworked")})


def counted_in(marks: Column, commit: Column, most: int = 4) -> Column:
    """A line's marks (array of commits that counted it) with another commit, the newest `most`; a commit is marked once."""
    own = F.coalesce(marks, F.array().cast("array<string>"))
    return F.when(F.array_contains(own, commit), own).otherwise(F.slice(F.array_append(own, commit), F.greatest(F.size(own) + 2 - most, F.lit(1)), F.lit(most)))


def expire(state: DataFrame, now, days: int = 30, most_bytes: int = 1 << 20) -> DataFrame:
    """Rows of a map or ledger (updated_at, size_bytes) that are kept: touched within `days` of now, of files not over most_bytes."""
    return state.where((F.col("updated_at") >= F.lit(now) - F.make_dt_interval(F.lit(days))) & (F.coalesce("size_bytes", F.lit(0)) <= most_bytes))


def patch_hunks(patches: DataFrame) -> DataFrame:
    """(event_id, file_path, hunks) from apply_patch texts (event_id, command): each file's hunks, arrays of marked lines, in order; sections of one file are joined.

    A hunk begins at a line of two at-signs or with its file; a moved file goes by its new name, a deleted one has no hunks.
    """
    lines = patches.select("event_id", F.posexplode(F.split(F.regexp_replace("command", "\r\n", "\n"), "\n")).alias("n", "line"))
    named = F.regexp_extract("line", r"^\*\*\* (?:Add|Update) File: (.*?)\s*$", 1)
    moved = F.regexp_extract("line", r"^\*\*\* Move to: (.*?)\s*$", 1)
    opens = F.when(F.col("line").rlike(r"^\*\*\* (?:Add|Update|Delete) File: |^\*\*\* End Patch"), named)
    order = Window.partitionBy("event_id").orderBy("n")
    marked = lines.withColumns({"opens": opens, "section": F.sum(opens.isNotNull().cast("int")).over(order), "hunk": F.sum((opens.isNotNull() | F.col("line").startswith("@@")).cast("int")).over(order)})
    inside = Window.partitionBy("event_id", "section")
    own = marked.withColumn("file_path", F.coalesce(F.max(F.nullif(moved, F.lit(""))).over(inside), F.max("opens").over(inside))).where("file_path <> ''").where(~F.col("line").rlike(r"^(?:\*\*\* |@@)"))
    sorted_ = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    each = own.groupBy("event_id", "file_path", "hunk").agg(sorted_("n", "line").alias("rows"))
    return each.groupBy("event_id", "file_path").agg(sorted_("hunk", "rows").alias("hunks"))


def find_lines(post: list[str], places: dict[str, list[int]], window: list[str], added: list[int], claimed: set[int], start: int) -> int:
    """First place at or after start where window stands in post and none of its added lines (offsets) is claimed, or -1."""
    for at in places.get(window[0], ()):
        if at >= start and post[at : at + len(window)] == window and not any(at + k in claimed for k in added):
            return at
    return -1


def place_hunks(hunks: list[list[str]], post: list[str]) -> tuple[list[int], int]:
    """(numbers of the added lines in post, hunks not found): each hunk by what it leaves, context and all, from the end of the one before.

    If that isn't there, it is looked for from the top, then with one line of context on each side, then with none.
    Lines that a hunk has added are not another's.
    """
    bare = lambda x: x.removesuffix("\r")
    post = [bare(x) for x in post]
    places: dict[str, list[int]] = {}
    for i, x in enumerate(post):
        places.setdefault(x, []).append(i)
    claimed: set[int] = set()
    found, lost, cursor = [], 0, 0
    for hunk in hunks:
        image = [(bare(x[1:]), x[:1] == "+") for x in hunk if x[:1] not in ("-", "\\")]
        added = [i for i, (_, new) in enumerate(image) if new]
        if not added:
            continue
        for context in (len(image), 1, 0):
            low, high = max(added[0] - context, 0), min(added[-1] + context + 1, len(image))
            window, own = [x for x, _ in image[low:high]], [i - low for i in added]
            at = find_lines(post, places, window, own, claimed, cursor)
            at = find_lines(post, places, window, own, claimed, 0) if at < 0 else at
            if at >= 0:
                claimed.update(at + i for i in own)
                found += [at + i + 1 for i in own]
                cursor = at - low + len(image)
                break
        else:
            lost += 1
    return found, lost


def place_patches(patches: DataFrame) -> DataFrame:
    """(event_id, file_path, added, removed, unlocated, spans) of patched files (event_id, file_path, hunks, text after the patch).

    added and removed count all of the hunks' lines, spans (a, b) are runs of added lines that are in the text. A null text has no lines.
    """
    names = ["event_id", "file_path", "added", "removed", "unlocated", "spans"]
    span = pa.struct([("a", pa.int32()), ("b", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for event, file, hunks, text in zip(*(batch.column(c).to_pylist() for c in ("event_id", "file_path", "hunks", "text")), strict=True):
                lines = (text or "").split("\n")
                found, lost = place_hunks(hunks or [], lines[:-1] if lines[-1] == "" else lines)
                spans: list[dict] = []
                for n in sorted(found):
                    if spans and spans[-1]["b"] == n - 1:
                        spans[-1]["b"] = n
                    else:
                        spans.append({"a": n, "b": n})
                marks = [x[:1] for h in hunks or () for x in h]
                out.append((event, file, marks.count("+"), marks.count("-"), lost, spans))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(span)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return patches.select("event_id", "file_path", "hunks", "text").mapInArrow(run, "event_id string, file_path string, added long, removed long, unlocated long, spans array<struct<a:int,b:int>>")


def edit_changes(edits: DataFrame) -> DataFrame:
    """(event_id, edit, added, removed, spans) of events' edits (see locate_edits): the lines that each edit added and removed, without those that its old and new strings share.

    spans (a, b) are runs of the added lines where the new string stands in the text; an edit that isn't found has none and still counts. An
    empty new string removes its old one's lines.
    """
    names = ["event_id", "edit", "added", "removed", "spans"]
    span = pa.struct([("a", pa.int32()), ("b", pa.int32())])

    def lines(text: str | None) -> list[str]:
        rows = [x.removesuffix("\r") for x in (text or "").split("\n")]
        return rows[:-1] if rows[-1] == "" else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for event, edit, start, old, new in zip(*(batch.column(c).to_pylist() for c in ("event_id", "edit", "start_line", "old", "new")), strict=True):
                before, after = lines(old), lines(new)
                same = align(before, after)
                shared = {j for _, j in same}
                fresh = [j for j in range(len(after)) if j not in shared]
                spans: list[dict] = []
                for j in fresh if start is not None else ():
                    if spans and spans[-1]["b"] == start + j - 1:
                        spans[-1]["b"] = start + j
                    else:
                        spans.append({"a": start + j, "b": start + j})
                out.append((event, edit, len(fresh), len(before) - len(same), spans))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(span)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    each = edits.select("event_id", F.posexplode("edits").alias("edit", "e")).select("event_id", "edit", F.col("e.old_string").alias("old"), F.col("e.new_string").alias("new"))
    found = each.join(locate_edits(edits).select("event_id", "edit", "start_line"), ["event_id", "edit"])
    return found.select("event_id", "edit", "start_line", "old", "new").mapInArrow(run, "event_id string, edit int, added long, removed long, spans array<struct<a:int,b:int>>")
