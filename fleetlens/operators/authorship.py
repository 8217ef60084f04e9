"""Who wrote each line of a file: the authorship map, kept up to date edit by edit, and commits credited by it.

A file's history is a sequence of steps in the order in which they are handled: edits (what an event left
in the file, and which of its lines it wrote), bare snapshots (lines without authors), looks (what was found in the
file after a shell call, whose new lines may be the call's) and commits (the committed copy, and which of its
lines the commit adds). Texts become fingerprints on the JVM; only those reach the fold. It runs
over rows sorted by file and order and holds one file's map at a time, never a file's steps.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.alignment import align, carried
from ..functions.columns import is_trivial, line_hash, norm_hash

#: Commits that a line remembers it was counted in, the newest.
MARKS = 4
_AUTHOR = "event_id string, session_id string, agent_slug string, ts bigint, began bigint"
_SPAN = "a int, b int"
#: Columns of steps; times are microseconds. kind: edit, snapshot, look or commit. seeds: uncommitted ranges, oldest first. base: a look's version in git; credits: whether a look may credit its event.
STEP = (
    f"file string, seq bigint, kind string, {_AUTHOR}, as_of bigint, lines array<struct<hash: bigint, norm: bigint, trivial: boolean>>, spans array<struct<a: int, b: int>>, "
    "seeds array<struct<a: int, b: int, event_id: string, session_id: string, agent_slug: string, ts: bigint>>, commit_id string, committed_at bigint, added array<int>, base array<struct<hash: bigint, norm: bigint, trivial: boolean>>, credits boolean"
)
#: Columns of fold(). by: the commit that counts a line, or the event that takes, credits or reworks it.
LINE = f"kind string, file string, by string, line int, hash bigint, norm bigint, {_AUTHOR}, counted_in array<string>, as_of bigint"


def text_lines(text: Column) -> Column:
    """Array of (hash, norm, trivial) of a text's lines; an end of line at its end begins no other."""
    rows = F.split(text, "\n")
    own = F.when(text == "", F.slice(rows, 1, 0)).when(text.endswith("\n"), F.slice(rows, F.lit(1), F.size(rows) - 1)).otherwise(rows)
    return F.transform(own, prints)


def prints(line: Column) -> Column:
    """What the fold knows of a line."""
    return F.struct(line_hash(line).alias("hash"), norm_hash(line).alias("norm"), is_trivial(line).alias("trivial"))


def as_steps(rows: DataFrame) -> DataFrame:
    """rows with the columns of STEP that they lack, as null, in its order and types."""
    wanted = [x.split(" ", 1) for x in fields(STEP)]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(kind.replace(": ", ":")).alias(n) for n, kind in wanted])


def fields(schema: str) -> list[str]:
    """The fields of a schema's text; commas inside brackets part no fields."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


@dataclass
class FileMap:
    """One file's lines, with their authors (tuples of event_id, session_id, agent_slug, ts, began, or None) and the commits that counted them."""

    hashes: list[int] = field(default_factory=list)
    norms: list[int] = field(default_factory=list)
    owners: list[tuple | None] = field(default_factory=list)
    marks: list[tuple[str, ...]] = field(default_factory=list)
    as_of: int | None = None
    seen: bool = False
    authored: bool = False

    def lined_up(self, lines: list[dict]) -> tuple[FileMap, list[int]]:
        """The map of a newer copy, and which old line each of its lines is."""
        norms = [x["norm"] for x in lines]
        source = carried(self.norms, [o is not None for o in self.owners], norms, [x["trivial"] for x in lines])
        new = FileMap([x["hash"] for x in lines], norms, [self.owners[i] if i >= 0 else None for i in source], [self.marks[i] if i >= 0 else () for i in source], self.as_of, self.seen, self.authored)
        return new, source

    def write(self, at: int, author: tuple) -> None:
        """A line written anew has been counted by no commit."""
        self.owners[at], self.marks[at] = author, ()


def older(held: FileMap, step: dict) -> bool:
    """Whether the map is a later state of the file than the one that the step saw."""
    return held.seen and held.as_of is not None and step["as_of"] is not None and held.as_of > step["as_of"]


def author_of(step: dict) -> tuple:
    return tuple(step[n] for n in ("event_id", "session_id", "agent_slug", "ts", "began"))


def apply_edit(held: FileMap, step: dict) -> tuple[FileMap, list[tuple]]:
    """The map after an edit, and the lines (line, hash, norm, author before) that it took from other events.

    An edit whose copy is older than the map changes no line's place: it claims those of its own lines that are still there,
    but for lines of an event that began later. Without a session it claims nothing.
    """
    author, lines = author_of(step), step["lines"] or []
    own = [n - 1 for s in step["spans"] or () for n in range(max(s["a"], 1), min(s["b"], len(lines)) + 1)] if author[1] is not None else []
    if held.seen and not held.authored:
        held = seeded(held, step["seeds"] or (), author[0])
    if older(held, step):
        place, taken = dict(align([x["norm"] for x in lines], held.norms)) if own else {}, []
        for n in dict.fromkeys(own):
            at = place.get(n)
            if at is None:
                continue
            was = held.owners[at]
            if was and was[4] is not None and author[4] is not None and was[4] > author[4]:
                continue
            if was and was[0] != author[0]:
                taken.append((at + 1, held.hashes[at], held.norms[at], was))
            held.write(at, author)
        return held, taken
    new, _ = held.lined_up(lines)
    new.as_of, new.seen, new.authored = step["as_of"], True, True
    for n in own:
        new.write(n, author)
    return new, []


def seeded(held: FileMap, seeds: Iterable[dict], but: str | None) -> FileMap:
    """A map without authors with those that uncommitted ranges name, the latest where they overlap; `but` is an event that doesn't belong to the old state."""
    for s in seeds:
        if s["session_id"] is not None and s["event_id"] != but:
            for n in range(max(s["a"], 1), min(s["b"], len(held.norms)) + 1):
                held.write(n - 1, (s["event_id"], s["session_id"], s["agent_slug"], s["ts"], None))
    held.authored = True
    return held


def apply_snapshot(held: FileMap, step: dict) -> FileMap:
    """The map after a look at the file that names no author; a copy older than the map changes nothing."""
    if older(held, step):
        return held
    new, _ = held.lined_up(step["lines"] or [])
    new.as_of, new.seen = step["as_of"], True
    return new


def apply_look(held: FileMap, step: dict) -> tuple[FileMap, list[tuple], list[tuple]]:
    """The map after a look, the lines (line, hash, norm) that it credits, and those of the session's that are gone.

    A line is new if it is in neither the map nor the base version. New lines are the look's event's if it may credit, else nobody's.
    """
    if older(held, step):
        return held, [], []
    if held.seen and not held.authored:
        held = seeded(held, step["seeds"] or (), None)
    lines, author = step["lines"] or [], author_of(step)
    new, source = held.lined_up(lines)
    new.as_of, new.seen, new.authored = step["as_of"], True, True
    if not step["credits"] or author[1] is None:
        return new, [], []
    based = {j for _, j in align([x["norm"] for x in step["base"] or ()], new.norms)}
    fresh = [j for j in range(len(lines)) if source[j] < 0 and j not in based]
    for j in fresh:
        new.write(j, author)
    kept = set(source)
    gone = [(i + 1, held.hashes[i], held.norms[i]) for i, o in enumerate(held.owners) if o and o[1] == author[1] and i not in kept]
    return new, [(j + 1, new.hashes[j], new.norms[j]) for j in fresh], gone


def apply_commit(held: FileMap, step: dict) -> list[tuple]:
    """(line, hash, norm, author.., counted_in) of the added lines of a commit that the map knows an author of; they are marked as counted in it.

    An event that began in a later second than the commit's has not written its lines. counted_in has the commits before this one.
    """
    if not held.authored:
        return []
    lined, source = held.lined_up(step["lines"] or [])
    out = []
    for n in step["added"] or ():
        if not 1 <= n <= len(lined.norms) or lined.owners[n - 1] is None:
            continue
        author = lined.owners[n - 1]
        if author[4] is not None and step["committed_at"] is not None and author[4] // 1_000_000 > step["committed_at"] // 1_000_000:
            continue
        before = lined.marks[n - 1]
        out.append((n, lined.hashes[n - 1], lined.norms[n - 1], *author, list(before)))
        at = source[n - 1]
        if step["commit_id"] not in before:
            held.marks[at] = (*before, step["commit_id"])[-MARKS:]
    return out


_KINDS = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    named = [x.split(" ", 1) for x in fields(schema)]
    columns = list(zip(*rows, strict=True)) or [()] * len(named)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, named, strict=True)], names=[n for n, _ in named])


def map_lines(file: str, held: FileMap) -> list[tuple]:
    """The rows of a map, in the columns of fold()."""
    return [("map", file, None, i + 1, h, n, *(o or (None,) * 5), list(m), held.as_of) for i, (h, n, o, m) in enumerate(zip(held.hashes, held.norms, held.owners, held.marks, strict=True))]


def advance(held: FileMap, step: dict) -> tuple[FileMap, list[tuple]]:
    """The map after a step, and what the step does to lines, in the columns of fold()."""
    file, author = step["file"], author_of(step)
    if step["kind"] == "commit":
        return held, [("commit", file, step["commit_id"], *x, None) for x in apply_commit(held, step)]
    if step["kind"] == "snapshot":
        return apply_snapshot(held, step), []
    if step["kind"] == "look":
        held, fresh, gone = apply_look(held, step)
        return held, [(kind, file, author[0], *x, *author, [], None) for kind, lines in (("look", fresh), ("rework", gone)) for x in lines]
    held, taken = apply_edit(held, step)
    return held, [("taken", file, author[0], *x, *was, [], None) for *x, was in taken]


def in_order(steps: DataFrame) -> DataFrame:
    return as_steps(steps.where("file is not null")).repartition("file").sortWithinPartitions("file", "seq", "event_id", "commit_id")


def fold(steps: DataFrame) -> DataFrame:
    """(kind, file, by, line, hash, norm, event_id, session_id, agent_slug, ts, began, counted_in, as_of) over steps (STEP).

    kind map: a line of a file's map after its last step, its author if it has one and the commits that counted it. commit: an added line of the
    commit `by` that has an author, counted_in before it. look: a line credited to a look's event, and rework: one of its session's
    that is gone. taken: a line that the edit `by`, handled late, took from event_id. A file's steps are one chain, so they are in one
    task; it holds the map alone. Steps of the same place in the order follow by event and commit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held = None, FileMap()
        for batch in batches:
            out: list[tuple] = []
            for step in batch.to_pylist():
                if step["file"] != file:
                    out += map_lines(file, held) if file is not None else []
                    file, held = step["file"], FileMap()
                held, made = advance(held, step)
                out += made
            yield _batch(out, LINE)
        if file is not None:
            yield _batch(map_lines(file, held), LINE)

    return in_order(steps).mapInArrow(run, LINE)


def look_gates(looks: DataFrame, oldest_minutes: int = 10, widest_days: int = 14) -> DataFrame:
    """looks (repo_id, event_id, kind shell or prompt, session_id, fired_at, looked_at, moves_content, answered, plain) + credits: whether a look may credit its event.

    Only a shell call's may, of a session, that moved no content, whose branch moved by plain commits alone, that ran soon enough after the call and not too
    long after the look before it in the repository; and there must be one, which git answered. A look that git didn't answer credits nothing.
    """
    order = Window.partitionBy("repo_id").orderBy("looked_at", "event_id")
    before, blind = F.lag("looked_at").over(order), ~F.lag("answered").over(order)
    # After looks that git did not answer, the one before them is the last that saw anything.
    last = F.last(F.when(F.col("answered"), F.col("looked_at")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = lambda a, b: F.unix_micros(a) - F.unix_micros(b)
    timely = (apart(F.col("looked_at"), F.col("fired_at")) <= oldest_minutes * 60_000_000) & (apart(F.col("looked_at"), last) <= widest_days * 86_400_000_000)
    may = (F.col("kind") == "shell") & F.col("session_id").isNotNull() & ~F.col("moves_content") & F.col("plain") & F.col("answered") & before.isNotNull() & ~blind & timely
    return looks.withColumn("credits", F.coalesce(may, F.lit(False)))


def settled_credits(folded: DataFrame) -> DataFrame:
    """(event_id, file, lines_generated, lines_reworked, spans) of looks' events, from fold(): what they were credited less what late edits took back, never below 0.

    spans are the runs of lines that are still the event's in the map; an event that has none left keeps a row with none.
    """
    # The latest of two steps for a line comes last, so signed rows can be summed in any order. One grouping gives it all, so histories are folded once.
    sign = F.when(F.col("kind") == "look", 1).when(F.col("kind") == "taken", -1).otherwise(0)
    sums = folded.where("event_id is not null").groupBy("event_id", "file").agg(
        F.max(F.col("kind") == "look").alias("looked"), F.greatest(F.sum(sign), F.lit(0)).alias("lines_generated"), F.count_if(F.col("kind") == "rework").alias("lines_reworked"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "map", F.col("line")))).alias("own"),
    )
    edge = lambda step: F.filter("own", lambda x, i: F.coalesce(F.when((i + step) >= 0, F.get("own", i + step)) != x + step, F.lit(True)))
    spans = F.zip_with(edge(-1), edge(1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return sums.where("looked").select("event_id", "file", "lines_generated", "lines_reworked", spans.alias("spans"))
