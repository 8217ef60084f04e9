"""Text that git prints, as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parse_commit_log(lines: DataFrame) -> DataFrame:
    """(sha, parent_sha, author_email, author_name, committed_at, message) from lines (value) of six fields parted by the unit separator; missing fields are null, of several parents the first counts."""
    f = F.split("value", "\x1f", 6)
    some = lambda i: F.nullif(F.get(f, i), F.lit(""))
    return lines.where("value <> ''").select(some(0).alias("sha"), F.split(some(1), " ")[0].alias("parent_sha"), some(2).alias("author_email"), some(3).alias("author_name"), F.try_to_timestamp(some(4)).alias("committed_at"), some(5).alias("message"))


def parse_numstat(lines: DataFrame) -> DataFrame:
    """(commit_id, file_path, lines_added, lines_removed) from numstat lines (commit_id, value); a binary file's dashes count 0."""
    f = F.split("value", "\t", 3)
    n = lambda i: F.coalesce(F.get(f, i).try_cast("bigint"), F.lit(0))
    return lines.where(F.size(f) == 3).select("commit_id", F.get(f, 2).alias("file_path"), n(0).alias("lines_added"), n(1).alias("lines_removed"))


def commit_totals_of(files: DataFrame) -> DataFrame:
    return files.groupBy("commit_id").agg(F.sum("lines_added").alias("lines_added"), F.sum("lines_removed").alias("lines_removed"), F.count(F.lit(1)).alias("files_changed"))


_HUNK = re.compile(r"@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _added(diff: str) -> Iterator[tuple[str, int, str]]:
    """(path, number of the first, text with its marks) of each run of added lines."""
    lines = diff.split("\n")
    path, old, new, at, i = None, 0, 0, 0, 0
    while i < len(lines):
        line, step = lines[i], 1
        if old > 0 or new > 0:  # inside a hunk everything is content, whatever it looks like
            mark = line[:1]
            if mark == "+":
                end = len(lines) if old > 0 else min(len(lines), i + new)
                while i + step < end and lines[i + step].startswith("+"):
                    step += 1
                if path:
                    yield path, at, "\n".join(lines[i:i + step])
                at, new = at + step, new - step
            elif mark == "-":
                old -= 1
            elif mark != "\\":
                at, old, new = at + 1, old - 1, new - 1
        elif line.startswith("+++ "):
            name = line[4:].split("\t")[0]
            path = name[2:] if name.startswith("b/") else None  # /dev/null and quoted names are skipped
        elif m := _HUNK.match(line):
            old, at, new = int(m[1] or 1), int(m[2]), int(m[3] or 1)
        i += step


def parse_unified_diff(diffs: DataFrame) -> DataFrame:
    """(commit_id, file_path, line_no, text): added lines of diffs (commit_id, diff), numbered from the hunk headers. Python finds runs of added lines; Spark parts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, *x) for c, d in zip(batch.column("commit_id").to_pylist(), batch.column("diff").to_pylist(), strict=True) for x in _added(d or "")]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["commit_id", "file_path", "at", "run"])

    runs = diffs.select("commit_id", "diff").mapInArrow(run, "commit_id string, file_path string, at long, run string")
    lines = runs.select("commit_id", "file_path", "at", F.posexplode(F.split("run", "\n")).alias("n", "marked"))
    return lines.select("commit_id", "file_path", (F.col("at") + F.col("n")).alias("line_no"), F.expr("substring(marked, 2)").alias("text"))


def parse_blame(lines: DataFrame) -> DataFrame:
    """(file_path, final_line, sha, orig_line, content, author) from porcelain lines (file_path, n, value); a commit's author stands only at its first mention."""
    head = F.regexp_extract("value", r"^([0-9a-f]{40}) (\d+) (\d+)", 0) != ""
    order = Window.partitionBy("file_path").orderBy("n")
    fields = F.split("value", " ")
    cut = lines.withColumn("h", F.when(head & ~F.col("value").startswith("\t"), F.struct(fields[0].alias("sha"), fields[1].cast("long").alias("orig_line"), fields[2].cast("long").alias("final_line"))))
    filled = cut.withColumn("h", F.last("h", True).over(order))
    authors = filled.where(F.col("value").startswith("author ")).groupBy("h.sha").agg(F.first(F.expr("substring(value, 8)")).alias("author"))
    content = filled.where(F.col("value").startswith("\t")).select("file_path", "h.final_line", "h.sha", "h.orig_line", F.expr("substring(value, 2)").alias("content"))
    return content.join(authors, "sha", "left").select("file_path", "final_line", "sha", "orig_line", "content", "author")


_NOTE = "v int, commit string, files map<string, array<struct<lines:string,agent:string,session:string,model:string,ts:string>>>"


def build_notes(runs: DataFrame) -> DataFrame:
    """(commit_id, note): a commit's note, JSON of v, commit and files: for each path its runs of lines like 3-9, in order, with agent, session, model and ts.

    runs: (commit_id, file_path, start_line, end_line, agent, session, model, ts, exact). v is 2 if all of a commit's runs are exact, 1 if a file was matched
    by position. Missing values are left out; a commit without runs has no note.
    """
    lines = F.when(F.col("start_line") == F.col("end_line"), F.col("start_line").cast("string")).otherwise(F.concat_ws("-", F.col("start_line").cast("string"), F.col("end_line").cast("string")))
    entry = F.struct("start_line", "end_line", lines.alias("lines"), "agent", "session", "model", F.col("ts").cast("string").alias("ts"))
    per_file = runs.groupBy("commit_id", "file_path").agg(F.array_sort(F.collect_list(entry)).alias("e"), F.min(F.coalesce("exact", F.lit(False)).cast("int")).alias("exact"))
    plain = F.transform("e", lambda x: F.struct(x["lines"].alias("lines"), x["agent"].alias("agent"), x["session"].alias("session"), x["model"].alias("model"), x["ts"].alias("ts")))
    files = per_file.groupBy("commit_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("file_path", plain.alias("e"))))).alias("files"), (F.min("exact") + 1).alias("v"))
    return files.select("commit_id", F.to_json(F.struct("v", F.col("commit_id").alias("commit"), "files")).alias("note"))


def read_notes(notes: DataFrame) -> DataFrame:
    """(commit_id, v, file_path, start_line, end_line, agent, session, model, ts) of notes of either version; what isn't JSON, or names no line or lines, gives no rows."""
    rows = notes.select(F.from_json("note", _NOTE).alias("x")).select(F.col("x.commit").alias("commit_id"), "x.v", F.explode("x.files").alias("file_path", "e")).select("commit_id", "v", "file_path", F.inline("e"))
    ends = F.split("lines", "-")
    spans = rows.where(F.col("lines").rlike(r"^\d+(-\d+)?$")).withColumns({"start_line": F.get(ends, 0).cast("long"), "end_line": F.coalesce(F.get(ends, 1), F.get(ends, 0)).cast("long")})
    return spans.select("commit_id", "v", "file_path", "start_line", "end_line", "agent", "session", "model", "ts")
