"""From hook payloads to event columns: aliases, duplicates, paths, trimming, redaction."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import SHELL_TOOLS, canonical_tool, event_type_col, newlines, pick_string

# Payload keys that hold a tool's output, and the scalar keys of it that are kept.
OUTPUT_KEYS = ("tool_response", "tool_output", "tool_result", "toolResult")
KEPT_TEXT = ("stderr", "result_type")
TEXT_BYTES, STRING_BYTES = 2048, 256 * 1024
#: Bytes of a cut text that are left for its marker; the key under which a trimmed payload counts what was dropped.
MARKER_BYTES, TRIM_KEY = 64, "_trimmed"
# Payload keys that metadata-only export may keep, those of tool_input, and the keys whose value is a list of strings.
ALLOWED = (
    "hook_event_name", "event", "type",
    "session_id", "sessionId", "conversation_id", "generation_id",
    "prompt_id", "turn_id", "tool_use_id",
    "agent_type", "agent_id", "model", "model_id", "cursor_version",
    "permission_mode", "effort", "source", "stop_hook_active", "mcp_server",
    "tool_name", "duration_ms", "duration",
    "cwd", "transcript_path", "transcriptPath", "workspace_roots",
    "scratchpad_dir", "file_path", "file_paths",
    "user_email",
)
ALLOWED_INPUT = ("file_path", "file_paths", "notebook_path", "cwd", "timeout", "replace_all")
LIST_KEYS = ("file_paths", "workspace_roots")


def decode_envelopes(envelopes: DataFrame) -> DataFrame:
    """(id, agent_slug, cwd, ts, payload) of envelopes (agent, cwd, received_at, payload base64): text that isn't JSON as {"raw": text}, a blank payload as null.

    The id is a hash of the envelope, so a replay repeats it. Records whose time can't be read are dropped.
    """
    text = F.unbase64("payload").cast("string")
    rows = envelopes.withColumn("text", text).withColumn("ts", F.try_to_timestamp("received_at")).where("ts is not null")
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    body = F.when(F.try_parse_json(F.col("text")).isNull(), F.to_json(F.struct(F.col("text").alias("raw")))).otherwise(F.col("text"))
    return rows.select(F.sha2(F.concat_ws("\x1f", "agent", "received_at", "text"), 256).alias("id"), F.col("agent").alias("agent_slug"), "cwd", "ts", F.when(~blank, body).alias("payload"))


def name_events(decoded: DataFrame) -> DataFrame:
    """Events of decoded envelopes: id, session_id, ts, event_type, agent_slug, cwd, model, payload. A null payload is a misfire, without session."""
    p = F.col("payload")
    return decoded.select(
        "id", pick_string(p, "$.session_id", "$.sessionId", "$.conversation_id").alias("session_id"), "ts",
        F.when(p.isNull(), "hook_misfire").otherwise(event_type_col(pick_string(p, "$.hook_event_name", "$.hookEventName", "$.event"))).alias("event_type"),
        "agent_slug", F.coalesce(pick_string(p, "$.cwd"), "cwd").alias("cwd"), pick_string(p, "$.model", "$.model_id").alias("model"), "payload",
    )


def parse_envelopes(envelopes: DataFrame) -> DataFrame:
    """Events of envelopes, their payloads as sent (see decode_envelopes and name_events; ingest puts them in canonical form in between)."""
    return name_events(decode_envelopes(envelopes))


def from_copilot(payload: Column) -> Column:
    """Whether a payload is one agent's own, whatever hook delivered it: by its transcript's folder, or by keys that it alone has."""
    path = F.lower(F.replace(F.coalesce(pick_string(payload, "$.transcript_path", "$.transcriptPath"), F.lit("")), F.lit("\\"), F.lit("/")))
    keys = lambda text: F.coalesce(F.map_keys(F.from_json(text, "map<string,variant>")), F.array().cast("array<string>"))
    stored = path.contains("github.copilot-chat/") | (path.contains("/session-state/") & path.endswith("/events.jsonl"))
    named = F.array_contains(keys(payload), "toolArgs") | F.array_contains(keys(F.get_json_object(payload, "$.tool_result")), "text_result_for_llm")
    return stored | named


def drop_cross_delivered(events: DataFrame) -> DataFrame:
    """events without those that another agent's hook delivered a second time."""
    p = F.col("payload")
    cursor = F.coalesce(pick_string(p, "$.cursor_version"), F.lit("")) != ""
    again = (cursor & (F.col("agent_slug") != "cursor")) | (from_copilot(p) & (F.col("agent_slug") != "github-copilot"))
    return events.where(~F.coalesce(again, F.lit(False)))


def resolve_session_ids(events: DataFrame) -> DataFrame:
    """events with session ids told apart: the agent first seen with an id keeps it, others get agent:id."""
    first = F.first("agent_slug").over(Window.partitionBy("session_id").orderBy("ts", "id"))
    return events.withColumn("__first", first).withColumn("session_id", F.when(F.col("session_id").isNull() | (F.col("__first") == F.col("agent_slug")), F.col("session_id")).otherwise(F.concat_ws(":", "agent_slug", "session_id"))).drop("__first")


def resolve_paths(events: DataFrame, repositories: DataFrame) -> DataFrame:
    """events (id, file_path) + repo, rel: the repository with the longest root above the file, and the path below it.

    Roots are few to a file: an equi-join on each of the file's parent folders, not a prefix join.
    """
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    roots = repositories.select(F.regexp_replace("root_path", "/+$", "").alias("__root"), F.col("id").alias("__repo"))
    folders = events.where("file_path is not null").select("id", "file_path", F.explode(above).alias("__root"))
    best = folders.join(roots, "__root").groupBy("id").agg(F.max_by(F.struct("__repo", "__root"), F.length("__root")).alias("b"))
    found = events.join(best, "id", "left")
    return found.withColumns({"repo": F.col("b.__repo"), "rel": F.when(F.col("b").isNotNull(), F.expr("substring(file_path, length(b.__root) + 2)"))}).drop("b")


def strip_prompts(events: DataFrame, agents: tuple[str, ...] = ("claude-code", "codex", "pi")) -> DataFrame:
    """events whose UserPromptSubmit payloads of transcript-backed agents have no prompt key."""
    bare = F.to_json(F.map_filter(F.from_json("payload", "map<string,variant>"), lambda k, _: k != "prompt"))
    return events.withColumn("payload", F.when((F.col("event_type") == "UserPromptSubmit") & F.col("agent_slug").isin(*agents), F.coalesce(bare, "payload")).otherwise(F.col("payload")))


def cut_text(text: str, most: int) -> str:
    """text within `most` UTF-8 bytes, ending in a marker of how many bytes went; the marker has room inside, so cutting again changes nothing."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= most:
        return text
    head = raw[: max(most - MARKER_BYTES, 0)].decode("utf-8", "ignore")
    return f"{head}[...truncated {len(raw) - len(head.encode())} bytes]"


def cut_strings(value):
    """A JSON value whose strings are cut to STRING_BYTES, however deep they lie."""
    if isinstance(value, str):
        return cut_text(value, STRING_BYTES)
    if isinstance(value, dict):
        return {k: cut_strings(v) for k, v in value.items()}
    return [cut_strings(v) for v in value] if isinstance(value, list) else value


def cut_output(value):
    """A tool's output: an object's numbers, booleans, nulls and its status texts, cut to TEXT_BYTES; anything else is null."""
    if not isinstance(value, dict):
        return None
    return {k: cut_text(v, TEXT_BYTES) if isinstance(v, str) else v for k, v in value.items() if v is None or isinstance(v, bool | int | float) or (k in KEPT_TEXT and isinstance(v, str))}


def trimmed(payload: str) -> str:
    """A payload as it is kept: tool outputs reduced, long strings cut, and a mark of the bytes dropped so far; as it came if there is nothing to drop."""
    try:
        held = json.loads(payload) if payload.lstrip().startswith("{") else None
    except ValueError:
        held = None
    if not isinstance(held, dict):
        raw = payload.encode("utf-8", "surrogatepass")
        return payload if len(raw) <= STRING_BYTES else raw[:STRING_BYTES].decode("utf-8", "ignore")
    size = lambda v: len(json.dumps(v, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"))
    dropped, kept = 0, dict(held)
    for key, value in held.items():
        if key == TRIM_KEY:
            continue
        new = cut_output(value) if key in OUTPUT_KEYS else value
        new = cut_strings(new) if size(new) > STRING_BYTES else new
        if new != value:
            kept[key], dropped = new, dropped + max(size(value) - size(new), 0)
    if not dropped:
        return payload
    before = held.get(TRIM_KEY)
    kept[TRIM_KEY] = {"dropped_bytes": dropped + (before.get("dropped_bytes", 0) if isinstance(before, dict) else 0)}
    return json.dumps(kept, ensure_ascii=False, separators=(",", ":"))


def trim_payloads(events: DataFrame) -> DataFrame:
    """events + dropped_bytes, what this call dropped: tool outputs reduced, strings over STRING_BYTES cut; trimming again changes nothing.

    Only payloads that name an output or are long go to Python, in Arrow batches; the rest are untouched.
    """

    @F.arrow_udf("string")
    def trim(payloads: pa.Array) -> pa.Array:
        return pa.array([x if x is None else trimmed(x) for x in payloads.to_pylist()], pa.string())

    due = (F.octet_length("payload") > STRING_BYTES) | F.col("payload").rlike('"(?:' + "|".join(OUTPUT_KEYS) + ')"')
    new = events.where(due).withColumn("__new", trim("payload")).unionByName(events.where(~F.coalesce(due, F.lit(False))).withColumn("__new", F.col("payload")))
    mark = lambda c: F.coalesce(F.get_json_object(c, f"$.{TRIM_KEY}.dropped_bytes").cast("long"), F.lit(0))
    dropped = F.when(mark("__new") > 0, mark("__new") - mark("payload")).otherwise(F.octet_length("payload") - F.octet_length("__new"))
    return new.withColumn("dropped_bytes", dropped.cast("long")).withColumn("payload", F.col("__new")).drop("__new")


def _kept(held: Column, keys: tuple[str, ...]) -> Column:
    """The entries of a map of variants that have an allowed key and a scalar value, or for list keys a list of strings."""
    kind = F.schema_of_variant
    scalar = lambda v: kind(v).isin("STRING", "BOOLEAN", "BIGINT", "DOUBLE", "VOID") | kind(v).startswith("DECIMAL")
    return F.map_filter(held, lambda k, v: k.isin(*keys) & F.when(k.isin(*LIST_KEYS) & kind(v).startswith("ARRAY"), kind(v) == "ARRAY<STRING>").otherwise(scalar(v)))


def redact_events(events: DataFrame) -> DataFrame:
    """events for metadata-only export: allowed keys with allowed values alone, of the payload and of its tool_input, and a mark.

    The line ends of dropped edit text stay as lines_added where that was null. A payload
    that is no JSON object becomes a mark; null stays null.
    """
    entries = "map<string,variant>"
    is_object = F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT")
    inner = F.get_json_object("payload", "$.tool_input")
    has_input = F.coalesce(inner.startswith("{"), F.lit(False))
    parsed = lambda x: F.create_map(F.lit("redacted"), F.parse_json(x))
    tool_input = F.create_map(F.lit("tool_input"), F.parse_json(F.to_json(_kept(F.from_json(inner, entries), ALLOWED_INPUT))))
    own = _kept(F.from_json("payload", entries), ALLOWED)
    kept = F.to_json(F.when(has_input, F.map_concat(own, tool_input, parsed(F.lit("true")))).otherwise(F.map_concat(own, parsed(F.lit("true")))))
    edits = lambda path: F.coalesce(F.array_join(F.from_json(F.get_json_object("payload", path), "array<struct<new_string:string>>")["new_string"], ""), F.lit(""))
    texts = [F.coalesce(F.get_json_object("payload", f"$.{at}{k}"), F.lit("")) for at in ("tool_input.", "") for k in ("new_string", "content")]
    lines = newlines(F.concat(*texts, edits("$.tool_input.edits"), edits("$.edits")))
    marked = F.when(F.coalesce(is_object, F.lit(False)), kept).otherwise(F.lit('{"redacted":true,"raw_dropped":true}'))
    return events.withColumns({"lines_added": F.coalesce("lines_added", F.when(lines > 0, lines)), "payload": F.when(F.coalesce("payload", F.lit("")) != "", marked).otherwise(F.col("payload"))})


def file_path(payload: Column, patched: Column, written: Column) -> Column:
    """The file that an event is about: its input's file_path, the first of its file_paths that is a non-empty string, its own file_path, a patch's first file, a shell command's first target."""
    listed = F.from_json(F.get_json_object(payload, "$.file_paths"), "array<variant>")
    texts = F.filter(listed, lambda v: (F.schema_of_variant(v) == "STRING") & (F.try_variant_get(v, "$", "string") != ""))
    first = F.try_variant_get(F.get(texts, 0), "$", "string")
    return F.coalesce(pick_string(payload, "$.tool_input.file_path"), first, pick_string(payload, "$.file_path"), patched, written)


def with_file_path(events: DataFrame) -> DataFrame:
    """events (id, agent_slug, payload, ...) with file_path found in the payload where it was null, and the canonical tool name as tool."""
    command = F.get_json_object("payload", "$.tool_input.command")
    patch = F.coalesce(F.get_json_object("payload", "$.tool_input.patch"), command)
    patched = F.nullif(F.regexp_extract(patch, r"(?m)^\*\*\* (?:Add|Update) File: (.*?)\s*$", 1), F.lit(""))
    tool = canonical_tool(F.col("agent_slug"), F.get_json_object("payload", "$.tool_name"))
    shell = F.when(tool.isin(*SHELL_TOOLS), F.get(shell_targets(command), 0))
    return events.withColumns({"tool": tool, "file_path": F.coalesce("file_path", file_path(F.col("payload"), patched, shell))})


def redact(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables for metadata-only export: prompts lose their text but keep its length, commits their message."""
    out = dict(tables)
    if "events" in out:
        out["events"] = redact_events(out["events"])
    if "session_prompts" in out:
        out["session_prompts"] = out["session_prompts"].withColumn("prompt_chars", F.length("prompt_text")).withColumn("prompt_text", F.lit(""))
    if "commits" in out and "message" in out["commits"].columns:
        out["commits"] = out["commits"].withColumn("message", F.lit(None).cast("string"))
    return out


def patch_files(patches: DataFrame) -> DataFrame:
    """(event_id, file_path, added, removed) from apply_patch texts (event_id, command): sections of one file are one row, a move counts for its new name, deletions for none."""
    lines = patches.select("event_id", F.posexplode(F.split("command", "\n")).alias("n", "line"))
    opened = F.when(F.col("line").rlike(r"^\*\*\* (?:Add|Update) File: "), F.regexp_extract("line", r"^\*\*\* (?:Add|Update) File: (.*?)\s*$", 1)).when(F.col("line").rlike(r"^\*\*\* (?:Delete File|End Patch)"), F.lit(""))
    moved = F.regexp_extract("line", r"^\*\*\* Move to: (.*?)\s*$", 1)
    order = Window.partitionBy("event_id").orderBy("n")
    section = F.sum(opened.isNotNull().cast("int")).over(order)
    inside = Window.partitionBy("event_id", "section")
    named = lines.withColumns({"opened": opened, "section": section}).withColumn("file_path", F.coalesce(F.max(F.nullif(moved, F.lit(""))).over(inside), F.max("opened").over(inside)))
    return named.where("file_path <> ''").groupBy("event_id", "file_path").agg(F.count_if(F.col("line").startswith("+")).alias("added"), F.count_if(F.col("line").startswith("-")).alias("removed"))


def shell_targets(command: Column) -> Column:
    """Array of the files that a shell command writes by redirection, tee or sed -i; devices, descriptors and names with shell metacharacters don't count."""
    found = F.flatten(F.array(
        F.regexp_extract_all(command, F.lit(r"(?<![0-9<>&-])(?:[12&]?>>?)\s*([^\s;|&<>()'\"]+)"), 1),
        F.regexp_extract_all(command, F.lit(r"\btee\s+(?:-a\s+)?([^\s;|&<>()'\"-][^\s;|&<>()'\"]*)"), 1),
        F.regexp_extract_all(command, F.lit(r"\bsed\s+-i\S*\s+(?:'[^']*'|\"[^\"]*\"|\S+)\s+([^\s;|&<>()'\"]+)"), 1),
    ))
    return F.filter(F.array_distinct(found), lambda p: ~p.rlike(r"^/dev/|[$`*?~]"))


def shell_writes(commands: DataFrame) -> DataFrame:
    """(event_id, file_path): files that shell commands (event_id, command) write."""
    return commands.select("event_id", F.explode(shell_targets(F.col("command"))).alias("file_path"))
