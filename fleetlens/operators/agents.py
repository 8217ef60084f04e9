"""Payloads of agents that name tools and arguments in their own way, rewritten to one canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COPILOT, PI = "github-copilot", "pi"
# Camel-case keys of one agent's payloads and the keys they stand for.
FIELD_ALIASES = {"hookEventName": "hook_event_name", "sessionId": "session_id", "transcriptPath": "transcript_path", "toolName": "tool_name", "toolArgs": "tool_input", "toolResult": "tool_result"}
# The keys under which arguments come.
PATH_KEYS = ("file_path", "path", "filePath")
OLD_KEYS = ("old_string", "old_str", "oldString")
NEW_KEYS = ("new_string", "new_str", "newString")
CONTENT_KEYS = ("content", "file_text")
# Names of shell tools, and parts of the names of tools whose path is a place to search.
SHELL_NAMES = ("bash", "powershell", "run_in_terminal", "shell")
BROWSE_HINTS = ("list", "dir", "glob", "search", "grep", "find", "memory", "fetch", "web")
# What may stand in a unified patch before its first hunk, and a hunk's head.
PATCH_HEADS = r"^(--- |\+\+\+ |Index: |====)"
HUNK_HEAD = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"

ENTRIES = "map<string,variant>"


def _of(json: Column) -> Column:
    """JSON text of one value as a variant; null if it can't be read."""
    return F.try_parse_json(json)


def _text(value: Column, *keys: str) -> Column:
    """The first of the keys that holds a string, empty ones included; null if none does or value is no object."""
    at = lambda k: F.try_variant_get(value, f"$.{k}", "variant")
    return F.coalesce(*[F.when(F.schema_of_variant(at(k)) == "STRING", F.try_variant_get(value, f"$.{k}", "string")) for k in keys])


def _items(value: Column, key: str) -> Column:
    """The objects of an array under key, as array<variant>; null if there is no array."""
    held = F.try_variant_get(value, f"$.{key}", "variant")
    listed = F.when(F.schema_of_variant(held).startswith("ARRAY"), F.from_json(F.to_json(held), "array<variant>"))
    return F.filter(listed, lambda x: F.schema_of_variant(x).startswith("OBJECT"))


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def _present(value: Column, key: str) -> Column:
    """Whether the key holds anything but null."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant")) != "VOID", F.lit(False))


def _with(value: Column, *pairs: tuple[str, Column], without: tuple[str, ...] = ()) -> Column:
    """The object with keys set to variants; a null variant leaves its key as it was."""
    added = F.map_filter(F.create_map(*[x for key, new in pairs for x in (F.lit(key), new)]), lambda _, new: new.isNotNull())
    gone = F.concat(F.map_keys(added), F.array(*map(F.lit, without)).cast("array<string>"))
    return _of(F.to_json(F.map_concat(F.map_filter(F.from_json(F.to_json(value), ENTRIES), lambda k, _: ~F.array_contains(gone, k)), added)))


def _string(text: Column) -> Column:
    """Text as a variant; null stays null."""
    return F.when(text.isNotNull(), F.try_variant_get(_of(F.to_json(F.struct(text.alias("v")))), "$.v", "variant"))


def _object(**fields: Column) -> Column:
    return _of(F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])))


def _marked(text: Column, mark: str) -> Column:
    """Every line of a text after a mark, each with its line end; an empty text has no lines."""
    body = F.regexp_replace(text, r"\n\z", "")
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit(mark), F.replace(body, F.lit("\n"), F.lit("\n" + mark)), F.lit("\n")))


def _as_patch(files: Column) -> Column:
    """Edits of several files as patch text: a section per file, each edit a hunk of its old lines and its new."""
    hunks = lambda f: F.array_join(F.transform(f["edits"], lambda e: F.concat(F.lit("@@\n"), _marked(e["old_string"], "-"), _marked(e["new_string"], "+"))), "")
    sections = F.transform(files, lambda f: F.concat(F.lit("*** Update File: "), f["file_path"], F.lit("\n"), hunks(f)))
    return F.concat(F.lit("*** Begin Patch\n"), F.array_join(sections, ""), F.lit("*** End Patch\n"))


def _is_patch(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"^\s*\*\*\* Begin Patch"), F.lit(False))


def normalize_copilot(events: DataFrame) -> DataFrame:
    """events (agent_slug, payload, ...) with this agent's payloads in canonical form: snake-case keys, a named event, and the tool told by the shape of its arguments.

    Arguments that come as a JSON string are parsed. A patch becomes apply_patch, a command Bash,
    replacements in one file MultiEdit and in several the text of a patch, old and new text Edit,
    content Write; other tools with a path keep their name and get file_path. The agent's own name of a
    renamed tool stays as copilot_tool_name. Payloads that are null or no JSON object are left alone.
    """
    p = _of(F.when(F.col("agent_slug") == COPILOT, F.col("payload")))
    alias = lambda old, new: F.when(F.try_variant_get(p, f"$.{new}", "variant").isNull(), F.try_variant_get(p, f"$.{old}", "variant"))
    keyed = _with(p, *[(new, alias(old, new)) for old, new in FIELD_ALIASES.items()])
    v = F.col("__p")
    inferred = F.when(_present(v, "tool_result"), "PostToolUse").when(_present(v, "tool_name"), "PreToolUse").when(_present(v, "prompt"), "UserPromptSubmit").when(_present(v, "stop_reason") | _present(v, "stopReason"), "Stop")
    event = F.when(F.try_variant_get(v, "$.hook_event_name", "variant").isNull(), inferred)
    sent = F.try_variant_get(v, "$.tool_input", "variant")
    parsed = _of(F.when(F.ltrim(_text(v, "tool_input")).startswith("{"), _text(v, "tool_input")))
    rows = events.withColumn("__p", F.when(_is_object(p), keyed)).withColumns({"__in": F.coalesce(parsed, sent), "__tool": F.coalesce(_text(v, "tool_name"), F.lit(""))})

    i, tool = F.col("__in"), F.col("__tool")
    path, old, new, content = (_text(i, *keys) for keys in (PATH_KEYS, OLD_KEYS, NEW_KEYS, CONTENT_KEYS))
    edits = F.transform(_items(i, "replacements"), lambda r: F.struct(_text(r, *PATH_KEYS).alias("path"), F.coalesce(_text(r, *OLD_KEYS), F.lit("")).alias("old_string"), F.coalesce(_text(r, *NEW_KEYS), F.lit("")).alias("new_string")))
    placed = F.filter(edits, lambda e: e["path"].isNotNull())
    files = F.transform(
        F.array_distinct(F.transform(placed, lambda e: e["path"])),
        lambda f: F.struct(f.alias("file_path"), F.transform(F.filter(placed, lambda e: e["path"] == f), lambda e: F.struct(e["old_string"].alias("old_string"), e["new_string"].alias("new_string"))).alias("edits")),
    )
    rows = rows.withColumns({"__path": path, "__files": files})
    path, files = F.col("__path"), F.col("__files")
    whole = F.try_variant_get(i, "$", "string")
    bare = F.coalesce(F.schema_of_variant(i) == "STRING", F.lit(False))
    wrapped = _text(i, "input")
    call = lambda name, args: F.struct((F.lit(name) if isinstance(name, str) else name).alias("name"), args.alias("args"))
    browses = F.lower(tool).rlike("|".join(BROWSE_HINTS))
    nothing = F.lit(None).cast("struct<name:string,args:variant>")
    found = (
        F.when(bare, F.when(_is_patch(whole), call("apply_patch", _object(command=whole))))
        .when(~_is_object(i), nothing)
        .when(_is_patch(wrapped), call("apply_patch", _object(command=wrapped)))
        .when(F.lower(tool).isin(*SHELL_NAMES), F.when(_text(i, "command").isNotNull(), call("Bash", i)))
        .when(files.isNotNull(), F.when(F.size(files) == 1, call("MultiEdit", _of(F.to_json(F.get(files, 0))))).when(F.size(files) > 1, call("apply_patch", _object(command=_as_patch(files)))))
        .when(path.isNull() | browses, nothing)
        .when(_present(i, "edits"), call("MultiEdit", _with(i, ("file_path", _string(path)))))
        .when(old.isNotNull() & new.isNotNull(), call("Edit", _object(file_path=path, old_string=old, new_string=new)))
        .when(content.isNotNull() & old.isNull(), call("Write", _object(file_path=path, content=content)))
        .otherwise(call(tool, _with(i, ("file_path", _string(path)))))
    )
    rows = rows.withColumn("__call", found)
    renamed = F.when(F.col("__call.name") != tool, tool)
    done = _with(v, ("hook_event_name", _string(event)), ("tool_input", F.coalesce(F.col("__call.args"), parsed)), ("copilot_tool_name", _string(renamed)), ("tool_name", _string(F.col("__call.name"))))
    return rows.withColumn("payload", F.coalesce(F.to_json(F.when(v.isNotNull(), done)), "payload")).drop("__p", "__in", "__tool", "__path", "__files", "__call")


def patch_hunks(patch: Column) -> Column:
    """A unified patch as array<struct<oldStart,newStart,lines>>; null for one without hunks or with a line that fits nowhere, so none is half used."""
    lines = F.split(F.regexp_replace(patch, r"\n\z", ""), "\n")
    heads = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda n: F.get(lines, n).rlike(HUNK_HEAD))
    start = lambda n, g: F.regexp_extract(F.get(lines, n), HUNK_HEAD, g).cast("bigint")
    hunks = F.transform(heads, lambda n, k: F.struct(start(n, 1).alias("oldStart"), start(n, 2).alias("newStart"), F.slice(lines, n + 2, F.coalesce(F.get(heads, k + 1), F.size(lines)) - n - 1).alias("lines")))
    first = F.get(heads, 0)
    before = F.forall(F.slice(lines, F.lit(1), first), lambda x: x.rlike(PATCH_HEADS))
    after = F.forall(F.slice(lines, first + 1, F.size(lines)), lambda x: x.rlike(HUNK_HEAD) | x.rlike(r"^[ +\-\\]"))
    return F.when((F.size(heads) > 0) & before & after, hunks)


def normalize_pi(events: DataFrame) -> DataFrame:
    """events (agent_slug, cwd, payload, ...) with this agent's payloads in canonical form: edit, write, read and bash become Edit or MultiEdit, Write, Read and Bash.

    The agent's own name stays as pi_tool_name. An edit's unified patch becomes the response's
    structuredPatch; a malformed one is dropped whole. Tools with other arguments are left alone. In a
    path a leading @ goes, and ~ is the home folder that the working folder lies in, where it lies in one.
    """
    p = _of(F.when(F.col("agent_slug") == PI, F.col("payload")))
    v, i, tool = F.col("__p"), F.col("__in"), F.col("__tool")
    rows = events.withColumn("__p", F.when(_is_object(p), p)).withColumns({"__in": F.try_variant_get(v, "$.tool_input", "variant"), "__tool": _text(v, "tool_name")})
    named = F.when(F.trim(_text(i, "path")) != "", F.regexp_replace(_text(i, "path"), "^@", ""))
    home = F.nullif(F.regexp_extract("cwd", r"^(/(?:home|Users)/[^/]+|/root)(?:/|$)", 1), F.lit(""))
    path = F.when(named.rlike("^~(/|$)") & home.isNotNull(), F.concat(home, F.expr("substring(__named, 2)"))).otherwise(F.col("__named"))
    pair = lambda x: F.struct(_text(x, "oldText").alias("old_string"), _text(x, "newText").alias("new_string"))
    listed = F.coalesce(F.transform(_items(i, "edits"), pair), F.array().cast("array<struct<old_string:string,new_string:string>>"))
    edits = F.filter(F.concat(listed, F.array(pair(i))), lambda e: e["old_string"].isNotNull() & e["new_string"].isNotNull())
    rows = rows.withColumn("__named", named).withColumns({"__path": path, "__edits": edits})
    path, edits = F.col("__path"), F.col("__edits")
    call = lambda name, args: F.struct(F.lit(name).alias("name"), args.alias("args"))
    kept = lambda k: F.try_variant_get(i, f"$.{k}", "variant")
    one = F.get(edits, 0)
    found = (
        F.when(~_is_object(i), F.lit(None).cast("struct<name:string,args:variant>"))
        .when(tool == "bash", call("Bash", i))
        .when((tool == "read") & path.isNotNull(), call("Read", _with(_object(file_path=path), ("offset", kept("offset")), ("limit", kept("limit")))))
        .when((tool == "write") & path.isNotNull() & _text(i, "content").isNotNull(), call("Write", _object(file_path=path, content=_text(i, "content"))))
        .when((tool == "edit") & path.isNotNull() & (F.size(edits) == 1), call("Edit", _object(file_path=path, old_string=one["old_string"], new_string=one["new_string"])))
        .when((tool == "edit") & path.isNotNull() & (F.size(edits) > 1), call("MultiEdit", _object(file_path=path, edits=edits)))
    )
    rows = rows.withColumn("__call", found)
    answer = F.try_variant_get(v, "$.tool_response", "variant")
    patch = F.when((tool == "edit") & _is_object(answer), _text(answer, "patch"))
    response = F.when(patch.isNotNull(), _with(answer, ("structuredPatch", _of(F.to_json(patch_hunks(patch)))), without=("patch",)))
    done = _with(v, ("pi_tool_name", _string(tool)), ("tool_name", _string(F.col("__call.name"))), ("tool_input", F.col("__call.args")), ("tool_response", response))
    return rows.withColumn("payload", F.coalesce(F.to_json(F.when(F.col("__call").isNotNull(), done)), "payload")).drop("__p", "__in", "__tool", "__named", "__path", "__edits", "__call")


def normalize_payloads(events: DataFrame) -> DataFrame:
    """events (agent_slug, cwd, payload, ...) with each agent's payloads in canonical form; other agents' are as they were. One pass, no shuffle.

    Write the result before filtering on its payload: a filter that Catalyst pushes below these
    projections repeats their expressions, and planning becomes slow.
    """
    return normalize_pi(normalize_copilot(events))
