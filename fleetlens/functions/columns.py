"""Column expressions over hook payloads, tools, prompts and lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Camel-case event names of some agents and the names they stand for.
EVENT_ALIASES = {
    "preToolUse": "PreToolUse", "postToolUse": "PostToolUse", "userPromptSubmitted": "UserPromptSubmit", "userPromptSubmit": "UserPromptSubmit",
    "agentStop": "Stop", "sessionEnd": "SessionEnd", "sessionStart": "SessionStart",
}
# Tool names by family; names with the prefix belong to the agent family too.
SHELL_TOOLS = ("Bash", "exec", "shell")
READ_TOOLS = ("Read", "Grep", "Glob", "view_image", "NotebookRead", "LS")
EDIT_FAMILY = ("Edit", "Write", "MultiEdit", "apply_patch", "NotebookEdit")
AGENT_TOOLS = ("Agent", "Task", "TaskOutput", "SubagentHandback", "TaskCreate", "TaskUpdate")
AGENT_PREFIX = "collaboration"
WEB_TOOLS = ("WebSearch", "WebFetch", "webrun")
# Tools whose reports are edits, and one agent's lower-case names for them.
EDIT_TOOLS = ("Edit", "Write", "MultiEdit", "apply_patch")
DEVIN_TOOLS = {"edit": "Edit", "write": "Write", "multiedit": "MultiEdit"}
# Prefixes of text that the harness, not the user, put in as a prompt.
NOISE_PREFIXES = ("<command-name>", "<command-message>", "<local-command-stdout>", "<local-command-stderr>", "<environment_context>", "Caveat: the messages below were generated")
# Git subcommands that bring content into the working tree or move it there.
MOVING_COMMANDS = ("stash pop", "stash apply", "apply", "am", "mv", "checkout", "switch", "restore", "reset", "pull", "merge", "rebase", "cherry-pick", "revert")
# git's name as a program, and its own options that take the next word as their value.
GIT_NAMES, GIT_VALUED = ("git", "git.exe"), ("-C", "-c")


def event_type_col(name: Column) -> Column:
    """Canonical event name."""
    names = F.create_map(*[F.lit(x) for pair in EVENT_ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(names, name), name)


def pick_string(payload: Column, *paths: str) -> Column:
    """The first of the JSON paths that holds a non-empty string (not a number or object)."""
    parsed = F.try_parse_json(payload)
    return F.coalesce(*[F.when(F.schema_of_variant(F.try_variant_get(parsed, p, "variant")) == "STRING", F.nullif(F.try_variant_get(parsed, p, "string"), F.lit(""))) for p in paths])


def json_text(payload: Column, path: str) -> Column:
    return F.get_json_object(payload, path)


def newlines(text: Column) -> Column:
    """Line ends in a text; null has none."""
    return F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0)).cast("long")


def tool_family(tool: Column) -> Column:
    """shell, edit, read, agent, mcp, web or other; the order of the tests matters."""
    return (
        F.when(tool.isin(*SHELL_TOOLS), "shell").when(tool.isin(*EDIT_FAMILY), "edit").when(tool.isin(*READ_TOOLS), "read")
        .when(tool.isin(*AGENT_TOOLS) | tool.startswith(AGENT_PREFIX), "agent").when(tool.startswith("mcp__"), "mcp").when(tool.isin(*WEB_TOOLS), "web").otherwise("other")
    )


def clean_prompt(text: Column) -> Column:
    """Trimmed, without a leading prompt mark; null for text that starts with a noise prefix or is empty."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)^❯\s*", "")
    noise = reduce(lambda a, b: a | b, [bare.startswith(p) for p in NOISE_PREFIXES])
    return F.when(noise | (bare == ""), F.lit(None)).otherwise(bare)


def flatten_content(content: Column) -> Column:
    """A message's content as text: a JSON string as it is, or the text blocks of an array, a line each."""
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    as_string = F.when(content.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), content, F.lit("}")), "$.v"))
    return F.coalesce(as_string, F.when(content.startswith("["), F.array_join(texts, "\n")), F.when(~content.rlike(r'^[\[{"]'), content))


def duration_ms(payload: Column) -> Column:
    """A tool call's milliseconds under either of its names, as a double; null if it is not a number."""
    read = lambda k: F.expr(f"try_cast(get_json_object(payload, '$.{k}') as double)")
    return F.coalesce(read("duration_ms"), read("duration"))


def repo_name(remote: Column, root: Column) -> Column:
    """A repository's name: the last part of its remote without .git, else of its root path."""
    of = lambda c: F.nullif(F.regexp_extract(c, r"([^/:]+?)(?:\.git)?/*$", 1), F.lit(""))
    return F.coalesce(of(remote), of(root))


def line_hash(line: Column) -> Column:
    """Fingerprint of a line, a trailing carriage return ignored."""
    return F.xxhash64(F.regexp_replace(line, "\r$", ""))


def norm_hash(line: Column) -> Column:
    """Fingerprint of a line without any white space."""
    return F.xxhash64(F.regexp_replace(line, r"(?U)\s", ""))


def is_trivial(line: Column) -> Column:
    """A line without a letter or digit."""
    return ~line.rlike(r"[\p{L}\p{Nd}]")


def canonical_tool(agent: Column, tool: Column) -> Column:
    """A tool's name, one agent's lower-case edit tools under their usual names."""
    names = F.create_map(*[F.lit(x) for pair in DEVIN_TOOLS.items() for x in pair])
    return F.when(agent == "devin", F.coalesce(F.element_at(names, F.lower(tool)), tool)).otherwise(tool)


def range_tool(agent: Column, event_type: Column, payload: Column) -> Column:
    """The tool by whose rules an event's ranges are found, or null.

    Edit tools by name, except cursor's, which its file-edit events report already; a file-edit
    event by its shape: several edits, one new string, or a whole content.
    """
    tool = canonical_tool(agent, F.get_json_object(payload, "$.tool_name"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), path, "variant"))
    shape = F.when(kind("$.edits").startswith("ARRAY"), "MultiEdit").when(kind("$.new_string") == "STRING", "Edit").when(kind("$.content") == "STRING", "Write")
    return F.when((event_type == "PostToolUse") & tool.isin(*EDIT_TOOLS) & (agent != "cursor"), tool).when(event_type == "afterFileEdit", shape)


def git_subcommands(command: Column) -> Column:
    """Array of the git subcommands that a shell command runs; a stash with what it does, like 'stash pop'.

    A word whose last path part is git is a call; its own options are skipped, and the next word is the subcommand.
    Quotes, brackets and braces count as blanks, a separator as a word of its own.
    """
    apart = F.regexp_replace(F.regexp_replace(command, "[;&|]", " ; "), "['\"`(){}]", " ")
    words = F.filter(F.split(apart, r"\s+"), lambda w: w != "")
    idle, called, valued, stashing = (F.lit(i) for i in range(4))

    def read(state: Column, word: Column) -> Column:
        at, git = state["at"], F.element_at(F.split(word, r"[/\\]"), -1).isin(*GIT_NAMES)
        option, stash = (at == called) & word.startswith("-"), (at == called) & (word == "stash")
        name = F.when(at == stashing, F.concat(F.lit("stash "), word)).when((at == called) & ~option & ~stash, word)
        after = F.when(option & word.isin(*GIT_VALUED), valued).when(option | (at == valued), called).when(stash, stashing).when(git, called).otherwise(idle)
        return F.struct(after.alias("at"), F.when(name.isNull(), state["names"]).otherwise(F.array_append(state["names"], name)).alias("names"))

    start = F.struct(idle.alias("at"), F.array().cast("array<string>").alias("names"))
    return F.aggregate(words, start, read, lambda state: state["names"])


def moves_content(command: Column) -> Column:
    """Whether a shell command runs a git command that moves content between versions: the subcommand itself, not a word after it."""
    return F.arrays_overlap(git_subcommands(command), F.array(*map(F.lit, MOVING_COMMANDS)))


def commits(command: Column) -> Column:
    return F.array_contains(git_subcommands(command), "commit")
