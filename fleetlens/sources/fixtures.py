"""The supplied test tables, projected into the telemetry's shape.

The rules are integer arithmetic and string building only, so the same SQL text with a few
function names exchanged runs on Spark and as the base of the DuckDB oracles.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

T0, WINDOW = 1704067200000000, 345600000000

#: Function names by dialect.
SPARK = {"us": "unix_micros(cast({} as timestamp))", "ts": "timestamp_micros({})", "k": "cast(get_json_object(props, '$.k') as bigint)", "div": "div", "nl": "concat(char(92), 'n')"}
DUCK = {"us": "epoch_us({})", "ts": "make_timestamp({})", "k": "cast(json_extract_string(props, '$.k') as bigint)", "div": "//", "nl": "concat(chr(92), 'n')"}


def statements(d: dict[str, str]) -> dict[str, str]:
    """Table name -> SELECT over the supplied tables and the tables before it."""
    div, ts = d["div"], d["ts"]
    return {
        "raw": f"""
SELECT event_id, user_id, w, k, value, event_type AS et, 's' || user_id || '_' || w AS sid, 'r' || (user_id % 10) AS repo_id,
  {T0} + w * {WINDOW} + (user_id % 4) * 86400000000 + (user_id % 24) * 3600000000 + (off - w * {WINDOW}) {div} 96 AS us,
  CASE user_id % 5 WHEN 0 THEN 'claude-code' WHEN 1 THEN 'cursor' WHEN 2 THEN 'codex' WHEN 3 THEN 'github-copilot' ELSE 'pi' END AS agent_slug,
  CASE user_id % 3 WHEN 0 THEN 'm0' WHEN 1 THEN 'm1' END AS model,
  'src/f' || (k % 25) || '.py' AS rel
FROM (SELECT *, {d['k']} AS k, {d['us'].format('ts')} - {T0} AS off, ({d['us'].format('ts')} - {T0}) {div} {WINDOW} AS w FROM __events) x""",
        "kinds": """
SELECT *, CASE WHEN et = 'signup' THEN 'Stop' WHEN et = 'purchase' AND agent_slug = 'cursor' THEN 'afterFileEdit'
    WHEN et = 'error' AND event_id % 4 = 0 THEN 'hook_misfire' ELSE 'PostToolUse' END AS kind,
  CASE WHEN et = 'click' THEN 'Edit' WHEN et = 'purchase' AND agent_slug <> 'cursor' THEN 'Write'
    WHEN et = 'view' AND event_id % 23 = 5 THEN NULL WHEN et = 'view' THEN CASE event_id % 20 WHEN 0 THEN 'Grep' WHEN 1 THEN 'Glob' WHEN 2 THEN 'view_image' WHEN 3 THEN 'NotebookRead' WHEN 4 THEN 'LS' WHEN 5 THEN 'exec' WHEN 6 THEN 'shell' WHEN 7 THEN 'NotebookEdit'
      WHEN 8 THEN 'Agent' WHEN 9 THEN 'Task' WHEN 10 THEN 'TaskOutput' WHEN 11 THEN 'SubagentHandback' WHEN 12 THEN 'TaskCreate' WHEN 13 THEN 'TaskUpdate' WHEN 14 THEN 'collaboration_ask' WHEN 15 THEN 'WebSearch' WHEN 16 THEN 'webrun'
      WHEN 17 THEN 'Read' WHEN 18 THEN 'Bash' ELSE 'mcp__docs__get' END
    WHEN et = 'error' AND event_id % 4 <> 0 THEN 'WebFetch' END AS tool,
  et IN ('click', 'purchase') AS is_edit, 0 AS dup FROM raw""",
        "spread": """
SELECT * FROM kinds
UNION ALL SELECT event_id, user_id, w, k, value, et, sid, repo_id, us + 2000000, agent_slug, model, rel, 'PostToolUse', 'Write', is_edit, 1 FROM kinds WHERE kind = 'afterFileEdit'
UNION ALL SELECT event_id, user_id, w, k, value, et, sid, repo_id, us + 9000000, agent_slug, model, rel, 'PostToolUse', 'Write', is_edit, 2 FROM kinds WHERE kind = 'afterFileEdit' AND event_id % 5 = 0""",
        "events": f"""
SELECT CASE WHEN dup = 0 THEN 'e' || event_id ELSE 'e' || event_id || '_' || dup END AS id,
  CASE WHEN kind <> 'hook_misfire' AND event_id % 29 <> 7 THEN sid END AS session_id, {ts.format('us')} AS ts, kind AS event_type, agent_slug,
  CASE WHEN is_edit THEN '/w/' || repo_id || '/' || rel END AS file_path, CASE WHEN kind <> 'hook_misfire' THEN repo_id END AS repo_id,
  CASE WHEN is_edit AND event_id % 31 <> 3 THEN rel END AS rel_file_path,
  CASE WHEN is_edit THEN k % 20 END AS lines_added,
  CASE WHEN is_edit AND dup = 0 AND event_id % 3 <> 0 THEN k % 20 END AS lines_generated,
  CASE WHEN is_edit AND dup = 0 AND event_id % 3 <> 0 THEN CASE WHEN event_id % 7 = 0 THEN k % 5 ELSE 0 END END AS lines_reworked,
  CASE WHEN kind = 'hook_misfire' THEN NULL ELSE concat('{{',
    CASE WHEN tool IS NOT NULL THEN concat('"tool_name":"', tool, '",') ELSE '' END,
    CASE WHEN model IS NOT NULL THEN concat('"model":"', model, '",') ELSE '' END,
    CASE WHEN agent_slug = 'codex' THEN '' WHEN agent_slug = 'cursor' THEN concat('"duration":', cast(floor(value * 1000) AS bigint), ',') ELSE concat('"duration_ms":', cast(floor(value * 1000) AS bigint), ',') END,
    CASE WHEN kind = 'Stop' THEN concat('"last_assistant_message":"done ', event_id, '","effort":{{"level":"high"}},"permission_mode":"default",') ELSE '' END,
    '"tool_input":{{', CASE WHEN is_edit THEN concat('"', CASE WHEN tool = 'Edit' THEN 'new_string' ELSE 'content' END, '":"', repeat({d['nl']}, cast(k % 20 AS int)), '"') ELSE '' END, '}}}}') END AS payload
FROM spread""",
        "ranges": """
SELECT 'g' || event_id AS id, 'e' || event_id AS event_id, CASE WHEN event_id % 37 <> 4 THEN rel END AS rel_file_path, '/w/' || repo_id || '/' || rel AS file_path,
  cast(1 + k AS bigint) AS start_line, cast(1 + k + k % 20 AS bigint) AS end_line FROM kinds WHERE event_id % 2 = 0 AND (is_edit OR tool IN ('Bash', 'exec', 'shell'))
UNION ALL SELECT 'h' || event_id, 'e' || event_id, 'src/g' || (k % 25) || '.py', '/w/' || repo_id || '/src/g' || (k % 25) || '.py', cast(2 AS bigint), cast(2 + k % 3 AS bigint) FROM kinds WHERE is_edit AND event_id % 10 = 4""",
        "sessions": f"""
SELECT sid AS id, min(agent_slug) AS agent_slug, min(model) AS model_slug, min(repo_id) AS repo_id,
  CASE WHEN min(user_id) % 11 <> 0 THEN 'dev' || (min(user_id) % 20) END AS engineer_email, CASE WHEN min(user_id) % 11 <> 0 THEN 'Dev ' || (min(user_id) % 20) END AS engineer_name,
  {ts.format('min(us)')} AS started_at, CASE WHEN min(user_id) % 7 <> 0 THEN {ts.format('max(us)')} END AS ended_at,
  CASE WHEN min(agent_slug) <> 'cursor' THEN count(*) * 100 END AS input_tokens, CASE WHEN min(agent_slug) <> 'cursor' THEN count(*) * 10 END AS output_tokens,
  CASE WHEN min(agent_slug) <> 'cursor' THEN count(*) * 7 END AS cache_read_tokens, CASE WHEN min(agent_slug) <> 'cursor' THEN count(*) * 3 END AS cache_creation_tokens
FROM kinds WHERE kind <> 'hook_misfire' GROUP BY sid""",
        "repositories": """
SELECT repo_id AS id, '/w/' || repo_id AS root_path, CASE WHEN k % 3 <> 0 THEN 'git@host:org/p' || (k % 4) || '.git' END AS remote_url, 'repo' || k AS name
FROM (SELECT DISTINCT repo_id, user_id % 10 AS k FROM raw) x""",
        "commit_files": """
SELECT 'c' || o AS commit_id, 'src/f' || p || '.py' AS file_path, CASE WHEN (o + p) % 10 = 0 THEN 0 ELSE q END AS lines_added, ln AS lines_removed
FROM (SELECT l_orderkey AS o, l_partkey % 25 AS p, cast(sum(l_quantity) AS bigint) AS q, cast(sum(l_linenumber) AS bigint) AS ln FROM __lineitem GROUP BY l_orderkey, l_partkey % 25) x""",
        "commits": f"""
SELECT 'c' || o_orderkey AS id, 'r' || (o_custkey % 10) AS repo_id, 'sha' || o_orderkey AS sha, 'dev' || (o_custkey % 20) AS author_email, 'Dev ' || (o_custkey % 20) AS author_name,
  {ts.format(f'{T0} + ((o_orderkey * 7919) % 2592000) * 1000000')} AS committed_at, coalesce(la, 0) AS lines_added, coalesce(lr, 0) AS lines_removed, coalesce(n, 0) AS files_changed
FROM __orders LEFT JOIN (SELECT commit_id, cast(sum(lines_added) AS bigint) AS la, cast(sum(lines_removed) AS bigint) AS lr, count(*) AS n FROM commit_files GROUP BY commit_id) f ON f.commit_id = 'c' || o_orderkey""",
        "numbered": "SELECT id AS session_id, agent_slug, model_slug, started_at, row_number() OVER (ORDER BY id) - 1 AS no FROM sessions",
        "many": "SELECT count(*) AS many FROM sessions",
        "picked": "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_partkey % many AS pick FROM __lineitem CROSS JOIN many",
        "asked": "SELECT conv_id, turn, text, conv_id % many AS pick FROM __conversations CROSS JOIN many WHERE role = 'user'",
        "commit_sessions": f"""
SELECT 'c' || l_orderkey AS commit_id, session_id, min(agent_slug) AS agent_slug, min(model_slug) AS model_slug, count(*) AS event_count,
  cast(sum(CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_quantity END) AS bigint) AS lines_attributed, {ts.format(d['us'].format('min(started_at)') + ' + cast(sum(l_linenumber) as bigint) * 600000000')} AS last_event_ts
FROM picked JOIN numbered ON no = pick GROUP BY l_orderkey, session_id""",
        "commit_session_files": """
SELECT 'c' || l_orderkey AS commit_id, session_id, 'src/f' || (l_partkey % 25) || '.py' AS file_path, cast(sum(CASE WHEN l_linenumber % 4 = 0 THEN 0 ELSE l_quantity END) AS bigint) AS lines_attributed
FROM picked JOIN numbered ON no = pick GROUP BY l_orderkey, session_id, l_partkey % 25""",
        "prompts": f"""
SELECT session_id, cast(row_number() OVER (PARTITION BY session_id ORDER BY conv_id, turn) AS bigint) AS seq,
  {ts.format(d['us'].format('started_at') + ' + cast(turn AS bigint) * 90000000')} AS ts, agent_slug, text AS prompt_text
FROM asked JOIN numbered ON no = pick""",
    }


@dataclass(frozen=True)
class Tables:
    """The telemetry tables that metrics work on; each a DataFrame."""

    sessions: DataFrame
    events: DataFrame
    ranges: DataFrame
    commits: DataFrame
    commit_files: DataFrame
    commit_sessions: DataFrame
    prompts: DataFrame
    repositories: DataFrame
    extra: dict = field(default_factory=dict)

    def having(self, **tables: DataFrame) -> Tables:
        return replace(self, **tables)


def load(spark: SparkSession, sf_dir: str) -> Tables:
    """The projection of the tables in sf_dir."""
    made = {f"__{t}": spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "orders", "lineitem", "conversations")}
    for name, text in statements(SPARK).items():
        if name == "numbered":
            made[name] = _numbered(made["sessions"])
            continue
        if name in ("commit_sessions", "commit_session_files"):
            made[name] = _credited(made["picked"], made["numbered"], files=name == "commit_session_files")
            continue
        text = text.replace("{", "{{").replace("}", "}}")
        for known in made:
            text = _named(text, known, "{" + known + "}")
        made[name] = spark.sql(text, **{k: v for k, v in made.items() if re.search(rf"(?<!{{){{{k}}}", text)})
    return Tables(**{k: made[k] for k in ("sessions", "events", "ranges", "commits", "commit_files", "commit_sessions", "prompts", "repositories")}, extra={"commit_session_files": made["commit_session_files"]})


def _numbered(sessions: DataFrame) -> DataFrame:
    """Sessions with their rank by id from 0. Ranked within the first four characters of the id (s and up to three digits or _, so a few thousand groups), whose sizes give the rest."""
    held = sessions.select(F.col("id").alias("session_id"), "agent_slug", "model_slug", "started_at", F.substring("id", 1, 4).alias("head"))
    before = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.groupBy("head").agg(F.count(F.lit(1)).alias("n")).select("head", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("head").orderBy("session_id"))
    return held.withColumn("place", place).join(F.broadcast(bases), "head").withColumn("no", F.col("base") + F.col("place") - 1).drop("head", "base", "place")


def _credited(picked: DataFrame, numbered: DataFrame, files: bool) -> DataFrame:
    """commit_sessions, or commit_session_files with files. A session is one number, so line items are summed by numbers alone, before the sessions' texts join them."""
    path = [F.concat(F.lit("src/f"), F.col("p").cast("string"), F.lit(".py")).alias("file_path")] if files else []
    slim = picked.select("l_orderkey", "pick", *[(F.col("l_partkey") % 25).alias("p")] * files, "l_linenumber", F.when(F.col("l_linenumber") % 4 == 0, F.lit(0)).otherwise(F.col("l_quantity")).alias("q"))
    sums = slim.groupBy("l_orderkey", "pick", *["p"] * files).agg(F.count(F.lit(1)).alias("event_count"), F.sum("q").cast("bigint").alias("lines_attributed"), F.sum("l_linenumber").alias("numbers"))
    key = F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("commit_id")
    rows = sums.join(numbered, F.col("no") == F.col("pick"))
    if files:
        return rows.select(key, "session_id", *path, "lines_attributed")
    last = F.timestamp_micros(F.unix_micros(F.col("started_at").cast("timestamp")) + F.col("numbers") * 600_000_000).alias("last_event_ts")
    return rows.select(key, "session_id", "agent_slug", "model_slug", "event_count", "lines_attributed", last)


def _named(text: str, table: str, by: str) -> str:
    return re.sub(rf"(FROM|JOIN) {table}\b", rf"\1 {by}", text)


def duck_base() -> str:
    """WITH clause that defines the same tables for DuckDB; a SELECT (or ", name AS (...) SELECT") follows."""
    parts = []
    for name, text in statements(DUCK).items():
        parts.append(f"{_OWN.get(name, name)} AS ({re.sub(r'(FROM|JOIN) __', r'\1 ', _own(text))})")
    return "WITH " + ",\n".join(parts)


#: DuckDB views of these names exist, so the projected table goes by another.
_OWN = {"events": "ev"}


def _own(text: str) -> str:
    return _named(text, "events", "ev")
