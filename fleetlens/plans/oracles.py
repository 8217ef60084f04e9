"""DuckDB SQL for the metric queries, over the same projection of the supplied tables."""

from __future__ import annotations

from ..sources.fixtures import duck_base

EDITS = """,
rl AS (SELECT event_id, CAST(sum(greatest(end_line - start_line + 1, 0)) AS BIGINT) AS range_lines FROM ranges GROUP BY event_id),
cand AS (SELECT e.*, json_extract_string(payload, '$.tool_name') AS tool, range_lines FROM ev e LEFT JOIN rl ON rl.event_id = e.id),
kept AS (SELECT * FROM cand c WHERE (event_type = 'afterFileEdit' OR (event_type = 'PostToolUse' AND (tool IN ('Edit', 'Write', 'MultiEdit', 'apply_patch') OR range_lines IS NOT NULL OR coalesce(lines_generated, 0) > 0 OR coalesce(lines_reworked, 0) > 0)))
  AND NOT (agent_slug = 'cursor' AND event_type = 'PostToolUse' AND EXISTS (SELECT 1 FROM ev a WHERE a.agent_slug = 'cursor' AND a.event_type = 'afterFileEdit' AND a.file_path = c.file_path
    AND a.session_id IS NOT DISTINCT FROM c.session_id AND abs(epoch_us(a.ts) - epoch_us(c.ts)) <= 5000000))),
counted AS (SELECT *, coalesce(lines_generated, CASE WHEN range_lines > 0 THEN range_lines WHEN tool = 'apply_patch' THEN coalesce(lines_added, 0)
    ELSE coalesce(len(json_extract_string(payload, '$.tool_input.new_string')) - len(replace(json_extract_string(payload, '$.tool_input.new_string'), chr(10), '')), 0)
       + coalesce(len(json_extract_string(payload, '$.tool_input.content')) - len(replace(json_extract_string(payload, '$.tool_input.content'), chr(10), '')), 0) END) AS written,
  CASE WHEN lines_generated IS NOT NULL THEN coalesce(lines_reworked, 0) ELSE 0 END AS replaced FROM kept),
edits AS (SELECT k.id, k.session_id, k.ts, k.agent_slug, coalesce(s.model_slug, json_extract_string(k.payload, '$.model'), 'unknown') AS model, k.repo_id, k.file_path, k.rel_file_path, s.engineer_email,
  CAST(written - replaced AS BIGINT) AS lines, CAST(written AS BIGINT) AS lines_written, CAST(replaced AS BIGINT) AS lines_replaced FROM counted k LEFT JOIN sessions s ON s.id = k.session_id)
"""
GAPS = """,
gaps AS (SELECT session_id, id, ts, least(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY ts, id), CASE WHEN lag(ts) OVER (PARTITION BY session_id ORDER BY ts, id) IS NULL THEN NULL ELSE 300000000 END) AS gap FROM ev WHERE session_id IS NOT NULL)
"""
CALLS = """,
named AS (SELECT *, json_extract_string(payload, '$.tool_name') AS tool, coalesce(TRY_CAST(json_extract_string(payload, '$.duration_ms') AS DOUBLE), TRY_CAST(json_extract_string(payload, '$.duration') AS DOUBLE)) AS ms FROM ev WHERE event_type = 'PostToolUse' AND payload IS NOT NULL),
calls AS (SELECT *, CASE WHEN tool IN ('Bash', 'exec', 'shell') THEN 'shell' WHEN tool IN ('Edit', 'Write', 'NotebookEdit') THEN 'edit' WHEN tool IN ('Read', 'Grep', 'Glob', 'view_image', 'NotebookRead', 'LS') THEN 'read'
  WHEN regexp_matches(tool, '^(Agent|Task|TaskOutput|SubagentHandback|TaskCreate|TaskUpdate)$|^collaboration') THEN 'agent' WHEN starts_with(tool, 'mcp__') THEN 'mcp' WHEN tool IN ('WebFetch', 'WebSearch', 'webrun') THEN 'web' ELSE 'other' END AS family FROM named)
"""
LANDED = """,
landed AS (SELECT cs.*, c.repo_id, c.committed_at FROM commit_sessions cs JOIN commits c ON c.id = cs.commit_id)
"""
BASE = duck_base()


def _breakdown(column: str, key_of_committed: str, extra: str = "") -> str:
    null = "" if column == "repo_id" else f"WHERE {column} IS NOT NULL"
    return BASE + EDITS + LANDED + f""",
m AS (SELECT {column} AS key, count(*) AS edits, CAST(sum(lines) AS BIGINT) AS generated, count(DISTINCT session_id) AS sessions FROM edits {null} GROUP BY 1),
c AS (SELECT {key_of_committed} AS key, CAST(sum(lines_attributed) AS BIGINT) AS committed FROM landed l {extra} WHERE EXISTS (SELECT 1 FROM edits e WHERE e.session_id = l.session_id AND e.repo_id = l.repo_id) GROUP BY 1),
t AS (SELECT key, model FROM (SELECT {column} AS key, model, row_number() OVER (PARTITION BY {column} ORDER BY count(*) DESC, model) AS r FROM edits GROUP BY 1, 2) x WHERE r = 1 AND key IS NOT NULL)
SELECT coalesce(m.key, '(no repo)') AS key, edits, generated, sessions, coalesce(committed, 0) AS committed, t.model AS top_model FROM m LEFT JOIN c ON c.key = m.key LEFT JOIN t ON t.key = m.key"""


SQL: dict[str, str] = {
    "ai_edits_scored": BASE + EDITS + "SELECT * FROM edits",
    "overview": BASE + EDITS + LANDED + """SELECT count(*) AS edits, CAST(sum(lines) AS BIGINT) AS generated, CAST(sum(lines_replaced) AS BIGINT) AS replaced, count(DISTINCT session_id) AS sessions,
(SELECT CAST(sum(lines_attributed) AS BIGINT) FROM landed l WHERE EXISTS (SELECT 1 FROM edits e WHERE e.session_id = l.session_id AND e.repo_id = l.repo_id)) AS committed FROM edits""",
    "top_model": BASE + EDITS + "SELECT model, count(*) AS edits FROM edits GROUP BY model ORDER BY edits DESC, model LIMIT 1",
    "commit_totals": BASE + """SELECT count(*) AS commits, CAST(sum(lines_added) AS BIGINT) AS lines_added, CAST(sum(a) AS BIGINT) AS committed,
least(CAST(100 AS DOUBLE), CAST(sum(a) AS BIGINT) * CAST(100 AS DOUBLE) / CAST(sum(lines_added) AS BIGINT)) AS ai_share FROM commits LEFT JOIN (SELECT commit_id, sum(lines_attributed) AS a FROM commit_sessions GROUP BY 1) p ON p.commit_id = id""",
    "session_active": BASE + GAPS + "SELECT session_id, CAST(coalesce(sum(gap), 0) AS BIGINT) / CAST(60000000 AS DOUBLE) AS active_minutes FROM gaps GROUP BY 1",
    "working_hours": BASE + """, s AS (SELECT session_id, min(ts) AS lo, max(ts) AS hi FROM ev WHERE session_id IS NOT NULL GROUP BY 1)
SELECT CAST(sum(epoch_us(coalesce(ended_at, hi)) - epoch_us(coalesce(started_at, lo))) AS BIGINT) / CAST(3.6e9 AS DOUBLE) AS hours FROM sessions LEFT JOIN s ON s.session_id = id""",
    "max_concurrent": BASE + """, s AS (SELECT session_id, min(ts) AS lo, max(ts) AS hi FROM ev WHERE session_id IS NOT NULL GROUP BY 1),
p AS (SELECT id, coalesce(started_at, lo) AS a, coalesce(ended_at, hi) AS b FROM sessions LEFT JOIN s ON s.session_id = id)
SELECT max(n) AS max_concurrent FROM (SELECT count(*) AS n FROM p x JOIN p y ON y.a <= x.b AND y.b >= x.a GROUP BY x.id) q""",
    "token_totals": BASE + "SELECT " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")) + " FROM sessions",
    "tokens_by_agent": BASE + "SELECT agent_slug, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")) + " FROM sessions GROUP BY 1",
    "breakdown_agent": _breakdown("agent_slug", "agent_slug"),
    "breakdown_model": _breakdown("model", "coalesce(model_slug, 'unknown')"),
    "breakdown_engineer": _breakdown("engineer_email", "s.engineer_email", "JOIN sessions s ON s.id = l.session_id"),
    "breakdown_repo": _breakdown("repo_id", "l.repo_id"),
    "daily_activity": BASE + EDITS + GAPS + LANDED + """,
a AS (SELECT CAST(ts AS DATE) AS day, s.agent_slug, CAST(coalesce(sum(gap), 0) AS BIGINT) / CAST(60000000 AS DOUBLE) AS active_minutes, count(DISTINCT session_id) AS sessions FROM gaps JOIN sessions s ON s.id = session_id GROUP BY 1, 2),
p AS (SELECT CAST(p.ts AS DATE) AS day, s.agent_slug, count(*) AS prompts FROM prompts p JOIN sessions s ON s.id = session_id GROUP BY 1, 2),
e AS (SELECT CAST(ts AS DATE) AS day, agent_slug, count(*) AS edits, CAST(sum(lines) AS BIGINT) AS generated FROM edits GROUP BY 1, 2),
c AS (SELECT CAST(committed_at AS DATE) AS day, s.agent_slug, CAST(sum(lines_attributed) AS BIGINT) AS committed, count(DISTINCT commit_id) AS commits FROM landed JOIN sessions s ON s.id = session_id WHERE lines_attributed > 0 GROUP BY 1, 2),
k AS (SELECT day, agent_slug FROM a UNION SELECT day, agent_slug FROM p UNION SELECT day, agent_slug FROM e UNION SELECT day, agent_slug FROM c)
SELECT k.day, k.agent_slug, coalesce(active_minutes, 0) AS active_minutes, coalesce(sessions, 0) AS sessions, coalesce(prompts, 0) AS prompts, coalesce(edits, 0) AS edits, coalesce(generated, 0) AS generated, coalesce(committed, 0) AS committed, coalesce(commits, 0) AS commits
FROM k LEFT JOIN a ON a.day = k.day AND a.agent_slug = k.agent_slug LEFT JOIN p ON p.day = k.day AND p.agent_slug = k.agent_slug LEFT JOIN e ON e.day = k.day AND e.agent_slug = k.agent_slug LEFT JOIN c ON c.day = k.day AND c.agent_slug = k.agent_slug""",
    "edit_heatmap": BASE + EDITS + "SELECT CAST(dayofweek(ts) AS INTEGER) AS weekday, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS edits FROM edits GROUP BY 1, 2",
    "tool_mix": BASE + CALLS + "SELECT agent_slug, family, count(*) AS calls, count(*) / CAST(sum(count(*)) OVER (PARTITION BY agent_slug) AS DOUBLE) AS share FROM calls GROUP BY 1, 2",
    "time_split": BASE + CALLS + "SELECT family, count(*) AS calls, count(ms) AS timed, coalesce(sum(CASE WHEN ms IS NOT NULL THEN least(ms, 300000) END), 0) / CAST(60000 AS DOUBLE) AS wait_minutes FROM calls GROUP BY 1",
    "slowest_calls": BASE + CALLS + "SELECT id, agent_slug, tool, ms FROM calls WHERE ms IS NOT NULL ORDER BY ms DESC, id LIMIT 5",
    "untimed_agents": BASE + CALLS + "SELECT agent_slug FROM calls GROUP BY 1 HAVING count(ms) = 0",
    "session_outcomes": BASE + EDITS + """SELECT id AS session_id, CASE WHEN EXISTS (SELECT 1 FROM commit_sessions c WHERE c.session_id = s.id AND lines_attributed > 0) THEN 'shipped' WHEN EXISTS (SELECT 1 FROM edits e WHERE e.session_id = s.id) THEN 'edited' ELSE 'explored' END AS outcome FROM sessions s""",
    "funnel": BASE + EDITS + """SELECT (SELECT count(*) FROM sessions) AS sessions, (SELECT count(*) FROM sessions s WHERE EXISTS (SELECT 1 FROM edits e WHERE e.session_id = s.id)) AS with_edits,
(SELECT count(*) FROM sessions s WHERE EXISTS (SELECT 1 FROM commit_sessions c WHERE c.session_id = s.id AND lines_attributed > 0)) AS with_commits, (SELECT CAST(sum(lines) AS BIGINT) FROM edits) AS generated,
(SELECT CAST(sum(lines_attributed) AS BIGINT) FROM commit_sessions) AS committed, (SELECT count(DISTINCT commit_id) FROM commit_sessions WHERE lines_attributed > 0) AS commits""",
    "model_table": BASE + EDITS + GAPS + """,
pe AS (SELECT session_id, count(*) AS edits, sum(lines) AS generated FROM edits GROUP BY 1),
fr AS (SELECT event_id, arg_min(rel_file_path, id) AS rel FROM ranges WHERE rel_file_path IS NOT NULL GROUP BY 1),
pf AS (SELECT session_id, count(*) AS files, count(*) FILTER (n > 1) AS reedited FROM (SELECT session_id, coalesce(rel_file_path, rel) AS f, count(*) AS n FROM edits LEFT JOIN fr ON fr.event_id = edits.id GROUP BY 1, 2) x WHERE f IS NOT NULL GROUP BY 1),
pt AS (SELECT session_id, count(*) FILTER (event_type = 'PostToolUse') AS tools, count(*) FILTER (event_type = 'Stop') AS turns FROM ev GROUP BY 1), pp AS (SELECT session_id, count(*) AS prompts FROM prompts GROUP BY 1),
pc AS (SELECT session_id, sum(lines_attributed) AS committed, count(DISTINCT commit_id) AS commits FROM commit_sessions WHERE lines_attributed > 0 GROUP BY 1), pa AS (SELECT session_id, CAST(coalesce(sum(gap), 0) AS BIGINT) / CAST(60000000 AS DOUBLE) AS active FROM gaps GROUP BY 1)
SELECT s.agent_slug, coalesce(s.model_slug, 'unknown') AS model, count(*) AS sessions, count(edits) AS sessions_with_edits, CAST(coalesce(sum(edits), 0) AS BIGINT) AS edits, CAST(coalesce(sum(generated), 0) AS BIGINT) AS generated, CAST(coalesce(sum(files), 0) AS BIGINT) AS files,
 CAST(coalesce(sum(reedited), 0) AS BIGINT) AS reedited, CAST(coalesce(sum(tools), 0) AS BIGINT) AS tools, CAST(coalesce(sum(turns), 0) AS BIGINT) AS turns, CAST(coalesce(sum(prompts), 0) AS BIGINT) AS prompts, CAST(coalesce(sum(committed), 0) AS BIGINT) AS committed, CAST(coalesce(sum(commits), 0) AS BIGINT) AS commits,
 round(sum(active), 6) AS active_minutes, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, count(committed) AS shipped
FROM sessions s LEFT JOIN pe ON pe.session_id = s.id LEFT JOIN pf ON pf.session_id = s.id LEFT JOIN pt ON pt.session_id = s.id LEFT JOIN pp ON pp.session_id = s.id LEFT JOIN pc ON pc.session_id = s.id LEFT JOIN pa ON pa.session_id = s.id GROUP BY 1, 2""",
    "status_counts": BASE + "SELECT count(*) FILTER (event_type <> 'hook_misfire') AS events, count(*) FILTER (event_type = 'hook_misfire') AS misfires, (SELECT count(*) FROM sessions) AS sessions, (SELECT count(*) FROM commits) AS commits, (SELECT count(*) FROM repositories) AS repositories FROM ev",
    "status_agents": BASE + "SELECT agent_slug, count(*) FILTER (event_type <> 'hook_misfire') AS events, count(*) FILTER (event_type = 'hook_misfire') AS misfires FROM ev GROUP BY 1",
    "newest_commits": BASE + "SELECT id, repo_id, committed_at, lines_added FROM commits ORDER BY committed_at DESC, id LIMIT 10",
    "active_repos": BASE + "SELECT id FROM repositories r WHERE id IN (SELECT repo_id FROM ev WHERE event_type <> 'hook_misfire') OR id IN (SELECT repo_id FROM sessions) OR id IN (SELECT repo_id FROM commits c JOIN commit_sessions cs ON cs.commit_id = c.id WHERE lines_attributed > 0)",
    "filter_options": BASE + """SELECT DISTINCT 'agent' AS kind, agent_slug AS value FROM sessions UNION SELECT 'agent', agent_slug FROM ev UNION SELECT 'model', model_slug FROM sessions WHERE model_slug IS NOT NULL
UNION SELECT 'model', json_extract_string(payload, '$.model') FROM ev WHERE json_extract_string(payload, '$.model') IS NOT NULL UNION SELECT 'repo', id FROM repositories UNION SELECT 'engineer', engineer_email FROM sessions WHERE engineer_email IS NOT NULL""",
}
