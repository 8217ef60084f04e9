"""DuckDB SQL for normalising, repair, retention and export queries."""

from __future__ import annotations

from .oracles import BASE
from .oracles_sessions import FILES

BLAME = FILES + """,
bl AS (SELECT repo_id, al.file_path, al.line, arg_max(al.commit_id, (committed_at, al.commit_id)) AS commit_id FROM al JOIN commits c ON c.id = al.commit_id GROUP BY 1, 2, 3),
bb AS (SELECT bl.*, ow.session_id, ow.event_id, ow.ts FROM bl LEFT JOIN ow ON ow.commit_id = bl.commit_id AND ow.file_path = bl.file_path AND ow.line = bl.line)
"""
_MODEL = "json_extract_string(payload, '$.model')"

SQL: dict[str, str] = {
    "build_sessions": BASE + f"""SELECT session_id AS id, arg_min(agent_slug, (ts, id)) AS agent_slug, arg_max({_MODEL}, (ts, id)) FILTER ({_MODEL} IS NOT NULL) AS model_slug, arg_min(repo_id, (ts, id)) FILTER (repo_id IS NOT NULL) AS repo_id, min(ts) AS started_at, max(ts) AS ended_at
FROM ev WHERE session_id IS NOT NULL GROUP BY session_id""",
    "session_repo": BASE + """SELECT session_id, repo_id FROM (SELECT session_id, repo_id, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, repo_id) AS r FROM ev WHERE session_id IS NOT NULL AND repo_id IS NOT NULL GROUP BY 1, 2) x WHERE r = 1""",
    "session_engineer": BASE + """SELECT s.id AS session_id, min(author_email) AS engineer_email FROM sessions s JOIN commits c ON c.repo_id = s.repo_id AND c.committed_at BETWEEN s.started_at AND s.ended_at GROUP BY 1 HAVING count(DISTINCT author_email) = 1""",
    "prune_counts": BASE + """SELECT 'events' AS table_name, count(*) AS rows FROM ev e WHERE ts < TIMESTAMP '2024-01-16' AND NOT EXISTS (SELECT 1 FROM ranges r WHERE r.event_id = e.id)
UNION ALL SELECT 'prompts', count(*) FROM prompts WHERE ts < TIMESTAMP '2024-01-16'""",
    "latest_rows": BASE + "SELECT * FROM (SELECT session_id, event_type, id, ts FROM ev WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, event_type ORDER BY ts DESC, id DESC) = 1) x",
    "export_status": BASE + """SELECT 'events' AS table_name, count(*) FILTER (lines_generated IS NULL) AS pending, count(*) AS total FROM ev UNION ALL SELECT 'sessions', count(*) FILTER (ended_at IS NULL), count(*) FROM sessions""",
    "inspect_events": BASE + "SELECT * FROM ev WHERE agent_slug = 'codex' AND event_type = 'PostToolUse' ORDER BY ts DESC, id DESC LIMIT 10",
    "redact_events": BASE + """, t AS (SELECT *, concat(coalesce(json_extract_string(payload, '$.tool_input.new_string'), ''), coalesce(json_extract_string(payload, '$.tool_input.content'), '')) AS txt FROM ev)
SELECT id, session_id, event_type, coalesce(lines_added, CASE WHEN len(txt) - len(replace(txt, chr(10), '')) > 0 THEN len(txt) - len(replace(txt, chr(10), '')) END) AS lines_added,
CASE WHEN payload IS NOT NULL THEN concat('{', array_to_string(list_filter(['"tool_name":"' || json_extract_string(payload, '$.tool_name') || '"', '"model":"' || json_extract_string(payload, '$.model') || '"',
  '"duration":' || json_extract_string(payload, '$.duration'), '"duration_ms":' || json_extract_string(payload, '$.duration_ms'), '"permission_mode":"' || json_extract_string(payload, '$.permission_mode') || '"', '"tool_input":{}', '"redacted":true'], lambda x: x IS NOT NULL), ','), '}') END AS payload FROM t""",
    "resolve_paths": BASE + "SELECT id, file_path, CASE WHEN file_path IS NOT NULL THEN split_part(file_path, '/', 3) END AS repo, substr(file_path, length(split_part(file_path, '/', 3)) + 5) AS rel FROM ev",
    "parse_envelopes": BASE + f"""SELECT session_id, ts, CASE WHEN payload IS NULL THEN 'hook_misfire' ELSE event_type END AS event_type, agent_slug, {_MODEL} AS model, count(*) AS n FROM ev WHERE event_type <> 'hook_misfire' GROUP BY ALL
UNION ALL SELECT NULL, ts, 'hook_misfire', agent_slug, NULL, count(*) FROM ev WHERE event_type = 'hook_misfire' GROUP BY ALL""",
    "normalize_payloads": BASE + """, t AS (SELECT *, day(ts) % 2 = 0 AS edit FROM ev WHERE file_path IS NOT NULL)
SELECT id, CASE WHEN agent_slug = 'github-copilot' THEN 'PostToolUse' END AS event, CASE WHEN edit THEN 'Edit' ELSE 'Write' END AS tool,
CASE WHEN agent_slug = 'github-copilot' THEN CASE WHEN edit THEN 'str_replace' ELSE 'create' END END AS copilot_tool, CASE WHEN agent_slug = 'pi' THEN CASE WHEN edit THEN 'edit' ELSE 'write' END END AS pi_tool,
file_path, CASE WHEN edit THEN '' END AS old_string, CASE WHEN edit THEN id END AS new_string, CASE WHEN NOT edit THEN id END AS content FROM t""",
    "parse_commit_log": BASE + ", p AS (SELECT *, lag(sha) OVER (PARTITION BY repo_id ORDER BY committed_at, id) AS parent_sha FROM commits) SELECT sha, parent_sha, author_email, author_name, committed_at, 'work on ' || id AS message FROM p",
    "parse_numstat": BASE + "SELECT commit_id, CAST(sum(lines_added) AS BIGINT) AS lines_added, CAST(sum(lines_removed) AS BIGINT) AS lines_removed, count(*) AS files_changed FROM commit_files GROUP BY 1",
    "parse_unified_diff": BASE + "SELECT commit_id, file_path, unnest(generate_series(1, lines_added)) AS line_no, 'line ' || unnest(generate_series(1, lines_added)) AS text FROM commit_files WHERE lines_added > 0",
    "blame": BASE + BLAME + "SELECT * FROM bb",
    "blame_summary": BASE + BLAME + "SELECT repo_id, file_path, count(*) AS total, count(session_id) AS ai_lines, count(DISTINCT session_id) AS sessions, count(session_id) * CAST(100 AS DOUBLE) / count(*) AS ai_percent FROM bb GROUP BY 1, 2",
    "blame_sessions": BASE + BLAME + "SELECT repo_id, file_path, session_id, count(*) AS lines, min(line) AS first_line FROM bb WHERE session_id IS NOT NULL GROUP BY 1, 2, 3",
    "version_diff": """WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, len(string_split(text, chr(10))) AS n FROM documents),
k AS (SELECT * FROM l WHERE NOT (i = n - 1 AND t = ''))
SELECT source AS file, doc_id AS version, count(*) FILTER (i % 7 = 3) AS removed, count(*) FILTER (i % 11 = 5) AS added FROM k GROUP BY 1, 2 HAVING count(*) FILTER (i % 7 = 3) + count(*) FILTER (i % 11 = 5) > 0""",
    "notes_round_trip": BASE + """, f AS (SELECT *, lines_added // 2 AS half, lines_added % 3 <> 0 AS exact FROM commit_files WHERE lines_added >= 4), v AS (SELECT commit_id, CASE WHEN bool_and(exact) THEN 2 ELSE 1 END AS v FROM f GROUP BY 1),
r AS (SELECT commit_id, file_path, 1 AS start_line, half AS end_line FROM f UNION ALL SELECT commit_id, file_path, half + 2, lines_added FROM f)
SELECT r.commit_id, v, file_path, start_line, end_line, 'codex' AS agent, 's' || end_line AS session, CASE WHEN end_line % 2 = 0 THEN 'm0' END AS model, '2024-01-01T00:00:00Z' AS ts FROM r JOIN v ON v.commit_id = r.commit_id""",
    "search_sessions": BASE + """SELECT id, agent_slug, engineer_name FROM sessions s WHERE agent_slug IN ('codex', 'cursor', 'pi') AND (concat_ws(chr(0), id, agent_slug, model_slug, engineer_email, engineer_name) ILIKE '%DEV 1%'
  OR EXISTS (SELECT 1 FROM prompts p WHERE p.session_id = s.id AND prompt_text ILIKE '%DEV 1%'))""",
    "cross_delivered": BASE + """, x AS (SELECT agent_slug, CAST(CAST(substr(id, 2) AS BIGINT) % 8 AS INTEGER) AS shape FROM ev WHERE NOT contains(id, '_'))
SELECT agent_slug, shape, count(*) AS events FROM x WHERE NOT (shape = 0 AND agent_slug <> 'cursor') AND NOT (shape IN (2, 3, 5, 6) AND agent_slug <> 'github-copilot') GROUP BY 1, 2""",
    "event_files": BASE + """SELECT id, CASE n % 8 WHEN 0 THEN '/a/1' WHEN 1 THEN '/b/2' WHEN 2 THEN '/d/3' WHEN 4 THEN 'p/5.py' WHEN 5 THEN '/o/6' END AS file_path, CASE n % 8 WHEN 0 THEN 'Edit' WHEN 4 THEN 'apply_patch' WHEN 5 THEN 'Bash' WHEN 6 THEN 'Read' END AS tool
FROM (SELECT id, CAST(substr(id, 2) AS BIGINT) AS n FROM ev WHERE NOT contains(id, '_')) x""",
    "trim_payloads": BASE + """, x AS (SELECT id, CAST(substr(id, 2) AS BIGINT) AS n FROM ev WHERE NOT contains(id, '_')), y AS (SELECT *, 480 * (n % 18) AS e, CASE WHEN n % 300 = 0 THEN 300000 ELSE n % 700 END AS c FROM x WHERE n % 100 = 0),
z AS (SELECT *, CASE WHEN e > 2048 THEN 1984 + length('[...truncated ' || (e - 1984) || ' bytes]') ELSE e END AS e2, CASE WHEN c > 262144 THEN 262080 + length('[...truncated ' || (c - 262080) || ' bytes]') ELSE c END AS c2 FROM y),
w AS (SELECT *, 24 + (e - e2) - 9 AS out_dropped FROM z)
SELECT id, CAST(length('{"tool_input":{"content":""},"tool_response":{"code":1,"stderr":""},"_trimmed":{"dropped_bytes":}}') + e2 + c2 + length(CAST(16 + e - e2 + c - c2 AS VARCHAR)) AS INTEGER) AS bytes, true AS dropped, '1' AS code, CAST(e2 AS INTEGER) AS stderr_bytes, CAST(c2 AS INTEGER) AS content_bytes FROM w
UNION ALL SELECT id, 20, false, NULL, NULL, NULL FROM x WHERE n % 100 <> 0""",
}
