"""DuckDB SQL for attribution and session queries."""

from __future__ import annotations

from .oracles import BASE, CALLS, EDITS, GAPS, LANDED

FILES = """,
fc AS (SELECT commit_id, repo_id, file_path, f.lines_added, epoch_us(committed_at) // 1000000 AS at FROM commit_files f JOIN commits c ON c.id = commit_id),
er AS (SELECT r.event_id, e.session_id, e.repo_id, e.ts, r.rel_file_path AS file_path, start_line, end_line, epoch_us(e.ts) // 1000000 AS at FROM ranges r JOIN ev e ON e.id = r.event_id WHERE end_line >= start_line AND e.session_id IS NOT NULL AND e.repo_id IS NOT NULL),
nx AS (SELECT event_id, min(fc.at) AS na FROM er JOIN fc ON fc.repo_id = er.repo_id AND fc.file_path = er.file_path AND fc.at >= er.at GROUP BY 1),
cr AS (SELECT fc.commit_id, er.file_path, er.event_id, er.session_id, er.ts, er.start_line, er.end_line FROM er JOIN nx ON nx.event_id = er.event_id JOIN fc ON fc.repo_id = er.repo_id AND fc.file_path = er.file_path AND fc.at = nx.na),
al AS (SELECT commit_id, file_path, unnest(generate_series(1, lines_added)) AS line FROM commit_files WHERE lines_added > 0),
sp AS (SELECT commit_id, file_path, event_id, session_id, ts, unnest(generate_series(start_line, end_line)) AS line FROM cr),
ow AS (SELECT * FROM (SELECT sp.*, row_number() OVER (PARTITION BY sp.commit_id, sp.file_path, sp.line ORDER BY ts DESC, event_id DESC, session_id DESC) AS r FROM sp JOIN al ON al.commit_id = sp.commit_id AND al.file_path = sp.file_path AND al.line = sp.line) x WHERE r = 1)
"""
TURNS = CALLS + """,
pk AS (SELECT *, CASE WHEN starts_with(prompt_text, 'This session is being continued from a previous conversation') THEN 'compaction'
   WHEN lag(prompt_text) OVER w = prompt_text AND epoch_us(ts) - epoch_us(lag(ts) OVER w) BETWEEN 0 AND 179999999 THEN 'resend' ELSE 'user' END AS kind, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM prompts WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
st AS (SELECT session_id, epoch_us(ts) AS us FROM ev WHERE event_type = 'Stop' AND session_id IS NOT NULL),
tl AS (SELECT session_id, epoch_us(ts) AS us, CASE WHEN v.id IN (SELECT event_id FROM ranges) THEN 'edit' ELSE coalesce((SELECT family FROM calls c WHERE c.id = v.id), 'other') END AS family,
  coalesce(TRY_CAST(json_extract_string(payload, '$.duration_ms') AS DOUBLE), TRY_CAST(json_extract_string(payload, '$.duration') AS DOUBLE)) AS ms FROM ev v WHERE event_type IN ('PostToolUse', 'afterFileEdit') AND session_id IS NOT NULL),
it AS (SELECT session_id, epoch_us(ts) AS us, kind, seq, NULL AS family, NULL AS ms FROM pk WHERE ts IS NOT NULL UNION ALL SELECT session_id, us, NULL, NULL, family, ms FROM tl),
ls AS (SELECT s.id AS session_id, epoch_us(s.started_at) AS begun, epoch_us(s.ended_at) AS over_us, max(us) AS last_stop, count(us) AS n FROM sessions s LEFT JOIN st ON st.session_id = s.id GROUP BY ALL),
sn AS (SELECT session_id, us, row_number() OVER (PARTITION BY session_id ORDER BY us) - 1 AS turn, lag(us) OVER (PARTITION BY session_id ORDER BY us) AS prev FROM st),
wn AS (SELECT sn.session_id, turn, coalesce(prev, begun) AS a, us AS b, false AS open FROM sn JOIN ls ON ls.session_id = sn.session_id
  UNION ALL SELECT session_id, n, coalesce(last_stop, begun), over_us, true FROM ls WHERE n = 0 OR EXISTS (SELECT 1 FROM it WHERE it.session_id = ls.session_id AND it.us > ls.last_stop)),
tr AS (SELECT w.session_id, w.turn, it.us, it.kind, it.seq, it.family, it.ms FROM wn w JOIN it ON it.session_id = w.session_id AND ((it.us > a AND (b IS NULL OR it.us <= b)) OR (turn = 0 AND it.us <= a))),
tc AS (SELECT session_id, turn, coalesce(arg_min(us, seq) FILTER (kind = 'user'), arg_min(us, seq) FILTER (kind IS NOT NULL)) AS asked, count(*) FILTER (kind IS NOT NULL) AS prompts, count(*) FILTER (family IS NOT NULL) AS tools,
  count(*) FILTER (family = 'shell') AS shell, count(*) FILTER (family = 'edit') AS edit, count(*) FILTER (family = 'read') AS read, coalesce(sum(ms), 0) AS tool_ms FROM tr GROUP BY 1, 2),
turns AS (SELECT w.session_id, w.turn, coalesce(asked, a) AS started_us, b AS ended_us, coalesce(prompts, 0) AS prompts, coalesce(tools, 0) AS tools, coalesce(shell, 0) AS shell, coalesce(edit, 0) AS edit, coalesce(read, 0) AS read, coalesce(tool_ms, 0) AS tool_ms, open
  FROM wn w LEFT JOIN tc ON tc.session_id = w.session_id AND tc.turn = w.turn)
"""
#: What each edit wrote, file by file, and the rows of a session's files (file_lines is never given here).
ROWS = """,
fp AS (SELECT event_id, arg_min(rel_file_path, id) FILTER (rel_file_path IS NOT NULL) AS rel, arg_min(file_path, id) AS abs, count(DISTINCT coalesce(rel_file_path, file_path)) AS n FROM ranges GROUP BY 1),
ee AS (SELECT e.*, v.lines_generated AS measured, fp.rel, fp.abs, coalesce(fp.n, 0) AS n FROM edits e JOIN ev v ON v.id = e.id LEFT JOIN fp ON fp.event_id = e.id WHERE e.session_id IS NOT NULL),
ef AS (SELECT ee.session_id, max(CASE WHEN g.rel_file_path IS NOT NULL THEN ee.repo_id END) AS repo_id, coalesce(g.rel_file_path, g.file_path) AS file_path, CAST(sum(end_line - start_line + 1) AS BIGINT) AS lines
    FROM ee JOIN ranges g ON g.event_id = ee.id WHERE measured IS NULL AND n > 1 GROUP BY ee.session_id, ee.id, coalesce(g.rel_file_path, g.file_path)
  UNION ALL SELECT session_id, CASE WHEN coalesce(rel_file_path, rel) IS NOT NULL THEN repo_id END, coalesce(rel_file_path, rel, abs, file_path), lines FROM ee WHERE NOT (measured IS NULL AND n > 1)),
fw AS (SELECT session_id, coalesce(repo_id, '') AS repo, file_path, greatest(CAST(sum(lines) AS BIGINT), 0) AS generated, count(*) AS edits FROM ef WHERE file_path IS NOT NULL GROUP BY ALL),
fk AS (SELECT session_id, coalesce(repo_id, '') AS repo, file_path, CAST(sum(lines_attributed) AS BIGINT) AS committed FROM commit_session_files f JOIN commits c ON c.id = f.commit_id GROUP BY ALL),
frs AS (SELECT session_id, nullif(repo, '') AS repo_id, file_path, greatest(coalesce(generated, 0), coalesce(committed, 0)) AS generated, coalesce(committed, 0) AS committed, coalesce(edits, 0) AS edits FROM fw FULL OUTER JOIN fk USING (session_id, repo, file_path))
"""
SC = """,
sc AS (SELECT session_id, commit_id, repo_id, committed_at, lines_attributed FROM landed WHERE lines_attributed > 0)
"""
FACTS = EDITS + GAPS + """,
pp AS (SELECT session_id, count(*) AS prompts, substr(arg_min(prompt_text, seq) FILTER (NOT starts_with(prompt_text, 'This session is being continued from a previous conversation')), 1, 500) AS first_prompt FROM prompts GROUP BY 1),
pa AS (SELECT session_id, CAST(coalesce(sum(gap), 0) AS BIGINT) / CAST(60000000 AS DOUBLE) AS active_minutes FROM gaps GROUP BY 1),
pe AS (SELECT session_id, count(*) AS edits, count(DISTINCT file_path) AS files, CAST(sum(lines) AS BIGINT) AS generated FROM edits GROUP BY 1),
pc AS (SELECT session_id, CAST(sum(lines_attributed) AS BIGINT) AS committed, count(DISTINCT commit_id) FILTER (lines_attributed > 0) AS commits FROM commit_sessions GROUP BY 1),
facts AS (SELECT id, agent_slug, model_slug, repo_id, started_at, ended_at, first_prompt, coalesce(prompts, 0) AS prompts, coalesce(active_minutes, 0) AS active_minutes, coalesce(edits, 0) AS edits, coalesce(files, 0) AS files, coalesce(generated, 0) AS generated,
  coalesce(committed, 0) AS committed, coalesce(commits, 0) AS commits, CASE WHEN commits > 0 THEN 'shipped' WHEN edits > 0 THEN 'edited' ELSE 'explored' END AS outcome
  FROM sessions s LEFT JOIN pp ON pp.session_id = s.id LEFT JOIN pa ON pa.session_id = s.id LEFT JOIN pe ON pe.session_id = s.id LEFT JOIN pc ON pc.session_id = s.id)
"""

SQL: dict[str, str] = {
    "candidate_ranges": BASE + FILES + "SELECT * FROM cr",
    "owned_lines": BASE + FILES + "SELECT commit_id, file_path, line, session_id, event_id, ts FROM ow",
    "attribute_files": BASE + FILES + "SELECT commit_id, session_id, file_path, count(DISTINCT event_id) AS event_count, count(*) AS lines_attributed FROM ow GROUP BY ALL",
    "attribute_sessions": BASE + FILES + """, a AS (SELECT commit_id, session_id, min(ts) AS first_event_ts, max(ts) AS last_event_ts, count(DISTINCT event_id) AS event_count FROM cr GROUP BY ALL),
b AS (SELECT commit_id, session_id, count(DISTINCT file_path) AS files_touched, count(*) AS lines_attributed FROM ow GROUP BY ALL)
SELECT a.*, coalesce(files_touched, 0) AS files_touched, coalesce(lines_attributed, 0) AS lines_attributed FROM a LEFT JOIN b ON a.commit_id = b.commit_id AND a.session_id = b.session_id""",
    "attribute_by_churn": BASE + FILES + """, h AS (SELECT commit_id, file_path, session_id, CAST(sum(end_line - start_line + 1) AS BIGINT) AS churn FROM cr GROUP BY ALL), t AS (SELECT h.*, CAST(sum(churn) OVER (PARTITION BY commit_id, file_path) AS BIGINT) AS total FROM h)
SELECT t.commit_id, t.file_path, session_id, CASE WHEN total > lines_added THEN churn * lines_added // total ELSE churn END AS lines_attributed FROM t JOIN commit_files f ON f.commit_id = t.commit_id AND f.file_path = t.file_path""",
    "line_runs": BASE + FILES + """, i AS (SELECT DISTINCT commit_id, file_path, session_id, line FROM ow), j AS (SELECT *, line - row_number() OVER (PARTITION BY commit_id, file_path, session_id ORDER BY line) AS g FROM i),
k AS (SELECT commit_id, file_path, session_id, min(line) AS a, max(line) AS b FROM j GROUP BY commit_id, file_path, session_id, g)
SELECT commit_id, file_path, session_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS runs FROM k GROUP BY 1, 2, 3""",
    "commit_of_edit": BASE + """, e AS (SELECT DISTINCT event_id, repo_id, epoch_us(ts) // 1000000 AS at FROM ranges JOIN ev ON ev.id = event_id WHERE repo_id IS NOT NULL)
SELECT event_id, arg_min(c.id, (epoch_us(committed_at) // 1000000, c.id)) AS commit_id FROM e JOIN commits c ON c.repo_id = e.repo_id AND epoch_us(committed_at) // 1000000 >= e.at GROUP BY 1""",
    "prompt_before": BASE + """SELECT e.id AS event_id, e.session_id, arg_max(p.seq, (p.ts, p.seq)) AS seq, arg_max(p.prompt_text, (p.ts, p.seq)) AS prompt_text FROM ev e LEFT JOIN prompts p ON p.session_id = e.session_id AND p.ts < e.ts WHERE e.session_id IS NOT NULL GROUP BY 1, 2""",
    "checkout_groups": BASE + "SELECT a.id AS repo_id, min(b.id) AS group_id FROM repositories a JOIN repositories b ON a.id = b.id OR a.remote_url = b.remote_url GROUP BY 1",
    "lead_time": BASE + """, g AS (SELECT epoch_us(committed_at) - epoch_us(last_event_ts) AS gap FROM commit_sessions cs JOIN commits c ON c.id = cs.commit_id WHERE lines_attributed > 0)
SELECT count(*) AS total, count(*) FILTER (gap < 900000000) AS under_15m, count(*) FILTER (gap >= 86400000000) AS over_1d FROM g""",
    "lead_time_filtered": BASE + """, g AS (SELECT epoch_us(committed_at) - epoch_us(last_event_ts) AS gap FROM commit_sessions cs JOIN commits c ON c.id = cs.commit_id JOIN sessions s ON s.id = cs.session_id
  WHERE lines_attributed > 0 AND s.agent_slug IN ('codex', 'pi') AND coalesce(s.model_slug, 'unknown') IN ('m0', 'unknown') AND committed_at >= TIMESTAMP '2024-01-05' AND committed_at < TIMESTAMP '2024-01-26')
SELECT count(*) AS total, count(*) FILTER (gap < 900000000) AS under_15m, count(*) FILTER (gap >= 86400000000) AS over_1d FROM g""",
    "tool_mix_filtered": BASE + CALLS + """SELECT c.agent_slug, family, count(*) AS calls, count(*) / CAST(sum(count(*)) OVER (PARTITION BY c.agent_slug) AS DOUBLE) AS share FROM calls c LEFT JOIN sessions s ON s.id = c.session_id
WHERE coalesce(s.model_slug, json_extract_string(payload, '$.model'), 'unknown') IN ('m0', 'unknown') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-26' AND c.agent_slug IN ('codex', 'pi') GROUP BY 1, 2""",
    "session_count": BASE + EDITS + "SELECT count(*) AS n FROM sessions s WHERE NOT EXISTS (SELECT 1 FROM commit_sessions c WHERE c.session_id = s.id AND lines_attributed > 0) AND EXISTS (SELECT 1 FROM edits e WHERE e.session_id = s.id)",
    "ancestors": BASE + """, p AS (SELECT id, repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY committed_at, id) AS r FROM commits)
SELECT a.id, b.id AS ancestor, CAST(a.r - b.r AS INTEGER) AS steps FROM p a JOIN p b ON a.repo_id = b.repo_id AND b.r BETWEEN a.r - 500 AND a.r - 1""",
    "list_sessions": BASE + FACTS + "SELECT * FROM facts ORDER BY started_at DESC, id DESC LIMIT 50",
    "session_detail": BASE + FACTS + "SELECT * FROM facts",
    "files_touched": BASE + EDITS + "SELECT session_id, file_path, count(*) AS edits, CAST(sum(lines) AS BIGINT) AS lines FROM edits WHERE session_id IS NOT NULL GROUP BY 1, 2",
    "session_commits": BASE + LANDED + SC + "SELECT * FROM sc",
    "tool_calls": BASE + EDITS + CALLS + """, pr AS (SELECT event_id, arg_min(rel_file_path, id) FILTER (rel_file_path IS NOT NULL) AS rel, arg_min(file_path, id) AS abs FROM ranges GROUP BY 1)
SELECT v.id, v.session_id, v.ts, json_extract_string(v.payload, '$.tool_name') AS tool, coalesce(c.family, 'other') AS family, coalesce(CAST(json_extract_string(v.payload, '$.duration_ms') AS DOUBLE), CAST(json_extract_string(v.payload, '$.duration') AS DOUBLE)) AS ms, coalesce(v.rel_file_path, rel, abs, v.file_path) AS file,
coalesce(e.lines_written, 0) AS lines_written, substr(coalesce(v.rel_file_path, rel, abs, v.file_path), 1, 200) AS summary, false AS has_stderr, pr.event_id IS NOT NULL AS ranged
FROM ev v LEFT JOIN calls c ON c.id = v.id LEFT JOIN edits e ON e.id = v.id LEFT JOIN pr ON pr.event_id = v.id WHERE v.event_type IN ('PostToolUse', 'afterFileEdit') AND v.session_id IS NOT NULL""",
    "stops": BASE + "SELECT id, session_id, ts, json_extract_string(payload, '$.last_assistant_message') AS message, json_extract_string(payload, '$.effort.level') AS effort, json_extract_string(payload, '$.permission_mode') AS permission_mode FROM ev WHERE event_type = 'Stop' AND session_id IS NOT NULL",
    "classify_prompts": BASE + TURNS + "SELECT session_id, seq, ts, agent_slug, prompt_text, kind, CASE WHEN kind = 'resend' THEN CAST(round(gap / CAST(1000000 AS DOUBLE)) AS BIGINT) END AS resend_s FROM pk",
    "build_turns": BASE + TURNS + "SELECT session_id, turn, started_us, ended_us, prompts, tools, shell, edit, read, tool_ms, open, CASE WHEN ended_us IS NOT NULL THEN greatest((ended_us - started_us) / CAST(1000 AS DOUBLE), 0) END AS duration_ms FROM turns",
    "commit_turns": BASE + LANDED + SC + TURNS + """, h AS (SELECT sc.session_id, sc.commit_id, min(turn) AS hit FROM sc JOIN turns t ON t.session_id = sc.session_id AND (ended_us IS NULL OR epoch_us(committed_at) <= ended_us + 120000000) GROUP BY 1, 2),
m AS (SELECT session_id, max(turn) AS last FROM turns GROUP BY 1)
SELECT sc.session_id, sc.commit_id, CASE WHEN committed_at > s.started_at THEN coalesce(hit, last) END AS turn FROM sc JOIN sessions s ON s.id = sc.session_id LEFT JOIN h ON h.session_id = sc.session_id AND h.commit_id = sc.commit_id LEFT JOIN m ON m.session_id = sc.session_id""",
    "file_rows": BASE + EDITS + ROWS + "SELECT * FROM frs",
    "session_stats": BASE + EDITS + GAPS + TURNS + LANDED + SC + ROWS + """,
q1 AS (SELECT session_id, CAST(coalesce(sum(gap), 0) AS BIGINT) / CAST(60000000 AS DOUBLE) AS active_minutes FROM gaps GROUP BY 1), q2 AS (SELECT session_id, count(*) AS prompts FROM pk WHERE kind = 'user' AND ts IS NOT NULL GROUP BY 1),
q3 AS (SELECT session_id, count(*) AS turns FROM turns GROUP BY 1), q4 AS (SELECT session_id, count(*) AS tool_calls FROM tl GROUP BY 1), q5 AS (SELECT session_id, count(*) AS edits FROM edits GROUP BY 1),
q6 AS (SELECT session_id, count(*) AS files, CAST(sum(generated) AS BIGINT) AS generated FROM frs GROUP BY 1), q7 AS (SELECT session_id, count(*) AS commits, CAST(sum(lines_attributed) AS BIGINT) AS committed FROM sc GROUP BY 1)
SELECT s.id AS session_id, CASE WHEN ended_at IS NOT NULL THEN greatest((epoch_us(ended_at) - epoch_us(started_at)) / CAST(60000000 AS DOUBLE), 0) END AS wall_minutes, output_tokens, coalesce(active_minutes, 0) AS active_minutes, coalesce(prompts, 0) AS prompts,
 coalesce(turns, 0) AS turns, coalesce(tool_calls, 0) AS tool_calls, coalesce(edits, 0) AS edits, coalesce(files, 0) AS files, coalesce(generated, 0) AS generated, coalesce(commits, 0) AS commits, coalesce(committed, 0) AS committed
FROM sessions s LEFT JOIN q1 ON q1.session_id = s.id LEFT JOIN q2 ON q2.session_id = s.id LEFT JOIN q3 ON q3.session_id = s.id LEFT JOIN q4 ON q4.session_id = s.id LEFT JOIN q5 ON q5.session_id = s.id LEFT JOIN q6 ON q6.session_id = s.id LEFT JOIN q7 ON q7.session_id = s.id""",
    "idle_gaps": BASE + """, t AS (SELECT DISTINCT session_id, epoch_us(ts) AS us FROM ev WHERE session_id IS NOT NULL), g AS (SELECT session_id, us - lag(us) OVER (PARTITION BY session_id ORDER BY us) AS gap FROM t)
SELECT session_id, count(*) FILTER (gap > 480000000) AS gaps, CAST(coalesce(sum(gap) FILTER (gap > 480000000), 0) AS BIGINT) / CAST(1000 AS DOUBLE) AS idle_ms, CAST(coalesce(sum(gap) FILTER (gap <= 480000000), 0) AS BIGINT) / CAST(1000 AS DOUBLE) AS active_ms FROM g GROUP BY 1""",
    "turn_blocks": BASE + EDITS + """, q AS (SELECT session_id, epoch_us(ts) AS us, 1 AS stop FROM ev WHERE event_type = 'Stop' AND session_id IS NOT NULL UNION ALL SELECT session_id, epoch_us(ts), 0 FROM edits WHERE session_id IS NOT NULL),
r AS (SELECT *, CAST(coalesce(sum(stop) OVER (PARTITION BY session_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS turn FROM q)
SELECT session_id, turn, min(stop) = 0 AS filled FROM r GROUP BY 1, 2 HAVING max(stop) = 1""",
}
