"""DuckDB SQL for the queries about who wrote which lines."""

from __future__ import annotations

from ..operators.attribution import BY_CONTENT, BY_POSITION
from ..sources.fixtures import duck_base
from .oracles_sessions import FILES

#: How many lines a document has, and how many of them each step keeps or adds.
_COUNTS = """
WITH docs AS (SELECT doc_id::varchar AS file, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS n FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
counts AS (SELECT file, n, n - (n + 3) // 7 AS kept, (n + 5) // 11 AS inserted, (n + 6) // 13 AS hand, least(n, 2) AS early FROM docs)"""

_METHOD = """
mapped AS (SELECT DISTINCT e.repo_id, g.rel_file_path AS file_path FROM ranges g JOIN ev e ON e.id = g.event_id),
ordered AS (SELECT id, lag(id) OVER w AS before, row_number() OVER w AS n FROM commits WINDOW w AS (PARTITION BY repo_id ORDER BY committed_at, id)),
carried AS (SELECT id AS commit_id, before AS carried_id FROM ordered WHERE n % 5 = 0),
chosen AS (
  SELECT f.commit_id, f.file_path, f.lines_added, c.committed_at >= TIMESTAMP '2024-01-08'
    AND (m.repo_id IS NOT NULL OR coalesce(o.lines_added % 2 = 0 AND o.lines_added > 0, false))
    AND NOT coalesce(o.lines_added > 0 AND o.lines_added % 3 = 0 AND o.lines_added % 2 <> 0, false) AS by_content
  FROM commit_files f JOIN commits c ON c.id = f.commit_id LEFT JOIN mapped m ON m.repo_id = c.repo_id AND m.file_path = f.file_path
  LEFT JOIN carried k ON k.commit_id = f.commit_id LEFT JOIN commit_files o ON o.commit_id = k.carried_id AND o.file_path = f.file_path)"""

_SPANS = """
spans AS (SELECT g.event_id, g.rel_file_path AS file_path, g.start_line, g.end_line, e.session_id, e.repo_id, e.ts, epoch_us(e.ts) // 1000000 AS sec FROM ranges g JOIN ev e ON e.id = g.event_id WHERE g.end_line >= g.start_line AND e.session_id IS NOT NULL AND e.repo_id IS NOT NULL),
made AS (SELECT f.commit_id, f.file_path, f.lines_added, c.repo_id, epoch_us(c.committed_at) // 1000000 AS sec FROM commit_files f JOIN commits c ON c.id = f.commit_id),
marks AS (SELECT DISTINCT repo_id, file_path, sec FROM made),
taken_by AS (SELECT s.*, m.sec AS next_at FROM spans s ASOF LEFT JOIN marks m ON s.repo_id = m.repo_id AND s.file_path = m.file_path AND s.sec <= m.sec)"""

_BLAME = """
ln AS (SELECT c.repo_id, f.file_path, u.line, arg_max(c.id, (c.committed_at, c.id)) AS id FROM commit_files f JOIN commits c ON c.id = f.commit_id, unnest(range(1, f.lines_added + 1)) AS u(line) WHERE f.lines_added > 0 GROUP BY 1, 2, 3),
lz AS (SELECT ln.*, f.lines_added AS la, CAST(substr(id, 2) AS BIGINT) AS n, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 7 <> 0 THEN id END AS commit_id FROM ln JOIN commit_files f ON f.commit_id = ln.id AND f.file_path = ln.file_path),
es AS (SELECT DISTINCT event_id, e.repo_id, epoch_us(ts) // 1000000 AS sec FROM ranges JOIN ev e ON e.id = event_id WHERE e.repo_id IS NOT NULL),
fs AS (SELECT repo_id, epoch_us(committed_at) // 1000000 AS sec, min(id) AS id FROM commits GROUP BY 1, 2),
ce AS (SELECT es.event_id, fs.id AS commit_id FROM es ASOF LEFT JOIN fs ON es.repo_id = fs.repo_id AND es.sec <= fs.sec),
rg AS (SELECT e.repo_id, g.rel_file_path AS file_path, ce.commit_id, g.start_line, g.end_line, g.event_id, e.session_id, e.ts FROM ranges g JOIN ev e ON e.id = g.event_id JOIN ce ON ce.event_id = g.event_id WHERE g.end_line >= g.start_line AND e.repo_id IS NOT NULL),
br AS (SELECT z.repo_id, z.file_path, z.line, arg_max(r.event_id, (r.ts, r.event_id)) AS event_id, arg_max(coalesce(r.session_id, '-'), (r.ts, r.event_id)) AS session_id
  FROM lz z JOIN rg r ON r.repo_id = z.repo_id AND r.file_path = z.file_path AND r.commit_id IS NOT DISTINCT FROM z.commit_id AND z.line BETWEEN r.start_line AND r.end_line GROUP BY 1, 2, 3),
lc AS (SELECT DISTINCT repo_id, file_path, commit_id FROM rg WHERE commit_id IS NOT NULL),
kind AS (SELECT z.*, br.event_id, nullif(br.session_id, '-') AS session_id, br.event_id IS NOT NULL AS ranged,
    CASE WHEN z.line % 4 = 0 AND (z.commit_id IS NULL OR n % 5 = 0) THEN 'map' WHEN z.commit_id IS NULL AND z.line % 2 = 0 THEN 'none' WHEN z.commit_id IS NOT NULL AND ((n % 3 = 0 AND la >= 2) OR (n % 3 = 1 AND la % 2 = 0)) THEN 'record'
      WHEN z.commit_id IS NULL OR lc.commit_id IS NOT NULL THEN 'range' ELSE 'note' END AS kind
  FROM lz z LEFT JOIN br ON br.repo_id = z.repo_id AND br.file_path = z.file_path AND br.line = z.line LEFT JOIN lc ON lc.repo_id = z.repo_id AND lc.file_path = z.file_path AND lc.commit_id = z.commit_id),
told AS (SELECT *, CASE kind WHEN 'map' THEN true WHEN 'record' THEN n % 3 = 0 AND line <= la // 2 WHEN 'range' THEN ranged WHEN 'note' THEN n % 3 = 2 AND la >= 4 AND line <> la // 2 + 1 ELSE false END AS known FROM kind)"""

SQL = {
    "commit_sessions_rollup": f"""{duck_base()}{FILES},
f AS (SELECT commit_id, session_id, file_path, min(ts) AS lo2, max(ts) AS hi2, count(DISTINCT event_id) AS n, count(*) AS lines FROM ow GROUP BY 1, 2, 3),
w AS (SELECT commit_id, session_id, sum(n)::bigint AS event_count, count(*) AS files_touched, sum(lines)::bigint AS lines_attributed, bool_or(lines % 2 = 0) AS content FROM f GROUP BY 1, 2),
s AS (SELECT commit_id, session_id, min(ts) AS first_event_ts, max(ts) AS last_event_ts FROM cr GROUP BY 1, 2)
SELECT s.commit_id, s.session_id, agent_slug, model_slug, first_event_ts, last_event_ts, coalesce(event_count, 0) AS event_count, coalesce(files_touched, 0) AS files_touched, coalesce(lines_attributed, 0) AS lines_attributed,
  CASE WHEN content THEN '{BY_CONTENT[0]}' ELSE '{BY_POSITION[0]}' END AS attribution_source, CASE WHEN content THEN '{BY_CONTENT[1]}' ELSE '{BY_POSITION[1]}' END AS confidence
FROM s LEFT JOIN w ON w.commit_id = s.commit_id AND w.session_id = s.session_id LEFT JOIN sessions x ON x.id = s.session_id
UNION ALL SELECT commit_id, session_id, agent_slug, model_slug, NULL, last_event_ts, 0, 0, 0, 'before', 'once' FROM commit_sessions c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.commit_id = c.commit_id AND s.session_id = c.session_id)""",
    "blame_credit": f"""{duck_base()},{_BLAME}
SELECT repo_id, file_path, line AS final_line, commit_id, CASE WHEN known THEN kind END AS source, CASE WHEN NOT known THEN NULL WHEN kind = 'map' THEN 'm' WHEN kind = 'range' THEN event_id END AS event_id,
  CASE WHEN NOT known THEN NULL WHEN kind = 'map' THEN 'm' WHEN kind = 'record' THEN 'rec-' || commit_id WHEN kind = 'range' THEN session_id ELSE 's' || CASE WHEN line <= la // 2 THEN la // 2 ELSE la END END AS session_id FROM told""",
    "authorship_map": f"""{_COUNTS}
SELECT * FROM (
  SELECT file, 'e0-' || file AS event_id, early AS lines FROM counts UNION ALL SELECT file, 'e1-' || file, kept - early FROM counts UNION ALL SELECT file, 'e2-' || file, inserted FROM counts
  UNION ALL SELECT file, 'e3-' || file, 1 FROM counts UNION ALL SELECT file, NULL, hand FROM counts) WHERE lines > 0""",
    "patch_placement": """
WITH docs AS (SELECT doc_id::varchar AS event_id, (len(string_split(text, chr(10))) + 5) // 11 AS m FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
SELECT event_id, 'd' || event_id AS file_path, m + 1 AS added, m AS removed, 1::bigint AS unlocated, m AS spans, 6 * m * (m - 1) + 7 * m AS starts FROM docs""",
    "look_credits": f"""{_COUNTS}
SELECT 'e3-' || file AS event_id, file, 1::bigint AS lines_generated, 0::bigint AS lines_reworked, 1::bigint AS spans FROM counts""",
    "content_credits": f"""{_COUNTS},
wrote AS (SELECT file, 's1-' || file AS session_id, kept AS n FROM counts UNION ALL SELECT file, 's2-' || file, inserted FROM counts)
SELECT c || '-' || file AS commit_id, session_id, CASE WHEN c = 'c2' THEN 0 ELSE n END AS lines_attributed, CASE WHEN c = 'c2' THEN n ELSE 0 END AS counted_before
FROM wrote, (VALUES ('c1'), ('c2'), ('c3')) v(c) WHERE n > 0""",
    "attribution_method": f"""{duck_base()},{_METHOD}
SELECT commit_id, file_path, by_content FROM chosen""",
    "attribute_by_method": f"""{duck_base()},{_METHOD},{_SPANS},
named AS (
  SELECT m.commit_id, m.file_path, u.line, t.session_id, row_number() OVER (PARTITION BY m.commit_id, m.file_path, u.line ORDER BY t.ts DESC, t.event_id DESC) AS r
  FROM taken_by t JOIN made m ON m.repo_id = t.repo_id AND m.file_path = t.file_path AND m.sec = t.next_at JOIN chosen c ON c.commit_id = m.commit_id AND c.file_path = m.file_path AND NOT c.by_content,
    unnest(range(t.start_line, least(t.end_line, m.lines_added) + 1)) AS u(line))
SELECT commit_id, session_id, false AS by_content, count(*) AS lines_attributed FROM named WHERE r = 1 GROUP BY commit_id, session_id
UNION ALL SELECT commit_id, 'by ' || file_path, true, lines_added // 2 FROM chosen WHERE by_content AND lines_added // 2 > 0""",
    "chain_pairs": f"""{duck_base()},
placed AS (SELECT id, repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY committed_at, id) AS n FROM commits)
SELECT a.id, b.id AS ancestor FROM placed a JOIN placed b ON a.repo_id = b.repo_id AND a.n - b.n IN (1, 7, 500)""",
    "uncommitted_ranges": f"""{duck_base()},{_SPANS}
SELECT repo_id, file_path, count(*) AS n, arg_min(event_id, {{'ts': ts, 'e': event_id}}) AS first_event, arg_max(event_id, {{'ts': ts, 'e': event_id}}) AS last_event FROM taken_by WHERE next_at IS NULL GROUP BY repo_id, file_path""",
}
