"""DuckDB SQL for the queries over sources: what was laid out, from the tables themselves."""

from chatloom.plans.oracles import EVENT, MESSAGE
from chatloom.plans.workflow_oracles import ORACLE_SQL as WORKFLOW_SQL

_SPACE = r"[\s\x{00a0}\x{2028}\x{2029}\x{3000}\x{feff}]"
_EXPORT = rf"""{MESSAGE}, export AS (SELECT CASE WHEN CAST(split_part(id, '-', 2) AS BIGINT) // 10 % 4 = 0 THEN 'group' ELSE 'direct' END AS kind, concat('conv', CAST(split_part(id, '-', 2) AS BIGINT) // 10) AS conversation, CAST(split_part(id, '-', 2) AS BIGINT) * 1000 + CAST(split_part(id, '-', 3) AS BIGINT) AS ord,
date_trunc('second', captured_ts) AS tm, coalesce(speaker, 'notice') AS speaker, speaker_role, coalesce(content, '') AS text FROM message)"""
_READ = rf"""WITH {_EXPORT} SELECT conversation, kind, speaker, speaker_role AS role, trim(regexp_replace(text, '{_SPACE}+', ' ', 'g')) AS content, tm AS captured_ts FROM export WHERE length(trim(regexp_replace(text, '{_SPACE}+', ' ', 'g'))) >= 2"""

ORACLE_SQL = {
    "json_export": _READ,
    "csv_export": _READ,
    "text_export": rf"""WITH {_EXPORT}, cut AS (SELECT *, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM export),
        told AS (SELECT conversation, kind, ord, n, tm, CASE WHEN n = 1 AND tm IS NOT NULL THEN speaker END AS speaker, trim(line, concat(chr(32), chr(9), chr(13))) AS content FROM cut WHERE trim(line, concat(chr(32), chr(9), chr(13))) <> ''),
        timed AS (SELECT *, last_value(CASE WHEN n = 1 THEN tm END IGNORE NULLS) OVER (PARTITION BY conversation ORDER BY ord, n) AS captured_ts FROM told)
        SELECT conversation, kind, speaker, 'unknown' AS role, content, captured_ts FROM timed WHERE length(content) >= 2""",
    "strict_json_export": "SELECT concat('event ', event_id) AS content, date_trunc('second', ts) AS captured_ts FROM events WHERE event_type <> 'error'",
    "segment_replay": """WITH o AS (SELECT CAST(day(ts) AS BIGINT) AS seq, event_id AS ord, event_type <> 'error' AS up, concat('k-', user_id * 10 + event_id % 5) AS id, value FROM events)
        SELECT id, value FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC, ord DESC) = 1 AND up""",
    "single_file_archives": f"WITH {MESSAGE} SELECT id, content, status FROM message",
    "work_logs": f"""WITH {MESSAGE}, r AS (SELECT id, content, CAST(split_part(id, '-', 2) AS BIGINT) AS conv, CAST(split_part(id, '-', 3) AS BIGINT) AS turn FROM message)
        SELECT id, concat('conv-', conv) AS conversation_id, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(turn AS INT)), '%Y-%m-%d %H:%M:%S') AS analyzed_at, content FROM r""",
    "device_stream": f"""WITH {EVENT} SELECT id, kind, title, strftime(date_trunc('second', start_ts), '%Y-%m-%dT%H:%M:%S.000Z') AS start_at, CASE WHEN date_trunc('second', end_ts) >= date_trunc('second', start_ts) THEN strftime(date_trunc('second', end_ts), '%Y-%m-%dT%H:%M:%S.000Z') END AS end_at, CAST(user_id AS VARCHAR) AS user FROM context_event""",
    "archive_follow": f"""WITH {EVENT} SELECT id, kind, start_ts, user_id, CASE WHEN user_id % 4 = 0 OR user_id % 2 = 1 THEN title ELSE 'first' END AS title FROM context_event WHERE user_id % 10 <> 0 OR user_id % 4 = 0""",
    "people_in_increments": WORKFLOW_SQL["people_merge"].replace("WHERE NOT list_contains(keys, 'conv-2')", ""),
}

_CHAT = rf"""WITH {MESSAGE}, r AS (SELECT *, CAST(split_part(id, '-', 2) AS BIGINT) AS conv, CAST(split_part(id, '-', 3) AS BIGINT) AS turn FROM message),
up AS (SELECT concat('m:acc:', conv, ':', turn) AS id, trim(replace(content, chr(13) || chr(10), chr(10)), concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))) AS content,
       strftime(date_trunc('second', coalesce(captured_ts, TIMESTAMP '2024-01-01 00:00:00')), '%Y-%m-%dT%H:%M:%S.000Z') AS captured_at, speaker_role, CASE WHEN conversation_kind IN ('direct', 'group') THEN conversation_kind ELSE 'unknown' END AS conversation_kind FROM r WHERE content IS NOT NULL AND length(content) > 0),
down AS (SELECT DISTINCT concat('m:acc:', conv, ':', turn + 1) AS id FROM r WHERE turn % 2 = 0)"""
ORACLE_SQL["chat_documents"] = f"{_CHAT} SELECT id, 'upsert' AS op, content, captured_at, speaker_role, conversation_kind FROM up UNION ALL SELECT id, 'delete', NULL, NULL, NULL, NULL FROM down WHERE id NOT IN (SELECT id FROM up)"
ORACLE_SQL["chat_stream"] = f"{_CHAT} SELECT * FROM up"
ORACLE_SQL["analysis_scopes"] = f"""WITH {MESSAGE}, r AS (SELECT *, length(key) % 5 <> 0 AND length(key) % 2 = 0 AS done_tasks, length(key) % 5 <> 0 AND right(key, 1) IN ('1', '3', '5', '7') AS done_people, own_kind = 'direct' AS direct, length(content) % 4 = 0 AS analyzed FROM keyed)
SELECT 'all' AS scope, id FROM r UNION ALL SELECT 'new', id FROM r WHERE status = 'new' UNION ALL SELECT 'pending+tasks', id FROM r WHERE status = 'new' AND NOT done_tasks AND NOT coalesce(analyzed, false)
UNION ALL SELECT 'pending+people', id FROM r WHERE status = 'new' AND direct AND NOT done_people UNION ALL SELECT 'pending+people+tasks', id FROM r WHERE status = 'new' AND (NOT done_tasks OR (direct AND NOT done_people))"""
