"""DuckDB SQL for the catalogue's queries, over the driver's raw tables. Patterns and word lists are those of the operators."""

from chatloom.functions import claims, normalize
from chatloom.operators import gates

_AT = "TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id * 6 AS INT)) + to_minutes(CAST(turn * 7 AS INT))"

MESSAGE = f"""message AS (
SELECT concat('m-', conv_id, '-', turn) AS id,
       CASE conv_id % 3 WHEN 0 THEN 'export-a' WHEN 1 THEN 'export-b' ELSE 'journal' END AS source,
       CASE WHEN conv_id % 10 = 9 THEN NULL ELSE concat('conv-', conv_id) END AS conversation_id,
       concat('Conversation ', conv_id) AS conversation_name,
       CASE conv_id % 4 WHEN 0 THEN 'group' WHEN 3 THEN 'unknown' ELSE 'direct' END AS conversation_kind,
       CASE role WHEN 'user' THEN 'me' WHEN 'assistant' THEN concat('peer-', conv_id % 7) ELSE NULL END AS speaker,
       CASE role WHEN 'user' THEN 'self' WHEN 'assistant' THEN 'other' ELSE 'unknown' END AS speaker_role,
       text AS content,
       CASE WHEN (conv_id + turn) % 23 = 0 THEN NULL ELSE {_AT} END AS captured_ts,
       CASE WHEN turn % 3 = 0 THEN 'reviewed' ELSE 'new' END AS status
FROM conversations),
keyed AS (SELECT *, coalesce(conversation_id, concat('legacy:', source, ':', coalesce(strftime(captured_ts, '%Y-%m'), 'undated'))) AS key,
       CASE WHEN conversation_kind <> 'unknown' THEN conversation_kind WHEN regexp_matches(concat(conversation_name, '/', coalesce(conversation_id, '')), '(?i)group|chatroom') THEN 'group'
            WHEN regexp_matches(concat(conversation_name, '/', coalesce(conversation_id, '')), '(?i)friend|direct|personal') THEN 'direct' ELSE 'unknown' END AS own_kind FROM message)"""

EVENT = """context_event AS (
SELECT concat('e-', event_id) AS id,
       CASE event_type WHEN 'view' THEN 'screen-time' WHEN 'purchase' THEN 'payment' WHEN 'click' THEN 'activity' WHEN 'error' THEN 'device' ELSE 'custom' END AS kind,
       ts AS start_ts,
       CASE WHEN event_type IN ('view', 'purchase') THEN ts + to_seconds(CAST(floor(value) AS BIGINT)) ELSE NULL END AS end_ts,
       user_id, event_type AS title
FROM events)"""

OPS = """op_log AS (
SELECT CAST(day(ts) AS BIGINT) AS seq, event_id AS ord, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op,
       concat('k-', user_id * 10 + event_id % 5) AS id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value
FROM events)"""

TASK = """task AS (
SELECT concat('t-', o_orderkey) AS id, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'available' ELSE 'done' END AS status,
       o_orderdate AS start_ts, CAST(c_nationkey AS BIGINT) AS location_id,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('t-', o_orderkey - 1) END AS parent_id, o_orderpriority AS title
FROM orders JOIN customer ON o_custkey = c_custkey)"""

CLAIM = f"""claim AS (
SELECT concat('peer-', conv_id % 7) AS person_id, CASE turn % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'preference' ELSE 'event' END AS kind,
       lower(text) AS claim_key, concat('m-', conv_id, '-', turn + again) AS source_id, {_AT} + to_days(CAST(again * 20 * (1 + conv_id % 2) AS INT)) AS observed_ts, CAST(length(text) % 17 AS BIGINT) AS score
FROM (SELECT *, unnest(range(0, turn % 3 + 1)) AS again FROM conversations WHERE role = 'assistant'))"""

CANDIDATE = """candidate AS (
SELECT concat('c-', conv_id, '-', turn, '-', pass) AS id, CAST(conv_id * 1000 + turn * 10 + pass AS BIGINT) AS ord, CASE pass WHEN 1 THEN concat(first, '!') WHEN 3 THEN concat('Again ', first) ELSE first END AS title,
       CASE pass WHEN 2 THEN concat('About ', first) ELSE substring(text, length(first) + 1) END AS description, concat('m-', conv_id, '-', turn + CASE WHEN pass = 1 THEN turn % 2 ELSE 0 END) AS source_id,
       CASE WHEN (turn + pass) % 3 = 0 THEN NULL ELSE concat('2024-01-0', 1 + (conv_id * pass) % 2) END AS start_at,
       CASE WHEN (turn + pass) % 4 = 0 THEN NULL WHEN (conv_id + pass) % 5 = 0 THEN 'North Library' WHEN (conv_id + pass) % 5 = 1 THEN 'Gym' ELSE 'Library' END AS place,
       CASE WHEN (turn + pass) % 2 = 0 THEN 'exact' ELSE 'approximate' END AS location_precision,
       CASE (turn + pass) % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'dismissed' ELSE 'created' END AS status
FROM (SELECT *, split_part(text, '.', 1) AS first, unnest([0, 1, 2, 3]) AS pass FROM conversations))"""

KEYED_CANDIDATE = CANDIDATE + """, k AS (SELECT *, lower(regexp_replace(title, '[\\p{P}\\p{S}\\s]+', '', 'g')) AS t, lower(regexp_replace(description, '[\\p{P}\\p{S}\\s]+', '', 'g')) AS d, replace(lower(coalesce(place, '')), ' ', '') AS p FROM candidate)"""

INDEX = f"""WITH {MESSAGE},
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY captured_ts NULLS LAST, id) AS nth,
                  row_number() OVER (PARTITION BY key ORDER BY (speaker_role = 'other') DESC, captured_ts DESC NULLS LAST, id DESC) AS shown FROM keyed),
idx AS (SELECT key, min(conversation_name) FILTER (nth = 1) AS name, min(own_kind) FILTER (nth = 1) AS kind, min(source) FILTER (nth = 1) AS source, count(*) AS messages,
       min(captured_ts) AS first_ts, max(captured_ts) AS last_ts, substring(min(content) FILTER (shown = 1), 1, 420) AS preview, min(speaker) FILTER (shown = 1) AS speaker
FROM ranked GROUP BY key)"""

_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, ord DESC) AS nth FROM op_log {where}) WHERE nth = 1)"
STATES = f"""WITH {OPS}, old AS (SELECT id, value FROM {_LATEST.format(where='WHERE seq <= 15')} WHERE op = 'upsert'), new AS (SELECT id, value FROM {_LATEST.format(where='')} WHERE op = 'upsert')"""

SIZED = f"""WITH RECURSIVE {EVENT},
sized AS (SELECT *, CAST(length(id) * 7 + length(kind) * 5 AS BIGINT) AS size, row_number() OVER (PARTITION BY user_id ORDER BY start_ts, id) - 1 AS place FROM context_event),
fold AS (SELECT user_id, place, id, size, start_ts, CAST(1 AS BIGINT) AS segment, CAST(1 AS BIGINT) AS n, size AS used FROM sized WHERE place = 0
  UNION ALL
  SELECT s.user_id, s.place, s.id, s.size, s.start_ts, CASE WHEN f.n >= 12 OR f.used + s.size > 900 THEN f.segment + 1 ELSE f.segment END,
         CASE WHEN f.n >= 12 OR f.used + s.size > 900 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 12 OR f.used + s.size > 900 THEN s.size ELSE f.used + s.size END
  FROM fold f JOIN sized s ON s.user_id = f.user_id AND s.place = f.place + 1)"""

PLAN = SIZED + """,
aged AS (SELECT *, epoch(TIMESTAMP '2024-04-01 00:00:00') - epoch(date_trunc('second', start_ts)) AS age FROM fold),
p AS (SELECT user_id, segment, count(*) AS rows, max(start_ts) < TIMESTAMP '2024-04-01 00:00:00' - INTERVAL 61 DAY AS historical,
  max(CASE WHEN age <= 3 * 86400 THEN 1 WHEN age <= 7 * 86400 THEN 0.92 WHEN age <= 14 * 86400 THEN 0.78 WHEN age <= 30 * 86400 THEN 0.62 WHEN age <= 60 * 86400 THEN 0.42
           WHEN age <= 120 * 86400 THEN 0.24 WHEN age <= 365 * 86400 THEN 0.1 ELSE 0.04 END) AS best FROM aged GROUP BY user_id, segment),
plan AS (SELECT user_id, segment, count(*) OVER (PARTITION BY user_id) AS segments, rows, historical, CAST(round(best + CASE WHEN historical THEN 0 ELSE 1 END, 2) AS DOUBLE) AS priority FROM p)"""

_PRINT = "sha256(concat_ws(chr(31), id, coalesce(strftime(captured_ts, '%Y-%m-%dT%H:%M:%S'), ''), coalesce(speaker, ''), coalesce(speaker_role, ''), coalesce(content, '')))"
PARTS = f"""parts AS (SELECT key, nth // 4096 AS block, count(*) AS n, sha256(string_agg(row, chr(30) ORDER BY nth)) AS part FROM (SELECT key, {_PRINT} AS row, row_number() OVER (PARTITION BY key ORDER BY captured_ts NULLS LAST, id) - 1 AS nth FROM keyed{{where}}) GROUP BY ALL)"""
PRINTS = f"""WITH {MESSAGE}, {PARTS.format(where='')}, prints AS (SELECT key, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(part, chr(30) ORDER BY block)) AS digest FROM parts GROUP BY key)"""

THREE = f"""WITH {OPS}, r AS (SELECT id, max(value) AS value FROM op_log WHERE op = 'upsert' GROUP BY id),
base AS (SELECT * FROM r WHERE CAST(floor(value) AS INT) % 7 <> 0),
local AS (SELECT id, CASE WHEN CAST(floor(value) AS INT) % 3 = 0 THEN value + 1 ELSE value END AS value FROM r WHERE CAST(floor(value) AS INT) % 5 <> 0),
remote AS (SELECT id, CASE WHEN CAST(floor(value) AS INT) % 2 = 0 THEN value + 2 ELSE value END AS value FROM r WHERE CAST(floor(value) AS INT) % 11 <> 0),
ids AS (SELECT id, b.id IS NOT NULL AS b, l.id IS NOT NULL AS l, m.id IS NOT NULL AS m, b.value AS bv, l.value AS lv, m.value AS mv
        FROM r LEFT JOIN base b USING (id) LEFT JOIN local l USING (id) LEFT JOIN remote m USING (id))"""

MERGED = f"""WITH {CLAIM}, d AS (SELECT DISTINCT ON (person_id, kind, claim_key, source_id) * FROM claim),
ranked AS (SELECT *, row_number() OVER (PARTITION BY person_id, kind, claim_key ORDER BY observed_ts, source_id) AS nth FROM d),
merged AS (SELECT person_id, kind, claim_key, string_agg(source_id, ',' ORDER BY nth) FILTER (nth <= 12) AS sources, count(*) AS n_sources, min(observed_ts) AS first_ts, max(observed_ts) AS last_ts,
       max(score) AS score, CASE WHEN count(*) > 1 THEN 'repeated' ELSE 'single' END AS strength FROM ranked GROUP BY ALL)"""

ORACLE_SQL = {
    "conversation_index": f"{INDEX} SELECT * FROM idx",
    "conversation_first_page": f"{INDEX} SELECT key, last_ts, messages FROM idx ORDER BY last_ts DESC NULLS LAST, key LIMIT 120",
    "conversation_search": f"{INDEX} SELECT key, name, source, messages FROM idx WHERE contains(lower(concat_ws(chr(10), name, key, source)), 'ation 1')",
    "keyset_page": f"""{INDEX} SELECT key, last_ts FROM idx WHERE last_ts < TIMESTAMP '2024-01-11 00:28:00' OR last_ts IS NULL OR (last_ts = TIMESTAMP '2024-01-11 00:28:00' AND key > 'conv-40')
        ORDER BY last_ts DESC NULLS LAST, key LIMIT 25""",
    "conversation_page": f"WITH {MESSAGE} SELECT id, captured_ts, speaker_role FROM keyed WHERE key = 'conv-12' ORDER BY captured_ts NULLS LAST, id LIMIT 200",
    "conversation_timeline": f"WITH {MESSAGE} SELECT key, count(*) AS messages, min(captured_ts) AS first_ts, max(captured_ts) AS last_ts, coalesce(strftime(max(captured_ts), '%Y-%m'), 'undated') AS bucket FROM keyed GROUP BY key",
    "timeline_buckets": f"WITH {MESSAGE}, t AS (SELECT count(*) AS n, coalesce(strftime(max(captured_ts), '%Y-%m'), 'undated') AS bucket FROM keyed GROUP BY key) SELECT bucket, count(*) AS conversations, CAST(sum(n) AS BIGINT) AS messages FROM t GROUP BY bucket",
    "archive_summary": f"""WITH {MESSAGE}, c AS (SELECT key, count(*) AS n, bool_or(conversation_id IS NOT NULL) AS identified, max(CASE WHEN own_kind <> 'unknown' THEN own_kind END) AS k FROM keyed GROUP BY key)
        SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS messages, count(*) FILTER (identified) AS identified, count(*) FILTER (NOT identified) AS fallback, count(*) FILTER (k = 'direct') AS direct, count(*) FILTER (k = 'group') AS groups, count(*) FILTER (k IS NULL) AS unknown FROM c""",
    "interaction_summary": f"""WITH {MESSAGE} SELECT speaker, count(DISTINCT id) AS messages, min(captured_ts) AS first_ts, max(captured_ts) AS last_ts, count(*) FILTER (speaker_role = 'self') AS n_self,
        count(*) FILTER (speaker_role = 'other') AS n_other, count(*) FILTER (speaker_role = 'unknown') AS n_unknown, count(DISTINCT key) AS conversations FROM keyed WHERE speaker IS NOT NULL GROUP BY speaker""",
    "direction_pivot": f"WITH {MESSAGE} SELECT key, count(*) FILTER (speaker_role = 'self') AS n_self, count(*) FILTER (speaker_role = 'other') AS n_other, count(*) FILTER (speaker_role = 'unknown') AS n_unknown FROM keyed GROUP BY key",
    "counterpart_mode": f"""WITH {MESSAGE}, c AS (SELECT key, speaker, count(*) AS n FROM keyed WHERE speaker_role = 'other' GROUP BY key, speaker)
        SELECT key, speaker, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, speaker) AS nth FROM c) WHERE nth = 1""",
    "unique_counterpart": f"WITH {MESSAGE} SELECT key, CASE WHEN count(DISTINCT speaker) FILTER (speaker_role = 'other') = 1 THEN min(speaker) FILTER (speaker_role = 'other') ELSE 'somebody' END AS speaker FROM keyed GROUP BY key",
    "fallback_people": f"""WITH {MESSAGE}, direct AS (SELECT * FROM keyed WHERE own_kind = 'direct'), c AS (SELECT key, speaker, count(*) AS n FROM direct WHERE speaker_role = 'other' GROUP BY key, speaker),
        best AS (SELECT key, speaker AS person FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, speaker) AS nth FROM c) WHERE nth = 1)
        SELECT person, count(DISTINCT key) AS conversations, count(*) AS messages FROM best JOIN direct USING (key) GROUP BY person""",
    "strict_time_range": f"WITH {MESSAGE} SELECT id, captured_ts FROM message WHERE captured_ts >= TIMESTAMP '2024-01-03' AND captured_ts < TIMESTAMP '2024-01-10'",
    "overlap_range": f"{INDEX} SELECT key, first_ts, last_ts FROM idx WHERE first_ts < TIMESTAMP '2024-01-10' AND last_ts >= TIMESTAMP '2024-01-03'",
    "newest_per_source": f"WITH {MESSAGE}, r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY captured_ts DESC NULLS LAST, id) AS rank, id FROM message) SELECT * FROM r WHERE rank <= 80",
    "source_counts": f"WITH {MESSAGE} SELECT source, status, count(*) AS messages, count(*) FILTER (captured_ts IS NULL) AS undated FROM message GROUP BY source, status",
    "op_log_current_state": f"WITH {OPS} SELECT id, value, seq FROM {_LATEST.format(where='')} WHERE op = 'upsert'",
    "change_feed": f"WITH {OPS} SELECT id, op, value FROM {_LATEST.format(where='WHERE seq > 20')}",
    "snapshot_diff": f"""{STATES} SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN 'delete' ELSE 'upsert' END AS op FROM old o FULL JOIN new n ON o.id = n.id
        WHERE n.id IS NULL OR o.id IS NULL OR o.value IS DISTINCT FROM n.value""",
    "effective_delta": f"""{STATES}, late AS (SELECT * FROM {_LATEST.format(where='WHERE seq > 15')}), ups AS (SELECT id, value FROM late WHERE op = 'upsert')
        SELECT u.id, 'upsert' AS op FROM ups u LEFT JOIN old o ON o.id = u.id WHERE o.id IS NULL OR o.value IS DISTINCT FROM u.value
        UNION ALL SELECT DISTINCT id, 'delete' FROM op_log WHERE seq > 15 AND op = 'delete' AND id NOT IN (SELECT id FROM ups) AND id IN (SELECT id FROM old)""",
    "event_upsert_counts": f"""{STATES} SELECT count(*) FILTER (o.id IS NULL) AS added, count(*) FILTER (o.value <> n.value) AS updated, count(*) FILTER (o.value = n.value) AS duplicate FROM new n LEFT JOIN old o USING (id)""",
    "conflict_reconcile": f"{STATES}, l AS (SELECT * FROM old WHERE value > 5) SELECT * FROM l UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM l)",
    "avatar_first_only": f"""WITH {MESSAGE} SELECT id, CASE WHEN row_number() OVER (PARTITION BY key, speaker ORDER BY captured_ts NULLS LAST, id) = 1 AND speaker IS NOT NULL THEN concat('http://a/', speaker) END AS avatar FROM keyed""",
    "retention_budget": """WITH RECURSIVE f AS (SELECT user_id, concat('f-', event_id) AS name, CAST(floor(value * 100) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, concat('f-', event_id)) AS nth FROM events),
        k AS (SELECT user_id, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS kept, CAST(0 AS BIGINT) AS bytes, '' AS names FROM f GROUP BY user_id
          UNION ALL SELECT f.user_id, f.nth, CASE WHEN kept < 20 AND k.bytes + f.bytes <= 15000 THEN kept + 1 ELSE kept END, CASE WHEN kept < 20 AND k.bytes + f.bytes <= 15000 THEN k.bytes + f.bytes ELSE k.bytes END,
                 CASE WHEN kept < 20 AND k.bytes + f.bytes <= 15000 THEN concat(names, ',', f.name) ELSE names END FROM k JOIN f ON f.user_id = k.user_id AND f.nth = k.nth + 1)
        SELECT user_id, kept, bytes, ltrim(names, ',') AS names FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY nth DESC) AS last FROM k) WHERE last = 1""",
    "archive_round_trip": f"WITH {EVENT} SELECT count(*) AS rows, count(DISTINCT id) AS ids, max(start_ts) AS latest, CAST(0 AS BIGINT) AS bad FROM context_event",
    "greedy_segments": f"{SIZED} SELECT id, user_id, place, segment FROM fold",
    "segment_overlap": SIZED + """, heads AS (SELECT user_id, segment, min(place) AS first_place FROM fold GROUP BY user_id, segment),
        back AS (SELECT h.user_id, h.segment, h.first_place, f.place, h.first_place - f.place AS dist, sum(f.size) OVER (PARTITION BY h.user_id, h.segment ORDER BY f.place DESC) AS used
                 FROM heads h JOIN fold f ON f.user_id = h.user_id AND f.place < h.first_place AND f.place >= h.first_place - 4),
        cut AS (SELECT user_id, segment, count(*) FILTER (dist = 1 OR used <= 200) AS n FROM back GROUP BY user_id, segment)
        SELECT user_id, segment, first_place, coalesce(n, 0) AS overlap FROM heads LEFT JOIN cut USING (user_id, segment)""",
    "segment_priority": f"{PLAN} SELECT * FROM plan",
    "segment_interleave": f"{PLAN}, t AS (SELECT *, CAST(sum(rows) OVER (PARTITION BY user_id) AS BIGINT) AS total FROM plan) SELECT user_id, segment, total, row_number() OVER (PARTITION BY segment ORDER BY total DESC, segments DESC, user_id) AS turn FROM t",
    "quarter_chunks": f"""WITH {EVENT}, n AS (SELECT user_id, strftime(date_trunc('quarter', start_ts), '%Y-%m') AS quarter, row_number() OVER (PARTITION BY user_id, date_trunc('quarter', start_ts) ORDER BY start_ts, id) - 1 AS nth FROM context_event)
        SELECT user_id, quarter, nth // 25 AS chunk, count(*) AS rows FROM n GROUP BY ALL""",
    "ref_ranges": """WITH r AS (SELECT DISTINCT o_orderstatus, CAST(o_orderkey AS BIGINT) AS ref FROM orders), i AS (SELECT *, ref - row_number() OVER (PARTITION BY o_orderstatus ORDER BY ref) AS island FROM r),
        g AS (SELECT o_orderstatus, min(ref) AS low, max(ref) AS high FROM i GROUP BY o_orderstatus, island) SELECT o_orderstatus, string_agg(CASE WHEN low = high THEN CAST(low AS VARCHAR) ELSE concat(low, '-', high) END, ', ' ORDER BY low) AS ranges FROM g GROUP BY o_orderstatus""",
    "incremental_context": f"""WITH {MESSAGE}, r AS (SELECT *, id LIKE '%-5' AS new FROM keyed) SELECT id, key, new FROM (SELECT *, bool_or(new) OVER (PARTITION BY key ORDER BY captured_ts NULLS LAST, id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS near FROM r) WHERE near""",
    "full_conversation_semi": f"WITH {MESSAGE} SELECT id, key FROM keyed WHERE key IN (SELECT key FROM keyed WHERE length(content) % 11 = 0)",
    "carry_forward_time": f"WITH {MESSAGE} SELECT id, last_value(captured_ts IGNORE NULLS) OVER (PARTITION BY key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS captured_ts FROM keyed",
    "conversation_fingerprint": f"{PRINTS} SELECT * FROM prints",
    "complete_coverage": f"WITH {MESSAGE} SELECT key, count(*) AS rows FROM keyed GROUP BY key HAVING bool_and(length(content) % 9 <> 0)",
    "pending_rows": f"""{PRINTS}, {PARTS.format(where=' WHERE length(content) % 13 <> 0').replace('parts AS', 'old_parts AS')}, seen AS (SELECT key, sha256(string_agg(part, chr(30) ORDER BY block)) AS digest FROM old_parts GROUP BY key)
        SELECT count(*) AS conversations, CAST(coalesce(sum(p.rows), 0) AS BIGINT) AS messages FROM prints p LEFT JOIN seen s USING (key) WHERE s.key IS NULL OR s.digest <> p.digest""",
    "event_interval_overlap": f"""WITH {EVENT}, spans AS (SELECT user_id, id AS span, start_ts AS first_ts, start_ts + INTERVAL 2 HOUR AS last_ts FROM context_event WHERE kind = 'activity')
        SELECT span, count(*) AS events, min(e.id) AS first_event FROM spans s JOIN context_event e ON e.user_id = s.user_id AND e.start_ts <= s.last_ts AND coalesce(e.end_ts, e.start_ts) >= s.first_ts GROUP BY span""",
    "privacy_projection": f"WITH {EVENT} SELECT id, CASE WHEN kind = 'device' THEN 'location' ELSE kind END AS kind, start_ts, end_ts, CASE WHEN kind <> 'device' THEN title END AS title FROM context_event",
    "place_active_counts": f"WITH {TASK} SELECT CAST(n_nationkey AS BIGINT) AS place_id, n_name AS name, count(id) FILTER (status NOT IN ('done', 'locked')) AS active FROM nation LEFT JOIN task ON location_id = n_nationkey GROUP BY ALL",
    "task_children_detached": f"""WITH {TASK}, gone AS (SELECT id FROM task WHERE status = 'done' AND parent_id IS NULL)
        SELECT id, status, CASE WHEN parent_id IN (SELECT id FROM gone) THEN NULL ELSE parent_id END AS parent_id FROM task WHERE id NOT IN (SELECT id FROM gone)""",
    "dangling_cleanup": f"""WITH {TASK}, known AS (SELECT id FROM task WHERE status <> 'done'), x AS (SELECT id, unnest([coalesce(parent_id, 'none'), id, concat(id, 'x')]) AS one, unnest([1, 2, 3]) AS pos FROM task)
        SELECT task.id, coalesce(string_agg(one, ',' ORDER BY pos), '') AS people FROM task LEFT JOIN (SELECT * FROM x WHERE one IN (SELECT id FROM known)) x ON x.id = task.id GROUP BY task.id""",
    "substring_match": """WITH n AS (SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN concat('Office NATION_', s_nationkey) WHEN 1 THEN concat('nation _', s_nationkey, ' branch') WHEN 2 THEN 'ATION_' || s_nationkey % 3 ELSE 'nowhere' END AS name FROM supplier),
        m AS (SELECT name, n_name AS place, CAST(n_nationkey AS BIGINT) AS place_id, row_number() OVER (PARTITION BY name ORDER BY n_nationkey) AS nth FROM n JOIN nation
              ON contains(replace(lower(name), ' ', ''), replace(lower(n_name), ' ', '')) OR contains(replace(lower(n_name), ' ', ''), replace(lower(name), ' ', ''))) SELECT name, place, place_id FROM m WHERE nth = 1""",
    "task_person_links": f"""WITH {MESSAGE}, people AS (SELECT concat('p-', id) AS person, concat('peer-', id) AS name, CASE WHEN id % 2 = 0 THEN concat('conv-', id * 3) END AS key FROM range(7) t(id)),
        cited AS (SELECT concat('t-', conv_id) AS task, k.* FROM conversations c JOIN keyed k ON k.id = concat('m-', conv_id, '-', turn))
        SELECT DISTINCT task, person FROM cited JOIN people ON (speaker_role = 'other' AND speaker = name) OR cited.key = people.key""",
    "claim_merge": f"{MERGED} SELECT * FROM merged",
    "claim_scope_summary": f"""WITH {CLAIM}, s AS (SELECT *, CASE WHEN observed_ts >= TIMESTAMP '2024-01-20' - INTERVAL 30 DAY THEN 'recent' ELSE 'historical' END AS scope FROM claim),
        g AS (SELECT person_id, count(*) FILTER (scope = 'recent') AS n_recent, count(*) FILTER (scope = 'historical') AS n_historical, count(*) FILTER (scope = 'undated') AS n_undated,
          count(DISTINCT source_id) FILTER (scope = 'recent') AS sources_recent, count(DISTINCT source_id) FILTER (scope = 'historical') AS sources_historical,
          CAST(date_diff('day', CAST(max(observed_ts) AS DATE), DATE '2024-01-20') AS BIGINT) AS latest_days FROM s GROUP BY person_id)
        SELECT *, CASE WHEN n_recent = 0 THEN 'none' WHEN n_recent < 6 OR sources_recent < 4 THEN 'limited' ELSE 'available' END AS status FROM g""",
    "claim_stability": f"""{MERGED} SELECT person_id, kind, claim_key, CASE WHEN n_sources >= 3 OR (n_sources >= 2 AND epoch(last_ts) - epoch(first_ts) >= 30 * 86400) THEN 'persistent'
        WHEN n_sources >= 2 THEN 'repeated' ELSE 'single' END AS stability FROM merged""",
    "evidence_clusters": f"""WITH {CLAIM}, o AS (SELECT concat(source_id, kind) AS obs, person_id AS participant, CASE WHEN score % 5 = 0 THEN 'needs-review' WHEN score % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS v, concat('s-', substring(source_id, 3, 2)) AS source_id FROM claim)
        SELECT source_id, count(DISTINCT obs) AS observations, count(DISTINCT participant) AS participants,
          CASE WHEN bool_and(v = 'rejected') THEN 'rejected' WHEN bool_or(v = 'needs-review') THEN 'needs-review' WHEN count(DISTINCT participant) >= 2 THEN 'corroborated' ELSE 'single-source' END AS state FROM o GROUP BY source_id""",
    "best_claim_per_month": f"""WITH {CLAIM}, r AS (SELECT *, strftime(observed_ts, '%Y-%m') AS month FROM claim)
        SELECT person_id, month, source_id, score FROM (SELECT *, row_number() OVER (PARTITION BY person_id, month ORDER BY score DESC, observed_ts, source_id) AS nth FROM r) WHERE nth = 1""",
    "profile_workset": f"""WITH {CLAIM}, r AS (SELECT *, CASE WHEN score % 4 = 0 THEN 'repeated' ELSE 'single' END AS strength, score % 6 <> 2 AS fit, score % 6 < 2 AS near, row_number() OVER (PARTITION BY person_id ORDER BY observed_ts, source_id) AS place,
          count(*) OVER (PARTITION BY person_id) AS total FROM claim),
        m AS (SELECT *, row_number() OVER (PARTITION BY person_id, strftime(observed_ts, '%Y-%m') ORDER BY fit DESC, score DESC, place) = 1 AND fit AS best FROM r),
        one AS (SELECT person_id, place FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY score DESC, place DESC) AS k FROM m WHERE total > 20 AND fit AND (kind = 'event' OR near)) WHERE k <= 8),
        two AS (SELECT * FROM one UNION ALL SELECT person_id, place FROM (SELECT m.*, row_number() OVER (PARTITION BY person_id ORDER BY place) AS k FROM m WHERE total > 20 AND best AND (person_id, place) NOT IN (SELECT (person_id, place) FROM one)) x
          WHERE k + (SELECT count(*) FROM one WHERE one.person_id = x.person_id) <= 12),
        three AS (SELECT * FROM two UNION ALL SELECT person_id, place FROM (SELECT m.*, row_number() OVER (PARTITION BY person_id ORDER BY score DESC, place DESC) AS k FROM m WHERE total > 20 AND fit AND observed_ts >= TIMESTAMP '2024-01-20' - INTERVAL 30 DAY AND (person_id, place) NOT IN (SELECT (person_id, place) FROM two)) x
          WHERE k + (SELECT count(*) FROM two WHERE two.person_id = x.person_id) <= 15),
        four AS (SELECT * FROM three UNION ALL SELECT person_id, place FROM (SELECT m.*, row_number() OVER (PARTITION BY person_id ORDER BY score DESC, place DESC) AS k FROM m WHERE total > 20 AND strength = 'repeated' AND (person_id, place) NOT IN (SELECT (person_id, place) FROM three)) x
          WHERE k + (SELECT count(*) FROM three WHERE three.person_id = x.person_id) <= 17),
        five AS (SELECT * FROM four UNION ALL SELECT person_id, place FROM (SELECT m.*, row_number() OVER (PARTITION BY person_id ORDER BY score DESC, place) AS k FROM m WHERE total > 20 AND (person_id, place) NOT IN (SELECT (person_id, place) FROM four)) x
          WHERE k + (SELECT count(*) FROM four WHERE four.person_id = x.person_id) <= 20)
        SELECT person_id, source_id, place FROM r WHERE total <= 20 OR (person_id, place) IN (SELECT (person_id, place) FROM five)""",
    "verified_claims": f"""WITH {MESSAGE}, c AS (SELECT concat('q-', conv_id, '-', turn) AS claim_id, lower(regexp_replace(substring(text, 3, 9), '\\s+', '', 'g')) AS needle, unnest([concat('m-', conv_id, '-', turn), concat('m-', conv_id, '-', turn + 1)]) AS id FROM conversations),
        f AS (SELECT DISTINCT claim_id, m.id, captured_ts FROM c JOIN message m USING (id) WHERE speaker_role = 'other' AND length(needle) > 0 AND contains(lower(regexp_replace(content, '\\s+', '', 'g')), needle))
        SELECT claim_id, string_agg(id, ',' ORDER BY id) AS source_ids, min(captured_ts) AS first_ts FROM f GROUP BY claim_id""",
    "three_way_merge": f"""{THREE} SELECT id, CASE WHEN l AND (NOT b OR bv <> lv) THEN lv ELSE mv END AS value, CASE WHEN l AND (NOT b OR bv <> lv) THEN 'local' ELSE 'remote' END AS side
        FROM ids WHERE NOT (b AND (NOT l OR NOT m)) AND ((l AND (NOT b OR bv <> lv)) OR m)""",
    "three_way_set": f"{THREE} SELECT id FROM ids WHERE (m AND NOT (b AND NOT l)) OR (l AND NOT b)",
    "three_way_map": f"{THREE} SELECT id, CASE WHEN l AND (NOT b OR bv <> lv) THEN lv ELSE mv END AS value FROM ids WHERE NOT (b AND NOT l) AND ((l AND (NOT b OR bv <> lv)) OR m)",
    "manual_retain": f"""WITH {MESSAGE} SELECT id, source, status FROM message WHERE source = 'journal' UNION ALL SELECT id, source, 'imported' FROM message WHERE length(id) % 2 = 0 AND source <> 'journal'""",
    "candidate_dup_pairs": f"""WITH {KEYED_CANDIDATE}, c AS (SELECT t, d, p, source_id, start_at, place, location_precision, min(ord) AS ord, arg_min(id, ord) AS first FROM k GROUP BY ALL),
        td AS (SELECT t, d, p, start_at, place, location_precision, min(ord) AS ord, arg_min(first, ord) AS id FROM c GROUP BY ALL), st AS (SELECT source_id, t, p, start_at, place, location_precision, min(ord) AS ord, arg_min(first, ord) AS id FROM c GROUP BY ALL),
        sd AS (SELECT source_id, d, p, start_at, place, location_precision, min(ord) AS ord, arg_min(first, ord) AS id FROM c GROUP BY ALL),
        met AS (SELECT a.id AS first, b.id AS second, a.start_at AS s1, b.start_at AS s2, a.p AS p1, b.p AS p2, a.location_precision AS l1, b.location_precision AS l2 FROM td a JOIN td b USING (t, d) WHERE a.ord < b.ord
          UNION ALL SELECT a.id, b.id, a.start_at, b.start_at, a.p, b.p, a.location_precision, b.location_precision FROM st a JOIN st b USING (source_id, t) WHERE a.ord < b.ord
          UNION ALL SELECT a.id, b.id, a.start_at, b.start_at, a.p, b.p, a.location_precision, b.location_precision FROM sd a JOIN sd b USING (source_id, d) WHERE a.ord < b.ord),
        links AS (SELECT first, second FROM met WHERE NOT coalesce(s1 <> s2, false) AND NOT (p1 <> '' AND p2 <> '' AND NOT contains(p1, p2) AND NOT contains(p2, p1) AND l1 = 'exact' AND l2 = 'exact')
          UNION SELECT x.id, c.first FROM c JOIN td x ON x.t = c.t AND x.d = c.d AND x.start_at IS NOT DISTINCT FROM c.start_at AND x.place IS NOT DISTINCT FROM c.place AND x.location_precision = c.location_precision WHERE x.id <> c.first
          UNION SELECT x.id, c.first FROM c JOIN st x ON x.t = c.t AND x.source_id = c.source_id AND x.start_at IS NOT DISTINCT FROM c.start_at AND x.place IS NOT DISTINCT FROM c.place AND x.location_precision = c.location_precision WHERE x.id <> c.first
          UNION SELECT x.id, c.first FROM c JOIN sd x ON x.d = c.d AND x.source_id = c.source_id AND x.start_at IS NOT DISTINCT FROM c.start_at AND x.place IS NOT DISTINCT FROM c.place AND x.location_precision = c.location_precision WHERE x.id <> c.first)
        SELECT first, second, 'same' AS link FROM links
        UNION ALL SELECT c.first, k.id, 'member' FROM k JOIN c ON c.t = k.t AND c.d = k.d AND c.source_id = k.source_id AND c.start_at IS NOT DISTINCT FROM k.start_at AND c.place IS NOT DISTINCT FROM k.place AND c.location_precision = k.location_precision WHERE k.id <> c.first""",
    "candidate_gate_counts": f"""WITH {MESSAGE}, said AS (SELECT id, speaker_role, captured_ts, CASE length(content) % 5 WHEN 0 THEN concat('请你 ', content) WHEN 1 THEN concat('我请你 ', content) WHEN 2 THEN concat('我请他 ', content) WHEN 3 THEN concat('2024年3月5日 ', content) ELSE content END AS content FROM message),
        c AS (SELECT concat('g-', conv_id, '-', turn) AS id, CASE (conv_id + turn) % 6 WHEN 0 THEN concat('取快递 ', split_part(text, '.', 1)) WHEN 1 THEN concat('提交问卷 ', split_part(text, '.', 1)) WHEN 2 THEN '之后请你喝咖啡' WHEN 3 THEN 'x' ELSE split_part(text, '.', 1) END AS title,
          CASE WHEN turn % 5 = 4 THEN ' y ' ELSE text END AS description, CASE WHEN conv_id % 8 = 0 THEN ['m-none'] ELSE [concat('m-', conv_id, '-', turn), concat('m-', conv_id, '-', turn + 1)] END AS sources,
          CASE (conv_id + 2 * turn) % 7 WHEN 1 THEN TIMESTAMP '2024-01-05' WHEN 2 THEN TIMESTAMP '2024-03-01' END AS starts, CASE (conv_id + turn) % 5 WHEN 0 THEN TIMESTAMP '2024-02-20 23:59:59' WHEN 1 THEN TIMESTAMP '2024-01-30 23:59:59' END AS due FROM conversations),
        proof AS (SELECT c.id, bool_or(speaker_role = 'self' OR (speaker_role = 'other' AND regexp_matches(content, '{gates.DIRECT}'))) AS owned, max(captured_ts) AS latest, bool_or(speaker_role = 'other' AND regexp_matches(content, '{gates.OTHER_OFFERS}')) AS other_offers,
          bool_or(speaker_role = 'self' AND regexp_matches(content, '{gates.SELF_OFFERS}')) AS self_offers, bool_or(captured_ts IS NOT NULL OR regexp_matches(content, '{gates.ABSOLUTE_DATE}')) AS anchored
          FROM (SELECT id, unnest(sources) AS source FROM c) c JOIN said ON said.id = c.source GROUP BY c.id),
        j AS (SELECT *, greatest(0, (epoch(TIMESTAMP '2024-02-10') - epoch(latest)) / 86400) AS age, concat_ws(' ', title, description) AS t FROM c LEFT JOIN proof USING (id)),
        g AS (SELECT CASE WHEN owned IS NULL THEN 'evidence' WHEN NOT owned THEN 'ownership' WHEN NOT anchored THEN 'time' WHEN length(trim(title)) < 2 OR length(trim(description)) < 2 THEN 'shape'
            WHEN CASE WHEN due < TIMESTAMP '2024-02-10' THEN true WHEN starts < TIMESTAMP '2024-02-10' AND (due IS NULL OR due < TIMESTAMP '2024-02-10') THEN true WHEN starts >= TIMESTAMP '2024-02-10' OR due >= TIMESTAMP '2024-02-10' THEN false
                 WHEN regexp_matches(t, '{gates.TRANSIENT}') AND age > 4 THEN true WHEN regexp_matches(t, '{gates.SUBMISSION}') AND due IS NULL AND age > 30 THEN true ELSE false END THEN 'expired'
            WHEN other_offers AND NOT self_offers AND regexp_matches(title, '{gates.REVERSED_TITLE}') THEN 'direction' ELSE 'accepted' END AS reason FROM j) SELECT reason, count(*) AS candidates FROM g GROUP BY reason""",
    "message_relevance": f"""WITH {MESSAGE}, a AS (SELECT id, captured_ts, epoch(TIMESTAMP '2024-02-20') - epoch(captured_ts) AS age FROM message)
        SELECT id, CAST(CASE WHEN captured_ts IS NULL THEN 0.08 WHEN age <= 3 * 86400 THEN 1 WHEN age <= 7 * 86400 THEN 0.92 WHEN age <= 14 * 86400 THEN 0.78 WHEN age <= 30 * 86400 THEN 0.62 WHEN age <= 60 * 86400 THEN 0.42
            WHEN age <= 120 * 86400 THEN 0.24 WHEN age <= 365 * 86400 THEN 0.1 ELSE 0.04 END AS DOUBLE) AS relevance FROM a""",
    "normalized_times": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT08:05:00') WHEN 1 THEN strftime(ts, '%Y-%m-%dT07:30:00') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 3 THEN strftime(ts, '%Y-%m-%d') END AS captured_at FROM events""",
    "counterpart_identity": f"""WITH {MESSAGE}, others AS (SELECT * FROM keyed WHERE speaker_role = 'other'), n AS (SELECT DISTINCT key, concat('peer-', length(key) % 7) AS who FROM keyed)
        SELECT o.id, o.key, 'speaker' AS basis FROM others o JOIN n ON n.key = o.key AND n.who = o.speaker""",
    "dismissed_people": f"""WITH {MESSAGE}, p AS (SELECT DISTINCT speaker AS id, key FROM keyed WHERE speaker_role = 'other')
        SELECT id, count(*) AS conversations FROM p WHERE id NOT IN (SELECT id FROM p WHERE key IN ('conv-12', 'conv-15')) GROUP BY id""",
    "observation_merge": f"""WITH {CLAIM} SELECT concat(person_id, ':', kind) AS id, count(DISTINCT (source_id, claim_key)) AS evidence, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS sources, min(observed_ts) AS from_ts, max(observed_ts) AS to_ts FROM claim GROUP BY 1""",
    "block_times": f"""WITH {CLAIM}, s AS (SELECT *, observed_ts >= TIMESTAMP '2024-02-12' - INTERVAL 30 DAY AS recent FROM claim)
        SELECT person_id, kind, CASE WHEN bool_or(recent) AND bool_or(NOT recent) THEN 'change' WHEN bool_or(recent) THEN 'recent' ELSE 'historical' END AS scope, min(observed_ts) AS from_ts, max(observed_ts) AS to_ts FROM s GROUP BY person_id, kind""",
    "portrait_coverage": f"""WITH {CLAIM} SELECT person_id, count(DISTINCT (kind, claim_key)) AS claims, count(DISTINCT source_id) AS sources, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, min(observed_ts) AS from_ts, max(observed_ts) AS to_ts FROM claim GROUP BY person_id""",
    "latest_per_user": f"""WITH {EVENT} SELECT user_id, kind, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY start_ts DESC, id DESC) AS nth FROM context_event) WHERE nth = 1""",
    "carry_over": f"""{STATES} SELECT coalesce(n.id, o.id) AS id, coalesce(n.value, o.value) AS value FROM old o FULL JOIN new n ON o.id = n.id""",
    "model_passes": """WITH p AS (SELECT p_partkey AS ord, concat('x-', p_partkey) AS id, CASE WHEN p_size % 4 = 0 THEN 'judge' ELSE 'extractor' END AS role, CASE WHEN p_size % 2 = 0 THEN 'people' ELSE 'tasks' END AS workflow, p_size > 10 AS enabled FROM part)
        SELECT id, role FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY ord) AS nth FROM p WHERE enabled AND workflow = 'people') WHERE nth <= CASE WHEN role = 'judge' THEN 1 ELSE 3 END""",
    "pass_agreement": f"""WITH {CANDIDATE} SELECT concat(title, '|', description) AS candidate, count(DISTINCT source_id) AS passes, CASE WHEN count(DISTINCT source_id) >= 2 THEN 'consensus' ELSE 'needs-review' END AS agreement FROM candidate GROUP BY 1""",
    "attachment_totals": """SELECT count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, CAST(coalesce(sum(CASE WHEN doc_id % 4 = 1 THEN ceil(n_chars / 3) END), 0) AS BIGINT) AS text_tokens, count(*) FILTER (doc_id % 4 = 0) AS images, count(*) FILTER (doc_id % 4 > 1) AS binaries FROM documents""",
    "sleep_and_mood": """SELECT event_id, CASE WHEN event_id % 7 BETWEEN 1 AND 5 THEN event_id % 7 END AS mood, floor(greatest(0, least(24, value)) * 2 + 0.5) / 2 AS hours FROM events""",
    "relative_labels": f"""WITH {MESSAGE}, d AS (SELECT id, captured_ts, floor((epoch(TIMESTAMP '2024-01-20') - epoch(captured_ts)) / 86400) AS d, ceil((epoch(captured_ts) - epoch(TIMESTAMP '2024-01-20')) / 86400) AS a FROM message)
        SELECT id, CASE WHEN captured_ts IS NULL THEN '时间未记录' WHEN d < 0 AND a = 1 THEN '明天' WHEN d < 0 THEN concat(CAST(a AS BIGINT), ' 天后') WHEN d = 0 THEN '今天' WHEN d = 1 THEN '昨天' WHEN d < 30 THEN concat(CAST(d AS BIGINT), ' 天前')
          WHEN d < 365 THEN concat(CAST(floor(d / 30) AS BIGINT), ' 个月前') ELSE concat(CAST(floor(d / 365) AS BIGINT), ' 年前') END AS label FROM d""",
    "search_radii": """SELECT s_suppkey, CASE WHEN s_suppkey % 50 > 0 OR s_suppkey % 30 > 0 THEN CAST(floor(least(100000, greatest(120, greatest(0.01 * (s_suppkey % 50) * 111320, 0.02 * (s_suppkey % 30) * 111320 * greatest(0.2, cos(radians(s_nationkey * 3.0)))) / 2)) + 0.5) AS BIGINT) END AS radius FROM supplier""",
}

_HAY = r"lower(regexp_replace(concat(text, ' ', text), '\s+', '', 'g'))"
_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(hay, '{words}') THEN '{name}'" for name, words in claims.CATEGORIES) + " WHEN kind = 'preference' THEN 'preference' ELSE 'background' END"
_ACTION = " + ".join(f"CASE WHEN contains(low, '{w}') THEN {2 if len(w) > 1 else 1} ELSE 0 END" for w in gates.ACTION_WORDS)
_NOISE = " OR ".join(f"trim(low) = '{w}' OR (length(low) < 18 AND starts_with(low, '{w}'))" for w in gates.NOISE_WORDS)
_PHRASES = "['', '不要再打扰', '喜欢爬山', '经常散步', '在学校工作', '一起吃饭', '擅长画画', '明天取件', '好的']"
_SUBJECTS = "['', '恋爱 ', '选课 ', '聚会 ', '作业 ', '医院 ', '系统: ', 'WeChat：约会 ']"
_KEY = r"lower(regexp_replace(content, '\s+', '', 'g'))"

ORACLE_SQL |= {
    "claim_scores": rf"""{MERGED}, s AS (SELECT person_id, kind, claim_key, n_sources, first_ts, last_ts, concat({_PHRASES}[(score % 9) + 1], claim_key) AS text FROM merged), h AS (SELECT *, {_HAY} AS hay, trim(text) AS said,
          CASE WHEN n_sources >= 3 OR (n_sources >= 2 AND epoch(last_ts) - epoch(first_ts) >= 30 * 86400) THEN 6 WHEN n_sources >= 2 THEN 4 ELSE 0 END AS steady FROM s), c AS (SELECT *, {_CATEGORY} AS category FROM h)
        SELECT person_id, kind, claim_key, category, CASE kind WHEN 'preference' THEN 5 WHEN 'event' THEN 8 ELSE 2 END + steady + CASE WHEN regexp_matches(hay, '{claims.LIKING}') THEN 3 ELSE 0 END + CASE WHEN length(said) >= 8 THEN 1 ELSE 0 END
          - CASE WHEN regexp_matches(said, '{claims.FILLER}') THEN 6 ELSE 0 END - CASE WHEN category IN ('temporary', 'filler') THEN 6 ELSE 0 END + CASE WHEN category IN ('interaction', 'boundary') THEN 3 ELSE 0 END AS score FROM c""",
    "task_atlas": rf"""WITH {MESSAGE}, s AS (SELECT concat({_SUBJECTS}[length(content) % 8 + 1], content) AS t FROM message), p AS (SELECT t, nullif(trim(regexp_extract(t, '^([^:：\n]{{1,48}})[:：]\s*', 1)), '') AS who FROM s)
        SELECT CASE {" ".join(f"WHEN regexp_matches(t, '{words}') THEN '{name}'" for name, words in normalize.TASK_CATEGORIES)} ELSE 'life' END AS category, count(*) AS tasks,
          count(CASE WHEN lower(who) NOT IN ({", ".join(f"'{w}'" for w in normalize.NO_PROVIDER)}) THEN 1 END) AS provided FROM p GROUP BY category""",
    "fnv_ids": rf"""WITH {MESSAGE} SELECT id, lower(to_base(CAST(list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), list_transform(string_split(id, ''), lambda c: CAST(unicode(c) AS UBIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS BIGINT), 36)) AS hash,
        length(content) + length(regexp_replace(content, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) AS units FROM message""",
    "text_keys": rf"""WITH {MESSAGE}, k AS (SELECT id, content, {_KEY} AS t FROM message), r AS (SELECT *, list_filter(list_concat(list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substring(t, i, 3)), list_transform(range(1, greatest(length(t), 1)), lambda i: substring(t, i, 2))), lambda g: regexp_matches(g, '^[\x{{4e00}}-\x{{9fff}}A-Za-z0-9]+$')) AS g FROM k)
        SELECT id, t AS text_key, lower(regexp_replace(content, '[\p{{P}}\p{{S}}\s]+', '', 'g')) AS compact, array_to_string(list_filter(g, lambda x, i: list_position(g, x) = i)[1:36], '|') AS grams FROM r""",
    "action_score_top": rf"""WITH {MESSAGE}, s AS (SELECT id, captured_ts, concat(CASE WHEN length(content) % 5 = 0 THEN '记得明天提交 ' ELSE '' END, content) AS content FROM message), l AS (SELECT *, lower(content) AS low FROM s),
        a AS (SELECT *, {_ACTION} + CASE WHEN regexp_matches(low, '{gates.DATED}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(low, '{gates.ASKING}') THEN 1 ELSE 0 END + CASE WHEN length(low) BETWEEN 15 AND 220 THEN 1 ELSE 0 END - CASE WHEN {_NOISE} THEN 4 ELSE 0 END AS score FROM l),
        n AS (SELECT *, row_number() OVER (PARTITION BY substring(lower(regexp_replace(content, '[\s\p{{P}}\p{{S}}]+', '', 'g')), 1, 120) ORDER BY score DESC, captured_ts DESC NULLS LAST, id) AS nth FROM a WHERE score >= 3 AND length(trim(content)) >= 8)
        SELECT id, CAST(score AS BIGINT) AS score FROM n WHERE nth = 1 ORDER BY n.score DESC, captured_ts DESC NULLS LAST, id LIMIT 100""",
    "conversation_segments": rf"""WITH RECURSIVE {MESSAGE}, sized AS (SELECT key, greatest(64, 16 + CASE WHEN captured_ts IS NULL THEN 4 ELSE 21 END + length(CAST(to_json(coalesce(nullif(substring(trim(content), 1, 3000), ''), '[non-text message]')) AS VARCHAR)) + length(coalesce(speaker_role, 'unknown'))) AS size,
          row_number() OVER (PARTITION BY key ORDER BY captured_ts NULLS LAST, id) - 1 AS place FROM keyed),
        fold AS (SELECT key, place, size, CAST(1 AS BIGINT) AS segment, CAST(1 AS BIGINT) AS n, CAST(size AS BIGINT) AS used FROM sized WHERE place = 0
          UNION ALL SELECT s.key, s.place, s.size, CASE WHEN n >= 3 OR used + s.size > 1500 THEN segment + 1 ELSE segment END, CASE WHEN n >= 3 OR used + s.size > 1500 THEN 1 ELSE n + 1 END, CASE WHEN n >= 3 OR used + s.size > 1500 THEN s.size ELSE used + s.size END
          FROM fold f JOIN sized s ON s.key = f.key AND s.place = f.place + 1) SELECT key, segment, count(*) AS rows, min(place) AS first_place FROM fold GROUP BY key, segment""",
}
