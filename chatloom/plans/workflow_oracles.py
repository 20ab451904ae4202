"""DuckDB SQL for the queries of the workflows."""

from chatloom.plans.oracles import CANDIDATE, CLAIM, EVENT, KEYED_CANDIDATE, MESSAGE, TASK


def fnv(text: str) -> str:
    units = f"list_transform(string_split({text}, ''), lambda c: CAST(unicode(c) AS UBIGINT))"
    return f"lower(to_base(CAST(list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), {units}), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS BIGINT), 36))"


MODEL = f"""WITH {MESSAGE}, model AS (SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY captured_ts NULLS LAST, id) AS VARCHAR) AS ref, id, speaker_role AS role,
       coalesce(substring(coalesce(nullif(trim(CASE WHEN regexp_matches(id, '-[13]$') THEN '  ' ELSE content END), ''), CASE WHEN id LIKE '%-3' THEN concat('note ', id) END), 1, 3000), '[non-text message]') AS content FROM keyed)"""

OBSERVED = f"""WITH {MESSAGE}, o AS (SELECT concat('o-', conv_id, '-', turn) AS observation, unnest([concat('m-', conv_id, '-', turn), concat('m-', conv_id, '-', turn + 1)]) AS id, trim(unnest([substring(text, 2, 12), substring(text, 2, 3)])) AS quote
       FROM conversations WHERE conv_id % 6 <> 0),
f AS (SELECT DISTINCT observation, o.id, quote, captured_ts, status = 'new' AS core FROM o JOIN message m ON m.id = o.id WHERE speaker_role = 'self' AND length(quote) >= 2 AND contains(content, quote)),
seen AS (SELECT observation, count(*) AS evidence, string_agg(DISTINCT id, ',' ORDER BY id) AS source_ids, min(captured_ts) AS from_ts, max(captured_ts) AS to_ts FROM f GROUP BY observation HAVING bool_or(core) AND min(captured_ts) IS NOT NULL)"""

CUT = f"""WITH RECURSIVE {MESSAGE}, sized AS (SELECT id, captured_ts, CAST(length(content) + length(id) AS BIGINT) AS size, row_number() OVER (ORDER BY captured_ts NULLS LAST, id) - 1 AS place FROM message WHERE speaker_role = 'self'),
fold AS (SELECT place, size, CAST(1 AS BIGINT) AS segment, CAST(1 AS BIGINT) AS n, size AS used FROM sized WHERE place = 0
  UNION ALL SELECT s.place, s.size, CASE WHEN n >= 40 OR used + s.size > 6000 THEN segment + 1 ELSE segment END, CASE WHEN n >= 40 OR used + s.size > 6000 THEN 1 ELSE n + 1 END, CASE WHEN n >= 40 OR used + s.size > 6000 THEN s.size ELSE used + s.size END
  FROM fold f JOIN sized s ON s.place = f.place + 1)"""

RAW = f"""WITH {MESSAGE}, raw AS (SELECT concat('r-', conv_id, '-', turn) AS id, conv_id, turn, CASE turn % 4 WHEN 0 THEN 'self' WHEN 1 THEN 'other' END AS action_owner, substring(trim(CASE WHEN conv_id % 9 = 0 THEN ' ' ELSE concat(' ', text) END), 1, 120) AS title,
       substring(trim(concat(text, text)), 1, 1000) AS description, concat('m-', conv_id, '-', turn) AS s1, concat('m-', conv_id, '-', turn + 1) AS s2 FROM conversations),
own AS (SELECT raw.* FROM raw WHERE action_owner = 'self' OR (action_owner IS NULL AND EXISTS (SELECT 1 FROM message m WHERE m.speaker_role = 'self' AND m.id IN (raw.s1, raw.s2)))),
cand AS (SELECT concat('ai-', {fnv("concat(title, '|', description, '|', s1, ',', s2)")}, '-', turn) AS id, title, description, s1, s2, ['Peer-1', concat('peer-', conv_id % 7)] AS people, CASE WHEN turn % 2 = 0 THEN 'a,b' ELSE '' END AS tags,
       CASE WHEN conv_id % 3 = 0 THEN concat('Hall of NATION_', conv_id % 40) END AS place, CASE WHEN turn % 3 = 0 THEN 'exact' END AS location_precision,
       CASE WHEN conv_id > 5 THEN CAST(greatest(50, least(100000, floor((conv_id - 5) * 1000.5 + 0.5))) AS BIGINT) END AS radius FROM own WHERE title <> '' AND description <> '')"""

CREATED = RAW + """, people AS (SELECT concat('person-', id) AS person, concat('peer-', id, CASE WHEN id = 3 THEN 'x' ELSE '' END) AS name FROM range(7) t(id)),
fresh AS (SELECT *, concat('q-ai-', id) AS task FROM cand WHERE length(title) % 5 <> 0 AND concat('q-ai-', id) NOT IN (SELECT concat('q-ai-', id) FROM cand WHERE length(description) % 3 = 0)),
located AS (SELECT task, min(n_nationkey) AS location_id FROM fresh JOIN nation ON contains(replace(lower(place), ' ', ''), lower(n_name)) OR contains(lower(n_name), replace(lower(place), ' ', '')) GROUP BY task),
met AS (SELECT task, string_agg(DISTINCT person, ',' ORDER BY person) AS characters FROM (SELECT task, lower(unnest(people)) AS asked FROM fresh) a JOIN people ON contains(asked, name) OR contains(name, asked) GROUP BY task)"""

QUEST = """quest AS (SELECT concat(CASE WHEN turn % 5 = 0 THEN 'q-' ELSE 'q-ai-' END, 'c-', conv_id, '-', turn) AS id, conv_id, turn, CASE WHEN turn % 2 = 0 THEN concat('m-', conv_id, '-', turn) END AS source,
       CASE WHEN turn % 3 = 0 THEN TIMESTAMP '2023-01-01 00:00:00' END AS source_at FROM conversations)"""

CARD = """card AS (SELECT concat('card-', conv_id, '-', turn) AS id, CAST(conv_id * 100 + turn AS BIGINT) AS ord, CASE WHEN turn % 4 = 1 THEN concat('PEER ', conv_id % 7) ELSE concat('peer-', conv_id % 7) END AS name,
       [concat('m-', conv_id, '-', turn), concat('m-', conv_id, '-', turn - turn % 4)] AS source_ids, CASE WHEN turn > 3 THEN [concat('conv-', conv_id % 20)] ELSE [] END AS keys, conv_id, turn,
       TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id * 6 AS INT)) + to_minutes(CAST(turn * 7 AS INT)) AS first_ts, TIMESTAMP '2024-02-01 00:00:00' + to_hours(CAST(conv_id * 6 AS INT)) + to_minutes(CAST(turn * 7 AS INT)) AS last_ts,
       CASE WHEN turn % 3 = 0 THEN concat('http://a/', conv_id) END AS avatar FROM conversations WHERE role = 'assistant')"""

_NUMBER = "CAST(regexp_replace(id, '[^0-9]', '', 'g') AS BIGINT)"
DATED = f"""WITH {TASK}, dated AS (SELECT id, status, title, CASE WHEN {_NUMBER} % 6 > 0 THEN start_ts END AS start_ts, {_NUMBER} % 7 = 0 AS long FROM task)"""
ATLAS = f"""WITH {TASK}, atlas AS (SELECT id, status, title, ['life', 'study', 'social'][{_NUMBER} % 3 + 1] AS category, CASE WHEN {_NUMBER} % 5 = 0 THEN {_NUMBER} % 11 END AS atlas_order FROM task)"""

ORACLE_SQL = {
    "model_records": f"{MODEL} SELECT key, ref, id, sha256(content) AS content, role FROM model",
    "restored_references": f"""{MODEL}, e AS (SELECT DISTINCT key, unnest(['2', '99', '1', '5']) AS ref, unnest([1, 2, 3, 4]) AS pos FROM model)
        SELECT concat('entry ', e.key) AS entry, string_agg(coalesce(m.id, e.ref), ',' ORDER BY pos) AS source_ids FROM e LEFT JOIN model m ON m.key = e.key AND m.ref = e.ref GROUP BY e.key""",
    "self_plan": f"""{CUT}, heads AS (SELECT segment, min(place) AS first_place, count(*) AS rows FROM fold GROUP BY segment),
        back AS (SELECT h.segment, h.first_place - f.place AS dist, sum(f.size) OVER (PARTITION BY h.segment ORDER BY f.place DESC) AS used FROM heads h JOIN fold f ON f.place < h.first_place AND f.place >= h.first_place - 4),
        cut AS (SELECT segment, count(*) FILTER (dist = 1 OR used <= 800) AS n FROM back GROUP BY segment) SELECT segment, first_place, coalesce(n, 0) AS overlap, rows FROM heads LEFT JOIN cut USING (segment)""",
    "self_observations": f"{OBSERVED} SELECT * FROM seen",
    "self_periods": f"""{OBSERVED}, p AS (SELECT concat('p-', conv_id) AS period, turn AS paragraph, unnest([concat('o-', conv_id, '-', turn), concat('o-', conv_id, '-', turn + 1)]) AS observation FROM conversations WHERE turn <> 2)
        SELECT period, count(DISTINCT paragraph) AS paragraphs, count(DISTINCT observation) AS observations, min(from_ts) AS from_ts, arg_max(to_ts, (from_ts, to_ts)) AS to_ts FROM p JOIN seen USING (observation) GROUP BY period""",
    "journal_rows": """WITH e AS (SELECT concat('self-journal-', conv_id, '-', turn) AS id, substring(trim(text), 1, 8000) AS content FROM conversations WHERE turn % 4 <> 1)
        SELECT id, CASE WHEN length(content) > 40 THEN concat(substring(content, 1, 40), '...') ELSE content END AS title, sha256(substring(content, 1, 1200)) AS summary, length(content) AS characters, 'journal' AS message_type FROM e WHERE content <> ''""",
    "checkin_rows": """WITH c AS (SELECT *, strftime(DATE '2020-01-01' + CAST(event_id % 20000 AS INT), '%Y-%m-%d') AS date FROM events)
        SELECT concat('checkin-', date) AS id, concat(date, ' 状态快照') AS title, sha256(concat_ws(chr(10), '[每日状态快照]', CASE WHEN event_id % 7 BETWEEN 1 AND 5 THEN concat('状态：', event_id % 7, '/5') END, CASE WHEN event_id % 3 > 0 THEN concat('睡眠：', event_id % 12, ' 小时') END,
          concat('药物：', CASE event_id % 4 WHEN 0 THEN '是' WHEN 1 THEN '否' WHEN 2 THEN '减量' ELSE '未记录' END), concat('酒精：', CASE event_id % 3 WHEN 0 THEN '无' WHEN 1 THEN '多' ELSE '未记录' END),
          CASE WHEN event_id % 2 = 0 THEN concat('主要在做：', event_type) END, CASE WHEN event_id % 5 = 0 THEN '一句话：note' END)) AS content, concat(date, 'T12:00:00') AS captured_at FROM c""",
    "candidates_normalized": f"{RAW} SELECT id, length(title) AS title, length(description) AS description, concat(s1, ',', s2) AS source_ids, array_to_string(people, ',') AS people, tags, place, location_precision, radius FROM cand",
    "new_candidates": f"""WITH {KEYED_CANDIDATE}
        SELECT id, title FROM k a WHERE status = 'pending' AND NOT EXISTS (SELECT 1 FROM k b WHERE b.status <> 'pending' AND ((a.t = b.t AND a.d = b.d) OR (a.source_id = b.source_id AND (a.t = b.t OR a.d = b.d)))
          AND NOT coalesce(a.start_at <> b.start_at, false) AND NOT (a.p <> '' AND b.p <> '' AND NOT contains(a.p, b.p) AND NOT contains(b.p, a.p) AND a.location_precision = 'exact' AND b.location_precision = 'exact'))""",
    "candidate_tasks": f"""{CREATED} SELECT f.task AS id, CAST(location_id AS BIGINT) AS location_id, coalesce(characters, '') AS characters, rtrim(concat('模型候选,', tags), ',') AS tags FROM fresh f LEFT JOIN located USING (task) LEFT JOIN met USING (task)""",
    "sources_reviewed": f"""{CREATED}, cited AS (SELECT s1 AS id FROM fresh UNION SELECT s2 FROM fresh) SELECT source, CASE WHEN id IN (SELECT id FROM cited) THEN 'reviewed' ELSE status END AS status, count(*) AS messages FROM message GROUP BY 1, 2""",
    "candidates_dismissed": f"""WITH {CANDIDATE} SELECT 'candidates' AS of, CASE WHEN status = 'pending' AND place = 'Library' THEN 'dismissed' ELSE status END AS status, count(*) AS rows FROM candidate GROUP BY 1, 2
        UNION ALL SELECT 'feedback', 'other', count(*) FROM candidate WHERE status = 'pending' AND place = 'Library' HAVING count(*) > 0""",
    "task_evidence": f"""WITH {QUEST}, made AS (SELECT concat('q-ai-c-', conv_id, '-', turn) AS id, concat('m-', conv_id, '-', turn, ',m-0-0') AS were, CASE WHEN conv_id % 2 = 0 THEN TIMESTAMP '2023-02-02 00:00:00' ELSE TIMESTAMP '2023-03-03 00:00:00' END AS was_at FROM conversations WHERE conv_id % 4 > 0)
        SELECT id, coalesce(source, were, '') AS source_ids, CASE WHEN source IS NOT NULL OR were IS NOT NULL THEN coalesce(source_at, was_at) ELSE source_at END AS source_at FROM quest LEFT JOIN made USING (id)""",
    "task_source_time": f"WITH {MESSAGE}, {QUEST} SELECT q.id, coalesce(m.captured_ts, source_at) AS source_at FROM quest q LEFT JOIN message m ON m.id = q.source",
    "place_removed": f"WITH {TASK} SELECT CASE WHEN location_id = 0 THEN 1 ELSE location_id END AS location_id, count(*) AS tasks FROM task GROUP BY 1",
    "generated_places": """WITH c AS (SELECT concat('c-', conv_id, '-', turn) AS id, CASE turn % 4 WHEN 0 THEN concat('near nation_', conv_id % 30) WHEN 1 THEN concat('spot ', conv_id % 5) END AS q FROM conversations),
        n AS (SELECT q, min(n_nationkey) AS place_id FROM (SELECT DISTINCT q FROM c) JOIN nation ON contains(replace(q, ' ', ''), lower(n_name)) OR contains(lower(n_name), replace(q, ' ', '')) GROUP BY q)
        SELECT id, CAST(place_id AS BIGINT) AS place_id, CASE WHEN place_id IS NULL AND q IN ('spot 0', 'spot 1', 'spot 2', 'spot 3') THEN replace(q, 'spot', 'found') END AS found FROM c LEFT JOIN n USING (q)""",
    "task_list": f"{DATED} SELECT id, title, start_ts FROM dated WHERE status = 'active' AND contains(lower(title), 'urgent')",
    "task_timeline": f"""{DATED}, d AS (SELECT *, CASE WHEN long THEN 'long' ELSE coalesce(strftime(start_ts, '%Y-%m-%d'), 'undated') END AS day FROM dated),
        r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY start_ts NULLS LAST, title, id) AS nth FROM d) SELECT day, count(*) AS tasks, min(id) FILTER (nth = 1) AS first_id FROM r GROUP BY day""",
    "task_atlas_order": f"{ATLAS} SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY atlas_order NULLS LAST, status = 'done', title, id) - 1 AS place FROM atlas",
    "atlas_rearranged": f"""{ATLAS} SELECT id, CASE id WHEN 't-1' THEN 'study' WHEN 't-2' THEN 'study' WHEN 't-3' THEN 'study' WHEN 't-4' THEN 'life' WHEN 't-5' THEN 'life' ELSE category END AS category,
        CASE id WHEN 't-3' THEN 0 WHEN 't-1' THEN 1 WHEN 't-2' THEN 2 WHEN 't-4' THEN 1 WHEN 't-5' THEN 2 ELSE atlas_order END AS atlas_order FROM atlas""",
    "people_evidence": f"""WITH {MESSAGE}, {CARD}, pic AS (SELECT *, concat('http://p/', id) AS pic FROM keyed WHERE {_NUMBER} % 4 = 0),
        p AS (SELECT id AS person, CASE WHEN ord % 2 = 0 THEN 'nobody' ELSE replace(replace(lower(name), '-', ''), ' ', '') END AS who, source_ids, concat('conv-', conv_id) AS key, CASE WHEN ord % 3 = 0 THEN first_ts END AS first_ts, avatar FROM card),
        bn AS (SELECT replace(lower(speaker), '-', '') AS who, arg_max(pic, id) AS a FROM pic WHERE speaker IS NOT NULL GROUP BY 1), bk AS (SELECT key, arg_min(pic, id) AS b FROM pic WHERE conversation_kind = 'direct' GROUP BY key),
        t AS (SELECT person, min(captured_ts) AS lo, max(captured_ts) AS hi, count(*) AS n FROM (SELECT person, unnest(source_ids) AS id FROM p) x JOIN keyed USING (id) GROUP BY person)
        SELECT person, CASE WHEN n IS NULL THEN avatar ELSE coalesce(a, b, avatar) END AS avatar, coalesce(first_ts, lo) AS first_ts, hi AS last_ts FROM p LEFT JOIN bn USING (who) LEFT JOIN bk USING (key) LEFT JOIN t USING (person)""",
    "open_tasks": f"WITH {TASK} SELECT id, status FROM task WHERE status IN ('active', 'available') ORDER BY start_ts, id LIMIT 30",
    "overview_counts": f"""WITH {MESSAGE}, {TASK} SELECT (SELECT count(*) FROM task WHERE status IN ('active', 'available')) AS active, (SELECT count(*) FROM task WHERE status = 'done') AS done, CAST(7 AS BIGINT) AS people,
        (SELECT count(*) FROM events WHERE event_type = 'view') AS checkins, (SELECT count(*) FROM keyed) AS messages, (SELECT count(DISTINCT key) FROM keyed) AS conversations""",
    "people_merge": f"""WITH RECURSIVE {CARD}, live AS (SELECT *, replace(replace(lower(name), '-', ''), ' ', '') AS who FROM card WHERE NOT list_contains(keys, 'conv-2')),
        mark AS (SELECT id, ord, concat(who, ' ', unnest(list_concat(source_ids, keys))) AS m FROM live), near AS (SELECT DISTINCT a.id, b.ord AS other FROM mark a JOIN mark b USING (m)), step AS (SELECT DISTINCT a.ord, n.other FROM near n JOIN live a USING (id)),
        reach AS (SELECT ord, ord AS other FROM live UNION SELECT r.ord, s.other FROM reach r JOIN step s ON s.ord = r.other),
        block AS (SELECT ord, min(other) AS b FROM reach GROUP BY ord), j AS (SELECT live.*, b FROM live JOIN block USING (ord)),
        k AS (SELECT b, string_agg(key, ',' ORDER BY o, key) AS keys FROM (SELECT b, key, min(ord) AS o, row_number() OVER (PARTITION BY b ORDER BY min(ord), key) AS nth FROM (SELECT b, ord, unnest(keys) AS key FROM j) GROUP BY b, key) WHERE nth <= 30 GROUP BY b),
        s AS (SELECT b, count(DISTINCT x) AS sources FROM (SELECT b, unnest(source_ids) AS x FROM j) GROUP BY b)
        SELECT arg_min(id, ord) AS person, arg_min(name, ord) AS name, count(*) AS cards, any_value(sources) AS sources, coalesce(any_value(k.keys), '') AS keys, min(first_ts) AS first_ts, max(last_ts) AS last_ts, arg_max(avatar, ord) FILTER (avatar IS NOT NULL) AS avatar
        FROM j LEFT JOIN s USING (b) LEFT JOIN k USING (b) GROUP BY b""",
    "people_list": f"WITH {CARD} SELECT name, max(last_ts) AS last_ts, count(*) AS sources, count(DISTINCT keys) AS conversations FROM card GROUP BY name",
    "people_recent": f"WITH {CARD} SELECT concat(name, ' ', id) AS name, last_ts FROM card ORDER BY last_ts DESC NULLS LAST, concat(name, ' ', id) LIMIT 20",
    "newest_evidence": f"""WITH {CLAIM} SELECT person_id, claim_id, nth FROM (SELECT person_id, source_id AS claim_id, row_number() OVER (PARTITION BY person_id ORDER BY observed_ts DESC, claim_key, source_id) AS nth FROM claim) WHERE nth <= 12""",
    "linked_records": f"""WITH {MESSAGE}, {CARD}, l AS (SELECT name, m.id FROM (SELECT name, unnest(keys) AS key FROM card) c JOIN keyed m USING (key) UNION SELECT name, m.id FROM (SELECT name, unnest(source_ids) AS id FROM card) c JOIN keyed m USING (id))
        SELECT name AS person, count(*) AS messages, min(id) AS first_id FROM l GROUP BY name""",
    "device_summary": f"""WITH {EVENT} SELECT CASE kind WHEN 'activity' THEN 'android' WHEN 'payment' THEN 'windows' ELSE 'unknown' END AS platform, count(*) AS events, max(start_ts) AS latest FROM context_event GROUP BY 1""",
    "reconciled_counts": f"""WITH {MESSAGE} SELECT source, count(*) + CASE source WHEN 'journal' THEN -1 WHEN 'export-a' THEN 2 ELSE 0 END AS expected, count(*) AS archived, CASE source WHEN 'journal' THEN 'ahead' WHEN 'export-a' THEN 'behind' ELSE 'complete' END AS state FROM message GROUP BY source""",
    "distinct_places": """WITH f AS (SELECT s_nationkey AS query, s_suppkey AS rank, format('{:.5f}', (s_suppkey % 3) + 0.0000001 * s_suppkey) AS lat, s_suppkey % 2 AS lon FROM supplier) SELECT query, min(rank) AS rank FROM f GROUP BY query, lat, lon""",
    "card_ids": f"WITH {CARD} SELECT id, {fnv("concat(name, '|', id)")} AS hash FROM card",
}
