"""DuckDB SQL for the queries over shared states, portraits, payloads and advice."""

from chatloom.plans.oracles import CLAIM, EVENT, MESSAGE, TASK
from chatloom.plans.workflow_oracles import fnv


def _state(name: str, absent: int, value: str, model: str, dismissal: str) -> str:
    return f"""{name} AS (SELECT part, id, CASE WHEN part <> 'dismissed' THEN CAST({value} AS VARCHAR) END AS value FROM state WHERE h % {absent} <> 0
       UNION ALL SELECT * FROM (VALUES ('setting', 'people_model_version', '{model}'), ('setting', 'people_dismissal_version', '{dismissal}')) v(part, id, value))"""


STATES = f"""WITH state AS (SELECT ['tasks', 'places', 'people', 'checkins', 'events', 'candidates', 'dismissed', 'positions', 'setting', 'messages'][event_id % 10 + 1] AS part, concat('k-', event_id) AS id, event_id // 10 AS h FROM events),
{_state("base", 11, "h % 50", "4", "2")},
{_state("mine", 13, "h % 50 + CASE WHEN h % 5 = 0 THEN 100 ELSE 0 END", "5", "2")},
{_state("theirs", 17, "h % 50 + CASE WHEN h % 7 = 0 THEN 100 ELSE 0 END", "4", "3")},
ids AS (SELECT part, id FROM base UNION SELECT part, id FROM mine UNION SELECT part, id FROM theirs),
every AS (SELECT ids.part, ids.id, b.id IS NOT NULL AS b, m.id IS NOT NULL AS m, t.id IS NOT NULL AS t, b.value AS bv, m.value AS mv, t.value AS tv
       FROM ids LEFT JOIN base b USING (part, id) LEFT JOIN mine m USING (part, id) LEFT JOIN theirs t USING (part, id) WHERE ids.part <> 'messages'),
whole AS (SELECT part, id, mv AS value FROM every WHERE part = 'setting' AND (b <> m OR bv IS DISTINCT FROM mv) AND m
       UNION ALL SELECT part, id, tv FROM every WHERE part = 'setting' AND NOT (b <> m OR bv IS DISTINCT FROM mv) AND t
       UNION ALL SELECT part, id, NULL FROM every WHERE part = 'dismissed' AND ((t AND NOT (b AND NOT m)) OR (m AND NOT b))
       UNION ALL SELECT part, id, CASE WHEN m AND (NOT b OR bv IS DISTINCT FROM mv) THEN mv ELSE tv END FROM every WHERE part NOT IN ('setting', 'dismissed') AND NOT (b AND NOT m)
         AND (t OR (m AND (NOT b OR (part = 'positions' AND bv IS DISTINCT FROM mv)))))"""

BORNE = f"""WITH {MESSAGE}, msg AS (SELECT * REPLACE (CASE WHEN NOT regexp_matches(key, '[05]$') THEN speaker END AS speaker) FROM keyed),
named AS (SELECT key, count(*) FILTER (coalesce(trim(speaker), '') <> '') AS named FROM msg WHERE speaker_role = 'other' GROUP BY key),
c AS (SELECT concat('v-', conv_id, '-', turn) AS claim_id, concat('a-', conv_id) AS card, conv_id % 3 AS nth, CASE conv_id % 3 WHEN 1 THEN 'me' ELSE concat('Peer-', conv_id % 7) END AS name, concat('conv-', conv_id) AS key,
       CASE WHEN conv_id % 2 = 0 THEN concat('peer-', conv_id % 7) ELSE '' END AS due, CASE turn % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'preference' ELSE 'event' END AS kind, turn,
       trim(CASE WHEN turn % 2 = 0 OR conv_id % 4 = 0 THEN substring(text, 2, 3) ELSE substring(text, 3, 9) END) AS quote, concat('m-', conv_id, '-', turn) AS s1, concat('m-', conv_id, '-', turn + 2) AS s2
       FROM conversations WHERE role = 'assistant'),
f AS (SELECT c.*, m.id, m.captured_ts, m.source, m.status FROM c JOIN msg m ON m.key = c.key AND m.id IN (s1, s2) JOIN named n ON n.key = c.key
       WHERE length(regexp_replace(quote, '\\s+', '', 'g')) >= 2 AND speaker_role = 'other' AND (lower(coalesce(speaker, '')) = lower(name) OR (lower(name) = due AND named = 0))
         AND contains(lower(regexp_replace(content, '\\s+', '', 'g')), lower(regexp_replace(quote, '\\s+', '', 'g')))),
g AS (SELECT claim_id, kind, quote, turn, string_agg(id, ',' ORDER BY id <> s1) AS source_ids, count(*) AS n, min(captured_ts) AS first_ts, max(captured_ts) AS last_ts FROM f GROUP BY claim_id, kind, quote, turn
       HAVING count(*) > 1 OR turn % 5 <> 0),
borne AS (SELECT *, CASE turn % 5 WHEN 0 THEN 'preference' WHEN 1 THEN 'temporary' ELSE CASE WHEN kind = 'preference' THEN 'preference' ELSE 'background' END END AS category, CASE WHEN n > 1 THEN 'repeated' ELSE 'single' END AS stability FROM g)"""

REGISTRY = """registry AS (SELECT concat('p-', conv_id) AS person, concat('c-', turn) AS claim_id, CAST(turn AS BIGINT) AS ord, CASE turn % 3 WHEN 0 THEN 'fact' WHEN 1 THEN 'preference' ELSE 'event' END AS kind, text, split_part(text, '.', 1) AS quote,
       concat('m-', conv_id, '-', turn) AS source_id, turn % 7 <> 5 AS eligible, turn % 3 = 1 AS old, conv_id, turn, TIMESTAMP '2024-01-01 00:00:00' - to_days(CASE WHEN turn % 3 = 1 THEN 200 ELSE 0 END) + to_hours(CAST(conv_id * 6 AS INT)) + to_minutes(CAST(turn * 7 AS INT)) AS ts FROM conversations)"""

# what each block is, by its number: see _blocks in review_queries
BLOCKS = f"""WITH {REGISTRY}, b AS (SELECT concat('p-', conv_id) AS person, turn + 1 AS pos, (conv_id + turn) % 10 AS v, conv_id, turn, length(regexp_replace(split_part(text, '.', 1), '\\s+', '', 'g')) < 3 AS short, conv_id % 2 = 0 AS says_change, conv_id % 3 = 0 AND EXISTS (SELECT 1 FROM conversations z WHERE z.conv_id = c.conv_id AND z.turn = 0) AS noted FROM conversations c),
cites AS (SELECT person, pos, v, CASE WHEN v IN (5, 6) THEN [] WHEN v = 9 THEN [concat('c-', turn), concat('c-', turn - 1)] ELSE [concat('c-', turn)] END AS ids FROM b),
held AS (SELECT x.person, pos, string_agg(r.claim_id, ',' ORDER BY x.at) AS claim_ids, string_agg(r.source_id, ',' ORDER BY x.at) AS source_ids, bool_and(eligible) AS eligible, bool_or(old) AS old, bool_or(NOT old) AS fresh, min(ts) AS from_ts, max(ts) AS to_ts
       FROM (SELECT person, pos, unnest(ids) AS claim_id, unnest(range(len(ids))) AS at FROM cites) x JOIN (SELECT *, ts < TIMESTAMP '2023-12-21 00:00:00' AS past FROM registry) r ON r.person = x.person AND r.claim_id = x.claim_id GROUP BY x.person, pos),
timed AS (SELECT b.*, coalesce(claim_ids, '') AS claim_ids, coalesce(source_ids, '') AS source_ids, eligible, from_ts, to_ts, claim_ids IS NOT NULL AS has, noted AND v IN (5, 6) AS manual, CASE WHEN old AND fresh THEN 'change' WHEN fresh THEN 'recent' WHEN old THEN 'historical' ELSE 'undated' END AS scope
       FROM b LEFT JOIN held USING (person, pos)),
checked AS (SELECT *, CASE WHEN says_change THEN 'change' ELSE 'other' END AS reason, CASE
       WHEN v = 0 OR (NOT has AND NOT manual) THEN 'missing-text-or-claims' WHEN v = 1 THEN 'disclaimer' WHEN has AND NOT eligible THEN 'claim-not-for-portraits' WHEN v = 5 THEN 'no-anchor-in-notes'
       WHEN v = 7 THEN 'disclaimer' WHEN v = 3 OR (v NOT IN (5, 6) AND short) THEN 'no-anchor-in-claims' WHEN v = 4 THEN 'unsupported-number' WHEN scope = 'historical' AND v <> 8 THEN 'past-needs-past-tense' WHEN scope = 'change' AND NOT says_change THEN 'change-needs-its-reason' END AS issue FROM timed WHERE pos <= 8)"""

SENT = """WITH raw AS (SELECT *, concat('y-', conv_id % 25) AS payload, conv_id * 100 + turn AS ord, CASE turn % 4 WHEN 0 THEN 'event' WHEN 1 THEN 'preference' ELSE 'fact' END AS kind, trim(substring(trim(text), 1, 360)) AS t, substring(trim(CASE WHEN turn = 3 THEN ' ' ELSE split_part(text, '.', 1) END), 1, 120) AS q,
       substring(trim(text), 1, 360) AS cut, concat('m-', conv_id, '-', turn) AS source FROM conversations),
sent AS (SELECT payload, ord, {id} AS id, kind, source AS source_ids, CASE WHEN conv_id % 2 = 0 THEN 'repeated' ELSE 'single' END AS strength, CASE turn % 5 WHEN 0 THEN 'temporary' WHEN 1 THEN 'skill' ELSE 'background' END AS category,
       CASE WHEN turn = 4 THEN 'persistent' WHEN conv_id % 2 = 0 THEN 'repeated' ELSE 'single' END AS stability, CAST(greatest(0, least(10, turn * 3 - 4)) AS BIGINT) AS score, turn <> 6 AND turn % 5 <> 0 AS eligible, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(conv_id * 6 AS INT)) AS first_ts
       FROM raw WHERE t <> '' AND q <> '' QUALIFY row_number() OVER (PARTITION BY payload ORDER BY ord) <= 96)""".replace("{id}", f"CASE WHEN turn % 2 = 0 THEN concat('c-', conv_id, '-', turn) ELSE concat('claim-', {fnv("concat_ws('|', kind, cut, q, source)")}) END")

ORACLE_SQL = {
    "shared_merge": f"{STATES} SELECT * FROM whole",
    "shared_differences": f"""{STATES}, o AS (SELECT part, id, w.id IS NOT NULL AS l, t.id IS NOT NULL AS r, w.value AS wv, t.value AS tv FROM whole w FULL JOIN (SELECT * FROM theirs WHERE part <> 'messages') t USING (part, id))
        SELECT part, count(*) FILTER (l AND NOT r) AS added, count(*) FILTER (r AND NOT l) AS removed, count(*) FILTER (l AND r AND wv IS DISTINCT FROM tv) AS changed FROM o
        GROUP BY part HAVING count(*) FILTER (l <> r OR wv IS DISTINCT FROM tv) > 0""",
    "shared_hydrated": f"""{STATES} SELECT * FROM whole WHERE part <> 'dismissed' AND id NOT IN ('people_dismissal_version', 'people_model_version') UNION ALL SELECT * FROM mine WHERE part IN ('dismissed', 'messages') OR id = 'people_dismissal_version'
        UNION ALL SELECT 'setting', 'people_model_version', '5'""",
    "claims_borne_out": f"""{BORNE} SELECT claim_id, source_ids, first_ts, last_ts, category, stability, CAST(CASE kind WHEN 'preference' THEN 5 WHEN 'event' THEN 8 ELSE 2 END + CASE WHEN n > 1 THEN 4 ELSE 0 END + CASE WHEN turn % 5 = 0 THEN 3 ELSE 0 END
        + CASE WHEN length(quote) >= 8 THEN 1 ELSE 0 END - CASE WHEN category = 'temporary' THEN 6 ELSE 0 END AS BIGINT) AS score, category <> 'temporary' AS eligible FROM borne""",
    "person_cards": f"""{BORNE}, kept AS (SELECT f.* FROM f JOIN borne USING (claim_id) WHERE claim_id IN (SELECT claim_id FROM f WHERE status = 'new')),
        k AS (SELECT card, nth, name, count(DISTINCT claim_id) FILTER (kind = 'fact') AS facts, count(DISTINCT claim_id) FILTER (kind = 'preference') AS preferences, count(DISTINCT claim_id) FILTER (kind = 'event') AS events, string_agg(DISTINCT id, ',' ORDER BY id) AS ids, count(DISTINCT id) AS sources,
          min(captured_ts) AS first_ts, max(captured_ts) AS last_ts, any_value(key) AS keys, any_value(source) AS platforms FROM kept GROUP BY card, nth, name)
        SELECT concat('person-', {fnv("concat(name, '|', ids)")}, '-', nth) AS person, name, facts, preferences, events, sources, first_ts, last_ts, keys, platforms FROM k""",
    "resolved_claim_ids": f"""WITH {REGISTRY}, norm AS (SELECT *, lower(regexp_replace(text, '\\s+', '', 'g')) AS tk, lower(regexp_replace(quote, '\\s+', '', 'g')) AS qk FROM registry),
        r AS (SELECT a.person, a.kind, a.ord AS pos, CASE a.ord % 4 WHEN 0 THEN a.claim_id WHEN 1 THEN (SELECT arg_min(claim_id, n.ord) FROM norm n WHERE n.person = a.person AND n.kind = a.kind AND n.tk = a.tk AND a.tk <> '')
          WHEN 2 THEN (SELECT arg_min(claim_id, n.ord) FROM norm n WHERE n.person = a.person AND n.kind = a.kind AND n.qk = a.qk AND a.qk <> '') END AS claim_id FROM norm a)
        SELECT person, kind, claim_id, nth FROM (SELECT person, kind, claim_id, row_number() OVER (PARTITION BY person, kind ORDER BY min(pos), claim_id) AS nth FROM r WHERE claim_id IS NOT NULL GROUP BY person, kind, claim_id) WHERE nth <= 12""",
    "portrait_blocks": f"{BLOCKS} SELECT person, pos, claim_ids, source_ids, reason, scope, from_ts, to_ts, manual, issue FROM checked",
    "portraits_checked": f"""{BLOCKS}, g AS (SELECT person, count(*) FILTER (issue IS NULL) AS good, coalesce(bool_or(issue IS NULL AND manual), FALSE) AS manual, coalesce(bool_or(issue IS NULL AND scope IN ('recent', 'change')), FALSE) AS now, list(DISTINCT issue) FILTER (issue IS NOT NULL) AS issues FROM checked GROUP BY person),
        cited AS (SELECT person, count(DISTINCT x) AS cited FROM (SELECT person, unnest(string_split(source_ids, ',')) AS x FROM checked WHERE issue IS NULL AND source_ids <> '') GROUP BY person),
        l AS (SELECT person, count(*) FILTER (eligible) AS lasting, count(*) FILTER (eligible AND NOT old) AS recent FROM registry GROUP BY person),
        a AS (SELECT person, good, manual, now, coalesce(issues, []) AS issues, coalesce(cited, 0) AS cited, lasting, recent FROM g LEFT JOIN cited USING (person) JOIN l USING (person))
        SELECT person, CASE WHEN cited >= 2 OR manual THEN good ELSE 0 END AS blocks, array_to_string(list_sort(list_filter(list_concat(issues, [CASE WHEN good > 0 AND NOT manual AND cited < 2 THEN 'needs-two-sources' END, CASE WHEN recent >= 2 AND NOT now THEN 'needs-a-recent-block' END, CASE WHEN good = 0 AND lasting >= 3 THEN 'portrait-expected' END]), lambda x: x IS NOT NULL)), ',') AS issues FROM a""",
    "portraits_consolidated": f"""WITH {REGISTRY}, one AS (SELECT conv_id, min(turn) AS turn FROM conversations WHERE turn < 2 AND (conv_id + turn) % 3 <> 0 GROUP BY conv_id)
        SELECT concat('p-', conv_id) AS person, CAST(o.turn + 1 AS BIGINT) AS attempt, CASE WHEN conv_id % 5 > 0 THEN concat('portrait ', o.turn) END AS portrait, count(*) FILTER (kind = 'fact') AS facts, count(*) FILTER (kind = 'preference') AS preferences
        FROM one o JOIN registry USING (conv_id) WHERE conv_id % 5 > 0 OR conv_id % 2 > 0 GROUP BY conv_id, o.turn""",
    "portrait_signatures": """SELECT concat('p-', conv_id) AS person, bool_or(turn = 1) AND conv_id % 10 = 7 AS changed FROM conversations GROUP BY conv_id""",
    "consolidation_queue": """SELECT concat('p-', conv_id) AS person, CAST(conv_id % 5 + 1 AS BIGINT) AS attempt FROM conversations WHERE conv_id % 9 <> 0 AND conv_id % 5 < 3 GROUP BY conv_id HAVING conv_id % 4 = 0 OR (bool_or(turn = 1) AND conv_id % 10 = 7) ORDER BY conv_id LIMIT 12""",
    "payload_checks": """WITH p AS (SELECT conv_id, count(*) AS n, count(*) FILTER (turn = 1) AS second FROM conversations GROUP BY conv_id)
        SELECT concat('y-', conv_id) AS payload, n AS records, CASE WHEN conv_id % 11 = 1 THEN 'total-too-small' WHEN conv_id % 11 = 2 THEN 'not-all-records' WHEN conv_id % 11 IN (3, 4) THEN 'segment-number'
          WHEN conv_id % 11 IN (5, 6) THEN 'core-places' WHEN conv_id % 11 = 8 THEN 'too-many-attachments' WHEN conv_id % 11 = 7 AND second > 0 THEN 'record-without-id-or-text' WHEN conv_id % 11 = 9 THEN 'attachment' END AS issue FROM p
        UNION ALL SELECT 'y-none', 0, 'no-records'""",
    "merge_payload_claims": f"{SENT} SELECT payload, id, kind, source_ids, strength, category, stability, score, eligible FROM sent",
    "merge_payloads": f"""{SENT}, n AS (SELECT payload, count(*) AS n FROM sent GROUP BY payload) SELECT concat('y-', i) AS payload, coalesce(n, 0) AS claims, i % 8 <> 1 AND (n > 0 OR i % 3 = 0 OR i % 5 = 0) IS TRUE AS ok
        FROM range(40) r(i) LEFT JOIN n ON payload = concat('y-', i)""",
    "payload_times": f"""{SENT}, s AS (SELECT *, first_ts >= TIMESTAMP '2023-12-21 00:00:00' AS fresh FROM sent)
        SELECT payload, count(*) FILTER (fresh) AS n_recent, count(*) FILTER (NOT fresh) AS n_historical, CAST(0 AS BIGINT) AS n_undated, count(DISTINCT source_ids) FILTER (fresh) AS sources_recent, count(DISTINCT source_ids) FILTER (NOT fresh) AS sources_historical,
          date_diff('day', CAST(max(first_ts) AS DATE), DATE '2024-01-20') AS latest_days, CASE WHEN count(*) FILTER (fresh) = 0 THEN 'none' WHEN count(*) FILTER (fresh) < 6 OR count(DISTINCT source_ids) FILTER (fresh) < 4 THEN 'limited' ELSE 'available' END AS status,
          CASE WHEN bool_or(fresh) AND bool_or(NOT fresh) THEN 'change' WHEN bool_or(fresh) THEN 'recent' ELSE 'historical' END AS scope, min(first_ts) AS from_ts, max(first_ts) AS to_ts FROM s GROUP BY payload""",
    "self_payloads": f"WITH {MESSAGE} SELECT CASE WHEN speaker_role = 'self' THEN concat(key, ' self') ELSE key END AS payload, bool_and(speaker_role = 'self') AS ok FROM keyed GROUP BY 1",
    "coarse_events": f"""WITH {EVENT}, e AS (SELECT concat('y-', user_id) AS payload, CAST(substring(id, 3) AS BIGINT) AS ord, id, CASE kind WHEN 'device' THEN 'location' ELSE kind END AS kind, start_ts, CASE WHEN user_id % 2 = 0 AND end_ts >= start_ts THEN end_ts END AS end_ts,
          CASE WHEN kind = 'device' THEN 'Location capture' ELSE title END AS title, CASE WHEN kind <> 'device' THEN concat('at ', user_id) END AS summary FROM context_event WHERE kind <> 'payment')
        SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY payload ORDER BY ord) <= 180""",
    "self_payload_observations": """SELECT payload, id, kind, sha256(substring(trim(text), 1, 600)) AS text, source_ids FROM (SELECT concat('y-', conv_id % 3) AS payload, conv_id * 100 + turn AS ord, concat('o-', conv_id, '-', turn) AS id, CASE turn % 3 WHEN 0 THEN 'routine' ELSE 'uncertainty' END AS kind, text, concat('m-', conv_id) AS source_ids
        FROM conversations WHERE turn <> 2 AND conv_id % 4 > 0 AND trim(text) <> '') QUALIFY row_number() OVER (PARTITION BY payload ORDER BY ord) <= 180""",
    "judge_inputs": f"""WITH {CLAIM}, o AS (SELECT person_id AS key, concat(source_id, kind, observed_ts) AS obs, concat('model-', score % 2) AS participant, CASE WHEN score % 5 = 0 THEN 'needs-review' WHEN score % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS v, source_id FROM claim)
        SELECT key, source_id, count(DISTINCT obs) AS observations, count(DISTINCT participant) AS participants, CASE WHEN bool_and(v = 'rejected') THEN 'rejected' WHEN bool_or(v = 'needs-review') THEN 'needs-review' WHEN count(DISTINCT participant) >= 2 THEN 'corroborated' ELSE 'single-source' END AS state FROM o GROUP BY key, source_id""",
    "advice_risks": f"""WITH {MESSAGE} SELECT id, CASE WHEN id LIKE '%-3' THEN 'empty' WHEN id LIKE '%-1' OR id LIKE '%-2' THEN 'manipulative-or-overconfident' WHEN regexp_matches(content, '(?i)pua') THEN 'manipulative-or-overconfident' END AS risk FROM message""",
    "guidance_current": f"""WITH {TASK}, p AS (SELECT id, location_id, list_transform(range(0, location_id % 3 + 1), lambda x: (location_id + x) % 7) AS people FROM task)
        SELECT id FROM p WHERE NOT (id LIKE '%4' AND people <> [0]) AND id NOT LIKE '%7' AND NOT list_contains(people, 3) AND location_id <> 20""",
    "task_times": f"""WITH {MESSAGE}, t AS (SELECT id, split_part(id, '-', 3) AS v, captured_ts AS c, strftime(captured_ts, '%Y年%-m月%-d日') AS d, strftime(captured_ts, '%H:%M') AS h FROM message)
        SELECT id, CASE v WHEN '1' THEN '开始/发生：2024-02-30' WHEN '5' THEN '开始/发生：soon' WHEN '2' THEN coalesce('发生：' || d, '未在来源中明确目标时间') WHEN '3' THEN coalesce('开始：' || d || '；截止：' || d || ' ' || h, '未在来源中明确目标时间')
            WHEN '4' THEN coalesce('截止：' || d || ' ' || h, '未在来源中明确目标时间') WHEN '6' THEN '未在来源中明确目标时间' ELSE coalesce('开始/发生：' || d, '未在来源中明确目标时间') END AS target,
          CASE v WHEN '1' THEN '开始/发生：2024-02-30' WHEN '5' THEN '开始/发生：soon' WHEN '2' THEN coalesce('发生：' || d, '未记录信息源时间') WHEN '3' THEN coalesce('开始/发生：' || d || '；截止：' || d || ' ' || h, '未记录信息源时间')
            WHEN '4' THEN coalesce('截止：' || d || ' ' || h, '未记录信息源时间') WHEN '6' THEN coalesce('信息源时间：' || d || ' ' || h, '未记录信息源时间') ELSE coalesce('开始/发生：' || d, '未记录信息源时间') END AS told,
          CASE WHEN v IN ('1', '5') OR c IS NULL THEN '待定' WHEN v IN ('4', '6') THEN h ELSE '全天' END AS clock, CASE WHEN v IN ('1', '5') OR c IS NULL THEN '未记录信息源时间' ELSE strftime(c, '%Y-%m-%d') END AS day FROM t""",
    "local_dates": f"""WITH {EVENT}, z AS (SELECT id, start_ts, user_id, ['Asia/Tokyo', 'America/New_York', 'UTC', 'UTC'][user_id % 4 + 1] AS zone, (user_id % 40) * 50 - 1000 AS raw FROM context_event), o AS (SELECT *, greatest(-840, least(840, raw)) AS m FROM z)
        SELECT id, zone, strftime(CASE zone WHEN 'Asia/Tokyo' THEN start_ts + INTERVAL 9 HOUR WHEN 'America/New_York' THEN start_ts - (CASE WHEN start_ts >= TIMESTAMP '2024-03-10 07:00:00' AND start_ts < TIMESTAMP '2024-11-03 06:00:00' THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END) ELSE start_ts END, '%Y-%m-%d') AS date,
          CASE WHEN user_id % 3 = 0 THEN 'offset unknown' ELSE concat('UTC', CASE WHEN m < 0 THEN '-' ELSE '+' END, lpad(CAST(abs(m) // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(abs(m) % 60 AS VARCHAR), 2, '0')) END AS offset FROM o""",
    "person_summaries": f"""WITH {REGISTRY}, k AS (SELECT person, count(*) FILTER (kind = 'fact') AS facts, count(*) FILTER (kind = 'preference') AS preferences FROM registry GROUP BY person)
        SELECT concat('p-', i) AS id, CASE WHEN i = 2 THEN '未命名人物' ELSE concat('peer-', i) END AS name, CAST(480 AS BIGINT) AS portrait, coalesce(facts, 0) AS facts, coalesce(preferences, 0) AS preferences FROM range(7) r(i) LEFT JOIN k ON person = concat('p-', i)""",
}
