"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP1 = r"""
WITH split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM split WHERE len(w) >= 50),
wins AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM starts),
firsts AS (SELECT h, min(doc_id) AS first FROM wins GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM wins JOIN firsts USING (h) WHERE doc_id > first),
place AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM split),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM place ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""

OP2 = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
keyed AS (SELECT doc_id, p, line, translate(trim(line, concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k IN (SELECT k FROM common)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (k NOT IN (SELECT k FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""

OP10 = r"""
WITH doc AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
item AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 13) AS n FROM item WHERE len(w) > 0 AND item_id IS NOT NULL),
iwin AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
lens AS (SELECT DISTINCT n FROM sized),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lens WHERE len(w) >= n)),
occ AS (SELECT doc_id, item_id, n, i FROM dwin JOIN iwin USING (n, t)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
met AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM occ GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN met USING (doc_id)
"""

OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM p
"""

OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""



def _step(x: str, cost: str, letter: str, line: str = "NULL") -> str:
    """A way (struct of the cost and audit, and the text) with one more edit; null stays null. Struct order is by cost, then audit."""
    text = f"{x}.t" if line == "NULL" else f"CASE WHEN {x}.t = '' THEN {line} ELSE {x}.t || chr(10) || {line} END"
    return f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 't': {text}}} END"


def _inserts(into: str) -> str:
    """SQL of one round of inserts over the ways s0 to s3."""
    s2 = f"list_min([s2, {_step('s0', '5', 'I', repr('user:'))}, {_step('s1', '5', 'I', repr('user:'))}, {_step('s3', '5', 'I', repr('user:'))}])"
    return f"SELECT * REPLACE ({s2} AS s2, list_min([s3, {_step('s2', '5', 'I', repr('assistant:'))}]) AS s3) FROM ({into})"


def _rows() -> str:
    stay = "gone = 0 AND "
    own = "role || ':' || text"
    s0 = _step("s0", "2", "D")
    s1 = f"list_min([{_step('s1', '2', 'D')}, CASE WHEN {stay} i = 's' THEN {_step('s0', 'cut', 'K', own)} END])"
    s2 = ", ".join([_step("s2", "2", "D")] + [f"CASE WHEN {stay} i = 'u' THEN {_step(s, 'cut', 'K', own)} END, CASE WHEN {stay} true THEN {_step(s, 'cut + 1', 'R', repr('user:') + ' || text')} END" for s in ("s0", "s1", "s3")])
    s3 = ", ".join([_step("s3", "2", "D"), f"CASE WHEN {stay} i = 'a' THEN {_step('s2', 'cut', 'K', own)} END", f"CASE WHEN {stay} true THEN {_step('s2', 'cut + 1', 'R', repr('assistant:') + ' || text')} END"])
    return f"SELECT w.conv_id, w.p + 1 AS p, {s0} AS s0, {s1} AS s1, list_min([{s2}]) AS s2, list_min([{s3}]) AS s3 FROM ways w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.p = w.p + 1"


# A fold over the places of each conversation: the least way into each state. CRC-32 is worked out bit by bit.
_WAY = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
OP11 = f"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS name FROM conversations),
hashed AS (SELECT *, xor(list_reduce(list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(h, c)), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind FROM named),
kept AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed WHERE kind <> 0),
put AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p, rtrim(text, concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))) AS ending, left(role, 1) AS i FROM kept),
marked AS (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY p) AS i_before, CASE WHEN ending = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 2 WHEN right(ending, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM put),
faulty AS (SELECT *, CASE WHEN fault IN (1, 2) THEN 1 ELSE 0 END AS gone, CASE WHEN fault = 3 THEN 5 ELSE 0 END AS cut FROM marked),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (p > 1 AND concat(i_before, i) NOT IN ('su', 'ua', 'au')) AS illegal, max(p) AS n FROM faulty GROUP BY conv_id),
ways AS (SELECT conv_id, CAST(0 AS BIGINT) AS p, CAST({{'c': 0, 'a': '', 't': ''}} AS {_WAY}) AS s0, CAST(NULL AS {_WAY}) AS s1, CAST(NULL AS {_WAY}) AS s2, CAST(NULL AS {_WAY}) AS s3 FROM told
         UNION ALL SELECT conv_id, p, s0, s1, s2, s3 FROM ({_rows().replace("FROM ways w", f"FROM ({_inserts(_inserts('SELECT * FROM ways'))}) w")})),
ended AS (SELECT conv_id, p, list_min([s0, s3]) AS best FROM ({_inserts(_inserts("SELECT * FROM ways"))})),
found AS (SELECT t.*, best FROM told t JOIN ended e ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.n = e.p)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit,
       sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN found f ON o.conv_id IS NOT DISTINCT FROM f.conv_id
"""

OP13 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * c.x[i])) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""

ORACLE_SQL = {"op13_hard_negatives": OP13, "op11_conversation_repair": OP11, "op5_topk_search": OP5, "op8_warc_archive": OP8, "op10_decontaminate": OP10, "op1_substring_dedup": OP1, "op2_line_dedup": OP2}
