"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

W = "[^\\x20\\x09-\\x0D]+"

OP1 = f"""
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS key, source, coalesce(len(regexp_extract_all(text, '{W}')), 0)::BIGINT AS size, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS draw FROM documents
), src AS (
  SELECT key, source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY key, source
), room AS (
  SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, (source_size * 3)::DOUBLE AS room FROM src
), lvl AS (
  SELECT *, ((SELECT sum(source_size) FROM src)::DOUBLE - coalesce(sum(room) OVER (ORDER BY room / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (ORDER BY room / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM room
), aimed AS (
  SELECT *, least(room, (SELECT max(level) FROM lvl) * weight) AS target FROM lvl
), seats AS (SELECT round((SELECT sum(source_size) FROM src)::DOUBLE / 16)::BIGINT AS m
), sq AS (
  SELECT key, count(*) AS quota FROM (SELECT key, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, rank, k) AS place FROM aimed, (SELECT unnest(generate_series(1, (SELECT m FROM seats))) AS k) WHERE target > 0) WHERE place <= (SELECT m FROM seats) GROUP BY key
), quotas AS (
  SELECT a.key, source_size, target, coalesce(quota, 0) AS source_quota, least(4096, greatest(1, ceil(source_size / 131072)))::BIGINT AS n_shards FROM aimed a LEFT JOIN sq USING (key)
), placed AS (SELECT s.*, source_size, target, source_quota, draw % n_shards AS shard FROM sized s JOIN quotas USING (key)
), sh AS (SELECT key, shard, sum(size)::BIGINT AS s, max(source_quota) AS source_quota FROM placed GROUP BY key, shard
), shq AS (
  SELECT key, shard, count(*) AS quota FROM (SELECT key, shard, source_quota, row_number() OVER (PARTITION BY key ORDER BY s::DOUBLE / (2 * k - 1) DESC, shard, k) AS place FROM sh, (SELECT unnest(generate_series(1, (SELECT m FROM seats))) AS k) WHERE s > 0 AND k <= source_quota) WHERE place <= source_quota GROUP BY key, shard
), give AS (SELECT sh.key, sh.shard, s, least(coalesce(quota, 0) * 16, 3 * s) AS give FROM sh LEFT JOIN shq ON sh.key = shq.key AND sh.shard = shq.shard
), pas AS (SELECT *, CASE WHEN s > 0 THEN give // s ELSE 0 END AS passes, s // 16 AS blocks FROM give
), plan AS (
  SELECT *, least(blocks, round((give - passes * s) / 16.0::DOUBLE)::BIGINT) AS drawn, CASE WHEN blocks > 0 THEN ('0x' || substr(md5('17/' || key || '/' || shard), 1, 15))::BIGINT % blocks ELSE 0 END AS start FROM pas
), run AS (
  SELECT p.doc_id, p.size, p.source_size, p.target, passes, blocks, drawn, start, sum(p.size) OVER (PARTITION BY p.key, p.shard ORDER BY p.draw, p.doc_id, p.size ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM placed p JOIN plan q ON p.key = q.key AND p.shard = q.shard
), cut AS (SELECT *, least(e // 16, blocks) AS je, least((e - size) // 16, blocks) AS jb FROM run)
SELECT doc_id, size, source_size, target, (passes * size + CASE WHEN blocks > 0 THEN
  ((je * drawn + start) // blocks * 16 + CASE WHEN je < blocks THEN (((je + 1) * drawn + start) // blocks - (je * drawn + start) // blocks) * (e - je * 16) ELSE 0 END)
  - ((jb * drawn + start) // blocks * 16 + CASE WHEN jb < blocks THEN (((jb + 1) * drawn + start) // blocks - (jb * drawn + start) // blocks) * (e - size - jb * 16) ELSE 0 END) ELSE 0 END)::BIGINT AS taken FROM cut
"""

OP3 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_sum(list_transform(x, lambda c: abs(c))) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach AS (SELECT vec_id AS n, vec_id AS r FROM v UNION SELECT l.a, reach.r FROM reach JOIN link l ON l.b = reach.n),
comp AS (SELECT n, min(r) AS c FROM reach GROUP BY n), deg AS (SELECT a, count(*) AS k FROM link GROUP BY a)
SELECT v.vec_id, coalesce(k, 0)::BIGINT AS n_links, c AS component_id, v.vec_id = c AS kept FROM v JOIN comp ON comp.n = v.vec_id LEFT JOIN deg ON deg.a = v.vec_id
"""

OP6 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{W}') AS ws FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 19], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w WHERE len(ws) >= 20)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM win) WHERE k > 1),
gone AS (SELECT doc_id, list(DISTINCT i) AS g FROM (SELECT doc_id, p + unnest(range(0, 20)) AS i FROM again) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(ws) AS t, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT word.doc_id, string_agg(t, ' ' ORDER BY i) AS s FROM word LEFT JOIN gone USING (doc_id) WHERE g IS NULL OR NOT list_contains(g, i) GROUP BY word.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP5 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT r, p, md5(substr(h, 2 * p + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, greatest(0, length(h) // 2 - 199))) AS p FROM d)),
rep AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1),
run AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS g FROM (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM rep)),
span AS (SELECT r, min(p) AS a, max(p) + 200 AS b FROM run GROUP BY r, g),
cut AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed FROM span GROUP BY r),
part AS (SELECT r, a, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS s, a AS e FROM span UNION ALL SELECT r, 1000000000000, max(b), NULL FROM span GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, 2 * s + 1, CASE WHEN e IS NULL THEN length(h) ELSE 2 * (e - s) END), '' ORDER BY a) AS k FROM part JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN cut USING (r) LEFT JOIN kept USING (r)
"""

OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{W}') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[p:p + 4], ' ')) AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS p FROM w WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
pair AS (SELECT a, b FROM both JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
link AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT doc_id AS n, doc_id AS r FROM w UNION SELECT l.a, reach.r FROM reach JOIN link l ON l.b = reach.n),
comp AS (SELECT n, min(r) AS c FROM reach GROUP BY n)
SELECT doc_id, c AS class_id, doc_id = c AS kept FROM w JOIN comp ON n = doc_id
""".replace("both", "shared")

#: The kinds, in order, with pattern, group judged and least length.
KINDS = (
    ("assign", "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("hub", "gh[opsru]_[A-Za-z0-9]{36,}", 0, 40),
)
_SCAN = " UNION ALL ".join(
    f"SELECT doc_id, row, {k} AS rank, '{n}' AS kind, list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS gap, list_transform(regexp_extract_all(t, '{p}', 0), lambda x: length(x)) AS own, list_transform(regexp_extract_all(t, '{p}', {g}), lambda x: length(x)) AS judged, {least} AS least FROM d WHERE regexp_matches(t, '{p}')"
    for k, (n, p, g, least) in enumerate(KINDS)
)
OP8 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents), scan AS ({_SCAN}),
hit AS (SELECT row, rank, kind, least, list_sum(gap[1:i]) + coalesce(list_sum(own[1:i - 1]), 0) AS a, own[i] AS n, judged[i] AS j FROM (SELECT *, unnest(range(1, len(own) + 1)) AS i FROM scan)),
span AS (SELECT row, rank, kind, a, kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT AS s FROM hit WHERE j >= least),
found AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(s, ',' ORDER BY a, rank) FILTER (rank < 3) AS base, string_agg(s, ',' ORDER BY a, rank) AS spans FROM span GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN found USING (row)
"""

OP11 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT a.r AS ar, a.id AS anchor_id, b.r AS br, b.id AS id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.id % 100 = 0),
pos AS (SELECT ar, anchor_id, br, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id NULLS LAST, br) <= 5),
neg AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.id NULLS LAST, s.br)::INT AS rank FROM pos p JOIN s ON s.ar = p.ar AND NOT s.alike WHERE 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 10
"""

#: Control strings by their first character, and the marks about a turn's text.
_LESS, _BRACKET = r"s>|/s>|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>", r"INST\]|/INST\]|TURN\]|/TURN\]"
_MARKS = {"user": len("[INST] ") + len(" [/INST]"), "assistant": len("<s>") + len("</s>"), "system": len("<<SYS>>\n") + len("\n<</SYS>>")}
_ESCAPED = lambda c: f"regexp_replace(regexp_replace({c}, '(<\\\\*)({_LESS})', '\\1\\\\\\2', 'g'), '(\\[\\\\*)({_BRACKET})', '\\1\\\\\\2', 'g')"
OP12 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, k, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(k, role)),
p AS (SELECT *, {_ESCAPED("text")} AS e, CASE role {" ".join(f"WHEN '{r}' THEN {n}" for r, n in _MARKS.items())} ELSE 14 + length(replace(replace({_ESCAPED("role")}, '%', '%25'), chr(10), '%0A')) END AS marks FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, e)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, e) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(length(e) + marks)::BIGINT AS formatted_chars FROM p GROUP BY conv_id
"""

OP13 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{W}') AS ws FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY part, mask),
o AS (SELECT '' AS s UNION ALL SELECT s || c FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) t(c) WHERE NOT contains(s, c)),
st AS (SELECT s AS filter_order, k::INT AS step, 1 << (ascii(s[k]) - 65) AS bit, list_sum([0] || list_transform(range(1, k), lambda j: 1 << (ascii(s[j]) - 65)))::INT AS before FROM (SELECT s, unnest(range(1, 6)) AS k FROM o WHERE length(s) = 5)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & before = 0) AS removed, sum(n) FILTER (mask & bit > 0 AND mask & before > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails, sum(g) FILTER (mask & bit > 0 AND mask & before = 0) AS good_lost, sum(x) FILTER (mask & bit > 0 AND mask & before = 0) AS toxic_lost FROM m, st GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM r
"""

ORACLE_SQL = {"op11_hard_negatives": OP11, "op12_chat_format": OP12, "op13_filter_audit": OP13, "op1_source_mixing": OP1, "op3_embedding_dedup": OP3, "op5_suffix_dedup": OP5, "op7_minhash_dedup": OP7, "op6_substring_dedup": OP6, "op8_secret_scans": OP8}
