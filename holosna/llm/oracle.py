"""DuckDB SQL for the opN_ queries that SQL can express on the small tables."""

_ESCAPED = "replace(replace(replace({0}, '\\', '\\\\'), '<|', '<\\|'), '|>', '|\\>')"

#: Words are taken from the UTF-8 text; the classes name ASCII only, so code points do as well as bytes.
OP2 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
m AS (SELECT doc_id, places.size, i, item_id FROM places JOIN win ON places.g = win.g AND places.size = win.size),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""

OP3 = f"""
WITH t0 AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
t1 AS (
  SELECT *, (strlen(text) + 3) // 4 + 4 AS cost, row_number() OVER w AS rn,
    length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + 11 AS piece
  FROM t0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
t2 AS (SELECT *, rn = 1 AND role = 'system' AS sys FROM t1),
t3 AS (
  SELECT *, sum(CASE WHEN sys THEN 0 ELSE cost END) OVER w AS upto,
    greatest(384 - coalesce(max(CASE WHEN sys THEN cost END) OVER (PARTITION BY conv_id), 0), 64) AS body,
    coalesce(max(CASE WHEN sys THEN piece END) OVER (PARTITION BY conv_id), 0) AS sys_piece
  FROM t2 WINDOW w AS (PARTITION BY conv_id ORDER BY rn ROWS UNBOUNDED PRECEDING)),
t4 AS (
  SELECT *, upto - CASE WHEN sys THEN 0 ELSE cost END AS before,
    CASE WHEN sys THEN NULL ELSE 2 * floor((upto - cost) / body) + CASE WHEN floor((upto - 1) / body) > floor((upto - cost) / body) THEN 1 ELSE 0 END END AS win0
  FROM t3),
t5 AS (SELECT *, coalesce(win0, lead(win0) OVER w, 0) AS win FROM t4 WINDOW w AS (PARTITION BY conv_id ORDER BY rn)),
t6 AS (
  SELECT *, coalesce(lag(win) OVER w <> win, true) AS begins,
    CASE WHEN NOT lag(sys, 1) OVER w AND before - lag(before, 1) OVER w <= 128 THEN lag(piece, 1) OVER w ELSE 0 END
    + CASE WHEN NOT lag(sys, 2) OVER w AND before - lag(before, 2) OVER w <= 128 THEN lag(piece, 2) OVER w ELSE 0 END AS history
  FROM t5 WINDOW w AS (PARTITION BY conv_id ORDER BY rn))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(piece + CASE WHEN begins AND NOT sys THEN sys_piece_own + history ELSE 0 END) AS BIGINT) AS formatted_chars
FROM (SELECT *, CASE WHEN rn = 2 AND sys_piece > 0 THEN 0 ELSE sys_piece END AS sys_piece_own FROM t6)
GROUP BY conv_id
"""

_NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '[^ ]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(WIDTH, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(WIDTH, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT two.b, r.root FROM r JOIN two ON two.a = r.node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.root AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) m ON m.node = w.doc_id
"""

OP7 = _NEAR.replace("WIDTH", "4")
OP12 = f"SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM ({_NEAR.replace('WIDTH', '3')})"

#: crc32 of the bytes of hex text {0}, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length({0}) // 2), lambda i: ('0x' || substr({0}, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

OP11 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+') AS w
  FROM documents),
b AS (
  SELECT unnest(regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+')) AS g
  FROM benchmark),
f AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(w) AS g FROM d) GROUP BY doc_id, g),
k AS MATERIALIZED (SELECT g, {_CRC.format("h")} % 10000 AS bucket FROM (SELECT g, hex(encode(g)) AS h FROM (SELECT g FROM f UNION SELECT g FROM b))),
s AS (SELECT bucket, sum(n) AS s FROM f JOIN k USING (g) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (g) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0)::DOUBLE + 10000)
    / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + 10000)))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)),
w AS (SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS weight FROM f JOIN k USING (g) JOIN gain USING (bucket) GROUP BY doc_id),
v AS (
  SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN w ON w.doc_id = d.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM v WHERE n_features >= 20)
SELECT v.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM v LEFT JOIN r ON r.doc_id = v.doc_id
"""

_LEAF = "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in ("doc_id::VARCHAR", "source", "lang", "({0})::VARCHAR", "text")) + ")"

OP13 = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, lang, {_LEAF.format("n_chars")} AS leaf, {_LEAF.format("n_chars + (" + _CRC.format("hex(encode(doc_id::VARCHAR))") + " % 7 = 0)::INT")} AS told,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents),
up AS (
  SELECT lang, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL SELECT lang, max(level) + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), max((n + 1) // 2) FROM up WHERE n > 1 GROUP BY lang, pos // 2),
own AS MATERIALIZED (SELECT * FROM up),
tops AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM own WHERE n = 1),
up2 AS (
  SELECT 0 AS level, pos, subroot AS node, count(*) OVER () AS n FROM tops
  UNION ALL SELECT max(level) + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), max((n + 1) // 2) FROM up2 WHERE n > 1 GROUP BY pos // 2),
top AS MATERIALIZED (SELECT * FROM up2),
path AS (
  SELECT doc_id, leaf, told, l.lang, l.pos, list({{'x': s.node, 'r': (l.pos >> u.level) & 1}} ORDER BY u.level) AS p
  FROM leaves l JOIN own u ON u.lang IS NOT DISTINCT FROM l.lang AND u.pos = l.pos >> u.level AND u.n > 1
  LEFT JOIN own s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = u.level AND s.pos = xor(u.pos, 1)
  GROUP BY ALL),
paths AS (SELECT * FROM path UNION ALL SELECT doc_id, leaf, told, lang, pos, [] FROM leaves WHERE doc_id NOT IN (SELECT doc_id FROM path)),
path2 AS (
  SELECT lang, subroot, (SELECT node FROM top WHERE n = 1) AS root,
    coalesce((SELECT list({{'x': s.node, 'r': (t.pos >> u.level) & 1}} ORDER BY u.level) FROM top u LEFT JOIN top s ON s.level = u.level AND s.pos = xor(u.pos, 1) WHERE u.n > 1 AND u.pos = t.pos >> u.level), []) AS q
  FROM tops t),
whole AS (SELECT doc_id, leaf, told, subroot, root, p || q AS p FROM paths JOIN path2 ON path2.lang IS NOT DISTINCT FROM paths.lang),
f AS (
  SELECT doc_id, 0 AS level, told AS node, p FROM whole
  UNION ALL SELECT doc_id, level + 1, sha256(CASE WHEN p[level + 1].r = 1 THEN p[level + 1].x || node ELSE node || coalesce(p[level + 1].x, '') END), p FROM f WHERE level < len(p))
SELECT whole.doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(whole.p, lambda s: coalesce(s.x, '')), ''), '')) AS proof_sha256, f.node AS folded_root, f.node = root AS verified
FROM whole JOIN f ON f.doc_id = whole.doc_id AND f.level = len(whole.p)
"""

ORACLE_SQL = {"op2_decontamination": OP2, "op3_chat_formatting": OP3, "op7_ngram_join": OP7, "op11_importance_resampling": OP11, "op12_odd_sketches": OP12, "op13_merkle_manifest": OP13}
