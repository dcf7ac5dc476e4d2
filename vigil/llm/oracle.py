"""DuckDB SQL of the queries that SQL can express; it shares nothing with the operators."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.s, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7 = """
WITH v AS (
  SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN CAST(1 AS HUGEINT) << (i - 1) ELSE 0 END)) AS UBIGINT) AS code
  FROM embeddings WHERE len(embedding) = 64),
d AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, CAST(bit_count(xor(q.code, r.code)) AS INTEGER) AS distance
  FROM v AS q, v AS r WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, distance FROM k WHERE rank <= 10
"""

OP8 = r"""
WITH RECURSIVE m AS (
  SELECT *, row_number() OVER (ORDER BY conv_id, turn, role, text) AS mid FROM (
    SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
l AS (SELECT mid, conv_id, turn, generate_subscripts(x, 1) AS i, unnest(x) AS raw
  FROM (SELECT mid, conv_id, turn, regexp_split_to_array(text, '\r\n|\n|\r') AS x FROM m)),
n AS (
  SELECT mid, conv_id, turn, i, length(regexp_replace(regexp_extract(raw, '^(?:[ \t]{0,3}>)+'), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(lower(regexp_replace(raw, '^(?:[ \t]{0,3}>)+', '')), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')) AS line FROM l),
cuts AS (
  SELECT *, lag(level) OVER w IS DISTINCT FROM level AS new_run,
         lag(level) OVER w IS DISTINCT FROM level OR (lag(line) OVER w = '') <> (line = '') AS new_part
  FROM n WINDOW w AS (PARTITION BY mid ORDER BY i)),
numbered AS (
  SELECT *, count(*) FILTER (new_run) OVER w AS run_no, count(*) FILTER (new_part) OVER w AS part_no
  FROM cuts WINDOW w AS (PARTITION BY mid ORDER BY i)),
runs AS (SELECT mid, run_no, string_agg(line, ' ' ORDER BY i) AS run FROM numbered WHERE line <> '' GROUP BY ALL),
parts AS (SELECT mid, part_no, string_agg(line, ' ' ORDER BY i) AS part FROM numbered WHERE line <> '' GROUP BY ALL),
units AS (SELECT conv_id, turn, level, line, run, part FROM numbered JOIN runs USING (mid, run_no) JOIN parts USING (mid, part_no) WHERE line <> ''),
said AS (SELECT DISTINCT conv_id, turn, unnest([run, part, line]) AS said FROM units WHERE level = 0),
asked AS (SELECT DISTINCT conv_id, turn, level, line, unnest([0, 1, 2]) AS rank, unnest([run, part, line]) AS said FROM units WHERE level > 0),
hits AS (
  SELECT a.conv_id, a.turn, a.said, max(s.turn) AS hit FROM (SELECT DISTINCT conv_id, turn, said FROM asked) AS a
  JOIN said AS s ON s.conv_id = a.conv_id AND s.said = a.said AND s.turn < a.turn GROUP BY ALL),
links AS (
  SELECT conv_id, turn, line, min(level) AS level, arg_max(hit, (100 - rank, hit)) FILTER (hit IS NOT NULL) AS hit
  FROM asked LEFT JOIN hits USING (conv_id, turn, said) GROUP BY ALL),
votes AS (SELECT conv_id, turn, hit, count(*) AS lines, count(*) FILTER (level = 1) AS direct FROM links GROUP BY ALL),
best AS (
  SELECT conv_id, turn, coalesce(sum(lines) FILTER (hit IS NOT NULL), 0) AS linked, arg_max(hit, (direct, lines, hit)) FILTER (hit IS NOT NULL) AS hit
  FROM votes GROUP BY ALL),
turns AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM (SELECT DISTINCT conv_id, turn FROM m)),
replies AS (
  SELECT conv_id, turn, previous, coalesce(hit, previous) AS parent, coalesce(linked, 0) AS linked FROM turns LEFT JOIN best USING (conv_id, turn)),
branching AS (SELECT DISTINCT conv_id FROM replies WHERE parent <> previous),
tree AS (
  SELECT conv_id, turn, [turn] AS path FROM replies SEMI JOIN branching USING (conv_id) WHERE parent IS NULL
  UNION ALL
  SELECT r.conv_id, r.turn, list_append(t.path, r.turn) FROM tree AS t JOIN replies AS r ON r.conv_id = t.conv_id AND r.parent = t.turn),
p AS (
  SELECT conv_id, turn, role, parent, linked,
         row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(path, [turn]), role, text) - 1 AS position,
         regexp_replace(regexp_replace(array_to_string(list_filter(regexp_split_to_array(text, '\r\n|\n|\r'),
           lambda x: NOT regexp_matches(x, '^(?:[ \t]{0,3}>)+')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS own
  FROM m JOIN replies USING (conv_id, turn) LEFT JOIN tree USING (conv_id, turn))
SELECT conv_id, CAST(position // 256 AS BIGINT) AS segment, count(*) AS n_messages,
       CAST(count(*) FILTER (linked > 0) AS BIGINT) AS n_linked,
       string_agg(coalesce(CAST(parent AS VARCHAR), ''), ',' ORDER BY position) AS parent_turns,
       string_agg('<|' || role || '|>' || chr(10) || own, chr(10) ORDER BY position) AS chat
FROM p GROUP BY 1, 2
"""

OP1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
k AS (SELECT s.doc_id, s.s, sha256(array_to_string(w[s.s:s.s + 19], ' ')) AS k FROM s JOIN d USING (doc_id)),
f AS (SELECT k, min(doc_id) AS doc FROM k GROUP BY k),
g AS (SELECT k.k, f.doc, min(k.s) AS s FROM k JOIN f ON f.k = k.k AND f.doc = k.doc_id GROUP BY ALL),
r AS (SELECT k.doc_id, k.s FROM k JOIN g USING (k) WHERE k.doc_id > g.doc OR k.s > g.s),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM r),
e AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d WHERE len(w) > 0),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS t FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p WHERE c.p IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN e USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
