"""DuckDB SQL of vector codes and spelling variants; it shares nothing with the operators."""

# ---- op11: four rounds over 4 parts of 16 components each, written out round by round

_SQUARES = " + ".join(f"(p.v[{i}] - b.v[{i}]) * (p.v[{i}] - b.v[{i}])" for i in range(1, 17))
_MEANS = ", ".join(f"(sum(v[{i}]) - ((sum(v[{i}]) % count(*)) + count(*)) % count(*)) // count(*)" for i in range(1, 17))


def _nearest(r: int) -> str:
    return f"""a{r} AS MATERIALIZED (
  SELECT vec_id, label, part, any_value(v) AS v, min(struct_pack(d := d, e := entry)) AS best
  FROM (SELECT p.vec_id, p.label, p.part, p.v, b.entry, {_SQUARES} AS d FROM p JOIN b{r} AS b USING (part)) GROUP BY vec_id, label, part)"""


def _round(r: int) -> str:
    return f"""{_nearest(r)},
b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{r} AS b LEFT JOIN (
    SELECT part, best.e AS entry, list_transform([{_MEANS}], lambda x: CAST(x AS BIGINT)) AS v FROM a{r} GROUP BY ALL) AS m USING (part, entry))"""


OP11 = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, v[part * 16 + 1:part * 16 + 16] AS v FROM kept, range(4) AS t(part)),
b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 256),
{_round(0)},
{_round(1)},
{_round(2)},
{_round(3)},
{_nearest(4)},
codes AS (
  SELECT vec_id, label, string_agg(format('{{:02x}}', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a4 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b4) AS codebooks_sha256
FROM codes
"""

# ---- op12: the checksum as a sum (XOR) of the shares of its bytes, which depend on the byte and its place from the end


def _table_steps() -> str:
    steps = "SELECT i AS byte, i AS c FROM range(256) AS t(i)"
    for _ in range(8):
        steps = f"SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM ({steps})"
    return steps


OP12 = rf"""
WITH RECURSIVE crc AS MATERIALIZED ({_table_steps()}),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents) GROUP BY ALL),
coded AS MATERIALIZED (
  SELECT *, hex(encode(concat(doc_id, ':', run))) AS bytes, length(hex(encode(concat(doc_id, ':', run)))) // 2 AS size FROM runs),
longest AS (SELECT max(size) AS top FROM coded),
share AS (
  SELECT 0 AS place, byte, c FROM crc
  UNION ALL SELECT place + 1, s.byte, xor(s.c >> 8, t.c) FROM share AS s JOIN crc AS t ON t.byte = s.c & 255 WHERE place + 1 < (SELECT top FROM longest)),
start AS (
  SELECT 0 AS size, CAST(4294967295 AS BIGINT) AS c
  UNION ALL SELECT size + 1, xor(s.c >> 8, t.c) FROM start AS s JOIN crc AS t ON t.byte = s.c & 255 WHERE size < (SELECT top FROM longest)),
placed AS (
  SELECT doc_id, run, size - pos AS place, CAST(concat('0x', substr(bytes, 2 * pos - 1, 2)) AS BIGINT) AS byte
  FROM (SELECT doc_id, run, bytes, size, unnest(range(1, size + 1)) AS pos FROM coded)),
summed AS (SELECT doc_id, run, bit_xor(c) AS c FROM placed JOIN share USING (place, byte) GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(xor(m.c, s.c), 4294967295) AS h FROM coded JOIN summed AS m USING (doc_id, run) JOIN start AS s USING (size)),
slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN concat(left(run, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM hashed),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
cut AS MATERIALIZED (
  SELECT word, n, pos, concat(left(word, pos - 1), substr(word, pos + 1)) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM w)),
pairs AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS m FROM cut AS a JOIN cut AS b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut AS c JOIN w ON w.word = c.rest
  UNION SELECT w.word, c.word, c.n FROM cut AS c JOIN w ON w.word = c.rest),
best AS MATERIALIZED (SELECT word, count(*) AS n_near, min(struct_pack(minus := -m, near := near)) AS b FROM pairs GROUP BY word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.minus >= 5 * w.n THEN b.near END AS form, CASE WHEN -b.minus >= 5 * w.n THEN -b.minus END AS form_n
  FROM w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS last, 0 AS depth FROM forms
  UNION ALL SELECT c.word, f.form, depth + 1 FROM chain AS c JOIN forms AS f ON f.word = c.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM forms AS f JOIN (SELECT word, arg_max(last, depth) AS root FROM chain GROUP BY word) AS r USING (word)
"""
