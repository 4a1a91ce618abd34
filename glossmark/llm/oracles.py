"""DuckDB SQL of the registered queries that SQL can express, on whole tables."""

_WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS symbols,
    (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656 AS u
  FROM documents),
k AS (SELECT doc_id, source, size, -ln(u) / (1.0::DOUBLE / (1.0::DOUBLE + 4.0::DOUBLE * symbols / greatest(size, 1))) AS e FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM k GROUP BY source),
f AS (
  SELECT *, 2.0::DOUBLE * source_size / w AS ratio FROM s),
g AS (
  SELECT *, row_number() OVER o AS rank,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM f WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
l AS (SELECT min_by(level, rank) AS level FROM g WHERE level < ratio),
t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT level FROM l) * w, 2.0::DOUBLE * source_size)) AS target FROM g),
b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM t),
c AS (
  SELECT k.*, b.source_size, b.target,
    CASE WHEN b.source_size > 0 THEN b.budget // b.source_size ELSE 0 END AS epochs,
    CASE WHEN b.source_size > 0 THEN b.budget % b.source_size ELSE 0 END AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY e, doc_id, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    count(*) OVER (PARTITION BY k.source, e, doc_id, size) AS n
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + CASE
    WHEN upto <= rest THEN size WHEN upto - n * size < rest THEN (rest - (upto - n * size)) // n ELSE 0 END AS BIGINT) AS taken
FROM c
"""

OP7 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM documents),
tri AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
m AS (
  SELECT d.*, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov ON cov.r = d.r),
l AS (SELECT source, t, unnest(list_transform(lines, lambda x: regexp_replace(trim(regexp_replace(
    translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[0-9]+', '0', 'g'))) AS line
  FROM (SELECT DISTINCT source, t, lines FROM d)),
n AS (SELECT source, line, count(DISTINCT t) AS texts FROM l GROUP BY source, line),
c AS (SELECT source, line FROM n WHERE texts >= 10),
lost AS (SELECT l.source, l.t, sum(len(string_split(l.line, ' '))) AS gone
  FROM l JOIN c ON l.source IS NOT DISTINCT FROM c.source AND l.line = c.line GROUP BY l.source, l.t),
v AS (SELECT m.*, coalesce(gone, 0)::BIGINT AS n_line_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m LEFT JOIN lost ON m.source IS NOT DISTINCT FROM lost.source AND m.t = lost.t)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_line_words,
  NOT base_failed AND 100 * (n_words - n_line_words) >= 30 * n_words AS kept
FROM v
"""

OP8 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1] * p[2], 0))), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 5
"""

OP9 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, top) AS (SELECT a, a FROM e UNION SELECT e.b, r.top FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.top, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT id, min(top) AS top FROM r GROUP BY id) c ON c.id = d.doc_id
"""

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM again),
k AS (
  SELECT x.r, string_agg(x.word, ' ' ORDER BY x.p) AS kept, count(*) AS n
  FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x LEFT JOIN gone ON gone.r = x.r AND gone.p = x.p
  WHERE gone.r IS NULL GROUP BY x.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.r = d.r
"""

#: crc32 by half bytes: the table holds the remainders of the 16 half bytes.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x)), lambda i: (strpos('0123456789ABCDEF', x[
    CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END]) - 1)::BIGINT)), lambda c, b: xor(c >> 4, [
    0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888,
    3412177804, 2607071920, 2262029012, 2685067896, 3183342108][1 + (xor(c, b) & 15)])), 4294967295)"""

OP11 = rf"""
WITH texts AS (
    SELECT doc_id, 'd' AS side, text FROM documents UNION ALL SELECT item_id, 'b', text FROM benchmark),
words AS (
    SELECT doc_id, side, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
held AS (SELECT doc_id, side, word, count(*) AS n FROM words GROUP BY ALL),
forms AS (SELECT word, {_CRC32} % 10000 AS bucket FROM (SELECT DISTINCT word, hex(encode(word)) AS x FROM held)),
sums AS (
    SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t
    FROM held JOIN forms USING (word) GROUP BY bucket),
gains AS (
    SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM sums),
weights AS (
    SELECT doc_id, sum(n)::BIGINT AS n, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS w
    FROM held JOIN forms USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
    SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight, coalesce(w, 0) + floor(-1000 * ln(-ln(
        (('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM documents LEFT JOIN weights USING (doc_id)),
drawn AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS most FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * most // 100 THEN r END AS rank FROM scored LEFT JOIN drawn USING (doc_id)
"""
