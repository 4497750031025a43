"""SQL twins of the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = rf"""WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item, 8 AS n, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT item, w, unnest(range(1, len(w) - 6)) AS i FROM items WHERE len(w) >= 8)
  UNION SELECT item, len(w), array_to_string(w, ' ') FROM items WHERE len(w) BETWEEN 1 AND 7),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM grams),
runs AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
met AS (SELECT doc_id, i, r.n, item FROM runs r JOIN grams USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS found FROM met GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(found), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(found, ','), '')) AS items_sha256, coalesce(len(found), 0) >= 2 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""

_NIBBLES = "0000000100100011010001010110011110001001101010111100110111101111"
ARCHIVE = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS size, min(page_id) OVER (PARTITION BY h) AS head,
  array_to_string(list_transform(string_split(sha1(h), ''), lambda c: substr('{_NIBBLES}', 4 * (strpos('0123456789abcdef', c) - 1) + 1, 4)), '') AS bits FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(0, 5), lambda b: CAST(substr(bits, 5 * k + b + 1, 1) AS INTEGER) * (16 >> CAST(b AS INTEGER)))) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM d"""

JACCARD = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
either AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN either e ON r.b = e.a)
SELECT a AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(b) AS component_id FROM reach LEFT JOIN n ON a = doc_id GROUP BY a"""

MIXING = r"""WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS total FROM d GROUP BY source),
e AS (SELECT CAST(max(total) AS DOUBLE) / sum(total) AS top, CAST(min(total) AS DOUBLE) / sum(total) AS least, CAST(sum(total) AS DOUBLE) AS grand FROM s WHERE total > 0),
b AS (SELECT 0 AS k, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi UNION ALL
  SELECT k + 1, CASE WHEN pow(top / least, 1 - (lo + hi) / 2) <= 2 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN pow(top / least, 1 - (lo + hi) / 2) <= 2 THEN (lo + hi) / 2 ELSE hi END FROM b, e WHERE k < 60),
t AS (SELECT CASE WHEN top / least <= 2 THEN 0 ELSE hi END AS t, top, grand FROM b, e WHERE k = 60),
p AS (SELECT source, total, pow(total / grand, t) / (SELECT sum(pow(total / grand, t)) FROM s, t WHERE total > 0) AS weight, CASE WHEN total > 0 THEN pow(top / (total / grand), 1 - t) ELSE 1 END AS passes FROM s, t),
c AS (SELECT *, CAST(floor(passes + 1e-9) AS BIGINT) AS whole, floor(greatest(passes - floor(passes + 1e-9), 0) * total + 1e-6) AS rest FROM p),
k AS (SELECT d.*, whole, rest, weight, md5('mix:' || (whole + 1) || ':' || doc_id) AS key FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
r AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < rest AS more FROM k),
x AS (SELECT doc_id, source, weight, unnest(range(1, whole + CASE WHEN more THEN 1 ELSE 0 END + 1)) AS epoch FROM r)
SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, substr(md5('mix:' || epoch || ':' || doc_id), 1, 3) AS block,
  row_number() OVER (PARTITION BY epoch, substr(md5('mix:' || epoch || ':' || doc_id), 1, 3) ORDER BY md5('mix:' || epoch || ':' || doc_id)) AS position, round(weight, 9) AS weight FROM x"""

ORACLES = {"op4_decontamination": CONTAMINATION, "op6_warc": ARCHIVE, "op7_jaccard": JACCARD, "op10_mixing": MIXING}
