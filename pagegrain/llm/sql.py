"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i)),
firsts AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s),
gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN firsts USING (s) WHERE f < doc_id) GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d),
kept AS (SELECT pos.doc_id, string_agg(x, ' ' ORDER BY i) AS k, count(*) AS n FROM pos LEFT JOIN (SELECT doc_id, unnest(p) AS i, true AS g FROM gone) USING (doc_id, i) WHERE g IS NULL GROUP BY pos.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP7 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
pos AS (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS x FROM d),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS s FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i),
islands AS (SELECT doc_id, s, i, i - row_number() OVER (PARTITION BY doc_id, s ORDER BY i) AS g FROM pairs),
runs AS (SELECT doc_id, s, min(i) AS i, count(*) AS n FROM islands GROUP BY doc_id, s, g),
longest AS (SELECT doc_id, max(n) AS longest FROM runs GROUP BY doc_id),
cov AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM runs WHERE n >= 5 UNION ALL SELECT doc_id, unnest(range(i + s, i + s + n)) FROM runs WHERE n >= 5) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(c, 0) AS n_repeat_words, coalesce(longest, 0) AS longest_repeat FROM d LEFT JOIN longest USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lines USING (doc_id)),
g AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND longest_repeat <= 100 AS kept FROM g"""

OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id GROUP BY x, y, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, c = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) USING (doc_id)"""

BITS = "list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, b: {BITS}), 4294967295)"

OP11 = f"""WITH d AS (SELECT doc_id, {WORDS} AS o, {CRC} AS h FROM documents),
e AS (SELECT doc_id, o, h, len(o) AS n, h // 10 AS g FROM d),
k AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM e),
w AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: o[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE o END AS w FROM k),
pos AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(w) AS x FROM w),
pairs AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i AND 4 * (b.i - a.i) <= a.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM islands GROUP BY doc_id, q, k),
runs AS (SELECT doc_id, s, l, min(q) AS q FROM stretches WHERE l >= greatest(6, 4 * q) GROUP BY doc_id, s, l),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l / q DESC, s, q) AS k FROM runs) WHERE k = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS r FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i, true AS g FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS c FROM pos LEFT JOIN gone USING (doc_id, i) WHERE g IS NULL GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli, sha256(coalesce(r, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP12 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS UBIGINT)) AS x FROM d),
c AS (SELECT *, CAST(least(x[1] % (n + 1), x[2] % (n + 1)) AS BIGINT) AS a, CAST(greatest(x[1] % (n + 1), x[2] % (n + 1)) AS BIGINT) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 50 THEN 'plain' WHEN x[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
s AS (SELECT *, array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m, array_to_string(list_slice(u, b + 1, n), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM s"""

ORACLE = {"op5_substring_dedup": OP5, "op7_quality_rules": OP7, "op10_minhash_dedup": OP10, "op11_periodic_runs": OP11, "op12_fill_in_middle": OP12}


LICENCES = f"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
phrases AS (SELECT * FROM (VALUES ('under the mit license', 'mit'), ('apache license version 2', 'apache-2'), ('cc by nc', 'cc-by-nc')) v(phrase, label)),
places AS (SELECT doc_id, label, i FROM d, phrases, LATERAL (SELECT unnest(range(0, len(w))) AS i) WHERE w[i + 1] = string_split(phrase, ' ')[1] AND array_to_string(list_slice(w, i + 1, i + len(string_split(phrase, ' '))), ' ') = phrase),
found AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM places GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(l, '') AS base_labels FROM d LEFT JOIN found USING (doc_id)"""

UNIGRAMS = f"""WITH d AS (SELECT doc_id, {CRC} % 7 = 2 AS held, list_append(regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+'), ' ') AS w FROM documents),
t AS (SELECT doc_id, held, unnest(w) AS x FROM d),
c AS (SELECT x, count(*) AS c FROM t WHERE NOT held GROUP BY x),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT doc_id, held AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) AS base_score FROM t LEFT JOIN c USING (x), n GROUP BY doc_id, held"""

BASE = {"licence_phrases": LICENCES, "unigram_scores": UNIGRAMS}
