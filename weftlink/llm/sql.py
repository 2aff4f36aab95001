"""DuckDB twins of the queries that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = r"[\x20\x09-\x0D]+"

OP1 = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex({LOWER}, '{BLANKS}'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT DISTINCT rid, g FROM (SELECT rid, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM d)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.rid <> b.rid GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT rid AS x, rid AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id FROM r JOIN d ON d.rid = r.x JOIN d o ON o.rid = r.y LEFT JOIN n ON n.rid = d.rid GROUP BY d.rid, d.doc_id"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP2 = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER}, '{_ALNUM}') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWER}, '{_ALNUM}') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS u(i) WHERE len(ws) > 0),
dw AS (SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM iw) k, unnest(range(1, len(ws) - n + 2)) AS u(i)),
m AS (SELECT rid, i, dw.n, item FROM dw JOIN iw ON iw.n = dw.n AND iw.g = dw.g),
h AS (SELECT rid, count(DISTINCT i + j) AS n_hit FROM m, unnest(range(0, m.n)) AS u(j) GROUP BY 1),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM m) GROUP BY 1),
l AS (SELECT rid, max(len) AS longest FROM (SELECT rid, count(*) - 1 + any_value(n) AS len FROM (SELECT DISTINCT m.rid, m.i, m.n, m.item, w.j, m.i - w.j AS diag, m.i - dense_rank() OVER (PARTITION BY m.rid, m.item, m.i - w.j ORDER BY m.i) AS run FROM m JOIN dw ON dw.rid = m.rid AND dw.i = m.i AND dw.n = m.n JOIN (SELECT item, least(13, len(ws)) AS n, i AS j, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS u(i) WHERE len(ws) > 0) w ON w.item = m.item AND w.n = m.n AND w.g = dw.g) GROUP BY rid, item, diag, run) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, coalesce(longest, 0)::BIGINT AS longest
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid) LEFT JOIN l USING (rid)"""

OP7 = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{BLANKS}'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, unnest([0, 1, 2]) AS v(k) GROUP BY 1),
m AS (SELECT w.rid, doc_id, host, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{BLANKS}', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 3 * n_words OR word_chars > 10 * n_words AS soft_failed FROM m),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed OR soft_failed) AS k FROM f GROUP BY 1),
p AS (SELECT count(*) AS h, sum(n)::DOUBLE AS w, sum(k) / sum(n) AS a, sum(n::DOUBLE * n) AS sq, sum(k::DOUBLE * k / n) AS rates FROM h), v AS (SELECT *, w - sq / w - (h - 1) AS free FROM p),
u AS (SELECT *, CASE WHEN a > 0 AND a < 1 AND free > 1e-9 THEN (rates - w * a * a - a * (1 - a) * (h - 1)) / (a * (1 - a) * free) ELSE 0 END AS rho FROM v), q AS (SELECT a, CASE WHEN rho > 1e-9 THEN greatest(1 / rho - 1, 1e-6) ELSE greatest(w, 10) END AS s FROM u),
z AS (SELECT host, (k + a * s) / (n + s) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (rate > 0.5 AND soft_failed) AS kept, soft_failed, round(rate, 6) AS host_rate, rate > 0.5 AS host_rejected FROM f JOIN z USING (host)"""

ORACLE_SQL = {"op1_ngram_jaccard_join": OP1, "op2_benchmark_decontamination": OP2, "op7_quality_rules": OP7}
