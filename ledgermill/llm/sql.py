"""DuckDB SQL for the results that SQL can express."""

from __future__ import annotations

from ledgermill.llm.quality_rules import ALPHA, CUTOFFS, DELTA

_SPACE = r"[\x20\x09-\x0D]+"

OP1 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM d)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y, i = cx.n AND i = cy.n AS same FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE i >= 0.8 * (cx.n + cy.n - i) - 1e-9),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN links l ON l.x = r.y),
cl AS (SELECT x AS doc_id, min(y) AS class_id FROM r GROUP BY 1),
l AS (SELECT x AS doc_id, count(*) AS n_links, min(y) FILTER (same) AS twin FROM links GROUP BY 1)
SELECT doc_id, class_id, least(doc_id, coalesce(twin, doc_id)) AS text_class, coalesce(c.n, 0) AS n_shingles, coalesce(n_links, 0) AS n_links FROM cl LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
"""

_SCORE = {
    "symbol_ratio": "CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END",
    "exclaim_ratio": "CASE WHEN word_chars > 0 THEN n_exclaims / word_chars ELSE 0 END",
    "dup_line_ratio": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END",
    "repeat_ratio": "CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END",
    "mean_word_long": "CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END",
    "mean_word_short": "-CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END",
}
_GRID = ", ".join(f"('{r}', {i}, CAST({x} AS DOUBLE))" for r, xs in CUTOFFS.items() for i, x in enumerate(xs))
_LONG = " UNION ALL ".join(f"SELECT rid, stratum, '{r}' AS rule, CAST({e} AS DOUBLE) AS score FROM f" for r, e in _SCORE.items())

OP10 = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, chr(1)) AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT rid, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, 8) AS x(k) GROUP BY 1),
f AS (SELECT rid, doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(text, '[^!?]', '', 'g')) AS n_exclaims FROM t JOIN w USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
s AS ({_LONG}),
seen AS (SELECT rid, q >= 1 AS good FROM b JOIN (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY 1) USING (doc_id) WHERE NOT base_failed),
grid AS (SELECT * FROM (VALUES {_GRID}) v(rule, i, cut)),
k AS (SELECT * FROM (SELECT stratum, i, count(DISTINCT rid) FILTER (good) AS n, count(DISTINCT rid) FILTER (good AND score > cut) AS k, count(DISTINCT rid) FILTER (NOT good AND score > cut) AS bad FROM s JOIN seen USING (rid) JOIN grid USING (rule) GROUP BY ALL) WHERE n > 0),
strata AS (SELECT count(DISTINCT stratum) AS m FROM k),
tail AS (SELECT stratum, i, bad, k < n * {ALPHA} AND (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA}))) FROM range(0, CAST(least(k, n * {ALPHA}) AS BIGINT) + 1) AS x(j)) <= {DELTA} / m AS passes FROM k, strata),
fails AS (SELECT stratum, coalesce(min(i) FILTER (NOT passes), 999) AS first FROM tail GROUP BY 1),
steps AS (SELECT stratum, min(i) AS i FROM tail JOIN (SELECT stratum, max(bad) AS bad FROM tail JOIN fails USING (stratum) WHERE i < first GROUP BY 1) USING (stratum, bad) GROUP BY 1),
cuts AS (SELECT stratum, rule, cut FROM steps JOIN grid USING (i)),
fired AS (SELECT DISTINCT rid FROM s JOIN cuts USING (stratum, rule) WHERE score > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fired.rid IS NULL AS kept FROM b LEFT JOIN fired USING (rid)
"""

OP11 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = e.label AS same, e.vec_id, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""

# crc32 by its table: a byte's entry is its eight halvings, with the reversed polynomial where a bit falls out.
OP12 = r"""
WITH tab AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t FROM range(256) x(i)),
d AS (SELECT 'c' AS kind, row_number() OVER () AS uid, doc_id, text FROM documents UNION ALL SELECT 't', 0, NULL, text FROM benchmark),
w AS (SELECT kind, uid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM d),
u AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM w)),
c AS (SELECT w, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM u, tab),
f AS (SELECT kind, uid, bucket FROM w JOIN c USING (w)),
n AS (SELECT bucket, count(*) FILTER (kind = 'c') AS s, count(*) FILTER (kind = 't') AS t FROM f GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((n.t + 1) * (a.s + 10000.0) / ((n.s + 1) * (a.t + 10000.0)))) AS gain FROM n, (SELECT CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM n) a),
x AS (SELECT uid, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN g USING (bucket) WHERE kind = 'c' GROUP BY 1),
h AS (SELECT uid, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN x USING (uid) WHERE kind = 'c'),
r AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM h),
k AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM k
"""

OP13 = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS i FROM s),
-- Filling up: if the first i - 1 sources by size for weight have stopped, the rest is shared by weight; the first i where none of the others is above.
l AS (SELECT i, (SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER b, 0) AS rest, sum(w) OVER a AS all_w, source_size, w FROM o WINDOW b AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT i, rest, all_w FROM l WHERE rest * w <= 3 * source_size * all_w ORDER BY i LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN o.i < f.i THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(rest AS DOUBLE) * w / CAST(all_w AS DOUBLE) END AS target FROM o, f),
k AS (SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) // greatest(source_size, 1) AS e, CAST(coalesce(sum(size) OVER p, 0) AS BIGINT) AS before
  FROM (SELECT *, CAST('0x' || substr(sha256('13:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS key FROM d) d JOIN t ON d.source IS NOT DISTINCT FROM t.source
  WINDOW p AS (PARTITION BY d.source ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, size, source_size, target, e * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - e * source_size - before)) AS taken FROM k
"""
