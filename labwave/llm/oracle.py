"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

# Systematic sampling, written as plain windows over a whole source.
OP1 = r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-2#' || coalesce('=' || doc_id, '-') || '#' || coalesce('=' || source, '-') || '#' || coalesce('=' || text, '-')) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, 2 * source_size AS cap,
         (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
           - (coalesce(sum(2 * source_size) OVER (ORDER BY (2 * source_size)::DOUBLE / weight, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE)
         / (sum(weight) OVER (ORDER BY (2 * source_size)::DOUBLE / weight, source NULLS LAST
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl,
         row_number() OVER (ORDER BY (2 * source_size)::DOUBLE / weight, source NULLS LAST) AS pos
  FROM s),
l AS (SELECT arg_min(lvl, pos) AS lvl FROM r WHERE cap > weight * lvl),
t AS (
  SELECT source, source_size, weight, least(cap::DOUBLE, weight * coalesce(l.lvl, 'infinity'::DOUBLE)) AS target,
         ('0x' || substr(md5('mix-2|' || coalesce('s' || source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS off
  FROM r, l),
c AS (SELECT *, length(bin(size)) AS bits FROM d),
k AS (
  SELECT doc_id, source, size, h,
         bits * 16 + floor(size / pow(2, greatest(bits - 4, 0)))::BIGINT AS class
  FROM c),
n AS (SELECT source, class, ceil(count(*) / 512.0)::BIGINT AS nb FROM k GROUP BY source, class),
o AS (
  SELECT k.doc_id, k.source, k.size,
         row_number() OVER (PARTITION BY k.source ORDER BY k.class, ('0x' || substr(k.h, 1, 8))::BIGINT % n.nb, k.size, k.h) AS rk
  FROM k JOIN n ON k.source IS NOT DISTINCT FROM n.source AND k.class = n.class),
f AS (
  SELECT o.doc_id, o.size, t.source_size, t.target, o.source, t.weight,
         CASE WHEN t.source_size > 0 THEN
           floor(rk * (t.target / t.source_size) + t.off) - floor((rk - 1) * (t.target / t.source_size) + t.off)
         ELSE 0 END::BIGINT AS copies
  FROM o JOIN t ON o.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, source, weight FROM f
"""

# Lines of four or more words on five or more sites stay only where they occur first.
OP8 = r"""
WITH s AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
o AS (
  SELECT doc_id, source, i, trim(ls[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM s)),
c AS (
  SELECT line, min({'d': doc_id, 'i': i}) AS f FROM o WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 5),
g AS (SELECT o.doc_id, o.i, c.line IS NOT NULL AND {'d': o.doc_id, 'i': o.i} <> c.f AS gone FROM o LEFT JOIN c USING (line)),
t AS (
  SELECT g.doc_id, string_agg(s.ls[g.i], chr(10) ORDER BY g.i) FILTER (NOT gone) AS text, count(*) FILTER (gone) AS n
  FROM g JOIN s ON s.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT s.doc_id, CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text, coalesce(t.n, 0)::INTEGER AS n_removed
FROM s LEFT JOIN t ON s.doc_id = t.doc_id
"""

_VECTORS = """SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

# Every query against every row.
OP2 = f"""
WITH v AS (SELECT vec_id, list_transform(e, lambda x: floor(64 * x)) AS e FROM ({_VECTORS}) t),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

# All pairs of a label, and what can be reached over links.
OP9 = f"""
WITH RECURSIVE n AS (
  SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM ({_VECTORS}) t
  WHERE label IS NOT NULL AND len(e) > 0 AND list_inner_product(e, e) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON b.label = a.label AND len(b.e) = len(a.e) AND b.vec_id <> a.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
m AS (SELECT a, min(b) AS low FROM r GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN m ON m.a = vec_id
"""

# Every term of an item against every document that holds it.
OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
c AS (SELECT count(*)::BIGINT AS nd, sum(len(ws))::BIGINT AS nt FROM d WHERE len(ws) > 0),
t AS (SELECT uid, w, count(*)::BIGINT AS tf FROM (SELECT uid, unnest(ws) AS w FROM d) x GROUP BY uid, w),
f AS (SELECT w, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM t, c GROUP BY w, nd),
q AS (
  SELECT DISTINCT iid, item_id, w FROM (
    SELECT row_number() OVER () AS iid, item_id,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark) y),
s AS (
  SELECT iid, item_id, d.uid, doc_id,
         sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(ws) * nd) // nt))))::BIGINT AS score
  FROM q JOIN t USING (w) JOIN f USING (w) JOIN d ON d.uid = t.uid, c GROUP BY iid, item_id, d.uid, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST, uid)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""

# Windows and lines as rows; hosts' failure rates shrunk by a beta prior from the variance between hosts.
OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT uid, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i
  FROM (SELECT uid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d) x),
g AS (SELECT uid, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY uid ORDER BY i)),
h AS (SELECT uid, i, w, w3 IS NOT NULL AND count(*) OVER (PARTITION BY uid, w, w2, w3) > 1 AS again FROM g),
r AS (SELECT uid, w, bool_or(again) OVER (PARTITION BY uid ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS covered FROM h),
a AS (SELECT uid, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (covered) AS n_repeat_words FROM r GROUP BY uid),
l AS (
  SELECT uid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT uid, unnest(string_split(text, chr(10))) AS line FROM d) x
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY uid),
m AS (
  SELECT d.uid, doc_id, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN a USING (uid) LEFT JOIN l USING (uid)),
x AS (
  SELECT uid, source, unnest(['short', 'repeated', 'symbols', 'dup_lines', 'word_length']) AS rule,
         unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 10 * n_dup_lines > 3 * n_lines,
                 word_chars < 3 * n_words OR word_chars > 10 * n_words]) AS bad FROM m),
p AS (SELECT source, rule, count(*)::BIGINT AS n, count(*) FILTER (bad)::BIGINT AS k FROM x GROUP BY source, rule),
t AS (
  SELECT rule, count(*)::DOUBLE AS hosts, sum(n)::DOUBLE AS docs, sum(n::DOUBLE * n) AS sq, sum(k)::DOUBLE AS f, sum(k::DOUBLE * k / n) AS fs
  FROM p GROUP BY rule),
v AS (
  SELECT rule, f / docs AS mean, CASE WHEN hosts > 1 AND docs > hosts THEN greatest(0, fs - f * (f / docs)) / (hosts - 1) END AS between_,
         CASE WHEN hosts > 1 AND docs > hosts THEN greatest(0, f - fs) / (docs - hosts) END AS within_,
         CASE WHEN hosts > 1 THEN (docs - sq / docs) / (hosts - 1) END AS typical FROM t),
u AS (
  SELECT rule, mean, CASE WHEN between_ > within_
         THEN least(1000, greatest(2, (between_ + (typical - 1) * within_) / (between_ - within_) - 1)) ELSE 1000 END AS worth FROM v),
e AS (SELECT p.source, p.rule, (k + mean * worth) / (n + worth) AS rate FROM p JOIN u USING (rule)),
y AS (
  SELECT x.uid, bool_or(bad AND x.rule IN ('short', 'repeated')) AS base_failed, bool_or(rate >= 0.5 OR bad AND rate >= 0.2) AS goes
  FROM x JOIN e ON x.source IS NOT DISTINCT FROM e.source AND x.rule = e.rule GROUP BY x.uid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT goes AS kept
FROM m JOIN y USING (uid)
"""

ORACLES = {"op2_topk_search": OP2, "op9_embedding_near_dedup": OP9, "op8_line_dedup": OP8, "op1_mix_sources": OP1,
           "op11_lexical_search": OP11, "op12_quality_rules": OP12}
