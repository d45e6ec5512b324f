"""What DuckDB finds for the queries of this package that SQL can express on whole tables. doc_id is a key there."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIX = rf"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 12) AS h FROM documents),
s AS (SELECT source, sum(size) AS ss FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, 3.0::DOUBLE * ss AS cap FROM s),
f AS (SELECT *, cap / weight AS fills FROM w),
l AS (SELECT *, (sum(ss) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level FROM f WINDOW b AS (ORDER BY fills, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, CAST(ss AS BIGINT) AS ss, least(cap, weight * (SELECT arg_min(level, fills) FROM l WHERE level <= fills)) AS target FROM l),
b AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS base, target - CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END * ss AS budget FROM t),
c AS (SELECT doc_id, size, ss, target, base, budget, sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS n FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, ss AS source_size, target, CAST(size * (base + CASE WHEN base < 3 AND (upto <= budget OR (upto - n <= budget AND upto - budget < budget - (upto - n))) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c"""

LINES = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS nw FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
p AS (SELECT doc_id, i, x, nw, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM w),
f AS (SELECT doc_id, i, nw, y, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1 AS one, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, i) > 1 AS two FROM p),
g AS (SELECT doc_id, i FROM f WHERE one AND nw >= 4 UNION SELECT doc_id, i FROM f WHERE two AND y IS NOT NULL UNION SELECT doc_id, i + 1 FROM f WHERE two AND y IS NOT NULL),
m AS (SELECT l.doc_id, l.line, l.x, w.i, g.i AS gone FROM l LEFT JOIN w USING (doc_id, line) LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = w.i)
SELECT doc_id, count(i) AS n_lines, count(gone) AS n_removed, md5(coalesce(string_agg(x, chr(10) ORDER BY line) FILTER (gone IS NULL), '')) AS kept_md5 FROM m GROUP BY doc_id"""

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i)),
k AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS node, count(*) AS n FROM s GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(node, '') AS node, coalesce(n, 0) AS n FROM w LEFT JOIN k USING (doc_id)),
c AS (SELECT node, min(doc_id) AS head, count(*) AS weight, max(n) AS n FROM d GROUP BY node),
r AS (SELECT c.node, g FROM c JOIN s ON s.doc_id = c.head),
q AS (SELECT a.node AS u, b.node AS v, count(*) AS shared FROM r a JOIN r b ON a.g = b.g AND a.node <> b.node GROUP BY u, v),
e AS (SELECT u, v FROM q JOIN c a ON a.node = u JOIN c b ON b.node = v WHERE shared >= 0.8 * (a.n + b.n - shared) - 1e-9),
t AS (SELECT node AS u, node AS v FROM c UNION SELECT t.u, e.v FROM t JOIN e ON t.v = e.u),
m AS (SELECT t.u AS node, min(c.head) AS class_id FROM t JOIN c ON c.node = t.v GROUP BY t.u),
x AS (SELECT e.u AS node, sum(c.weight) AS links FROM e JOIN c ON c.node = e.v GROUP BY e.u)
SELECT d.doc_id, m.class_id, CAST(coalesce(x.links, 0) + c.weight - 1 AS BIGINT) AS n_links FROM d JOIN m USING (node) JOIN c USING (node) LEFT JOIN x USING (node)"""

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i)),
f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g),
r AS (SELECT doc_id, i FROM s JOIN f USING (g) WHERE doc_id > first),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM r, (SELECT unnest(range(13)) AS j)),
p AS (SELECT doc_id, p, w[p] AS x FROM w, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p)),
k AS (SELECT p.doc_id, count(*) AS n_words, count(c.p) AS n_removed, string_agg(x, ' ' ORDER BY p.p) FILTER (c.p IS NULL) AS kept FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.p = p.p GROUP BY p.doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)"""


def _cell(v: str) -> str:
    return f"(({v} >> greatest(length(bin({v})) - 7, 0)) << greatest(length(bin({v})) - 7, 0))"


def _quartiles(keys: str, source: str) -> str:
    upto = f"SELECT *, sum(n) OVER (PARTITION BY {keys}, measure ORDER BY value) AS upto, sum(n) OVER (PARTITION BY {keys}, measure) AS total FROM {source}"
    return f"SELECT {keys}, measure, {', '.join(f'min(value) FILTER (4 * upto >= {q} * total) AS q{q}' for q in (1, 2, 3))}, max(total) AS total FROM ({upto}) GROUP BY ALL"


def _at(measure: str, q: int) -> str:
    return f"max(q{q}) FILTER (measure = '{measure}')"


def _inside(v: str, size: str, k: str, low: bool) -> str:
    beyond = f"CAST(greatest({v} - {k}3, {f'{k}1 - {v}, ' if low else ''}0) AS DOUBLE)"
    reach = f"CAST(6 * {k}s AS DOUBLE)"
    return f"{beyond} * {beyond} * {size} <= {reach} * {reach} * greatest({size}, {k}m)"


QUALITY = rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
r AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (SELECT unnest(range(5)) AS j) GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, source, len(w) AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
t AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 1000 * n_symbols // greatest(word_chars, 1) AS symbols, 100 * word_chars // greatest(n_words, 1) AS length_, 1000 * n_dup_lines // greatest(n_words, 1) AS lines FROM b),
u AS (SELECT lang, source, measure, value FROM t, LATERAL (SELECT unnest(['symbols', 'length', 'lines', 'words', 'chars']) AS measure, unnest([{', '.join(map(_cell, ('symbols', 'length_', 'lines', 'n_words', 'word_chars')))}]) AS value) WHERE NOT base_failed),
k AS (SELECT lang, source, measure, value, count(*) AS n FROM u GROUP BY ALL),
own AS ({_quartiles('lang, source', 'k')}),
merged AS ({_quartiles('lang', '(SELECT lang, measure, value, sum(n) AS n FROM k GROUP BY ALL)')}),
q AS (SELECT own.lang, source, own.measure, {', '.join(f'(own.total * own.q{q} + 30 * merged.q{q}) // (own.total + 30) AS q{q}' for q in (1, 2, 3))} FROM own JOIN merged ON own.lang IS NOT DISTINCT FROM merged.lang AND own.measure = merged.measure),
p AS (SELECT lang, source, {_at('symbols', 1)} AS s1, {_at('symbols', 3)} AS s3, {_at('chars', 2)} AS sm, {_at('length', 1)} AS l1, {_at('length', 3)} AS l3, {_at('words', 2)} AS lm, {_at('lines', 1)} AS n1, {_at('lines', 3)} AS n3, {_at('words', 2)} AS nm FROM q GROUP BY ALL),
f AS (SELECT *, greatest(s3 - s1, s3 // 16, 1000 // greatest(sm, 1), 1) AS ss, greatest(l3 - l1, l3 // 16, 100 // greatest(lm, 1), 1) AS ls, greatest(n3 - n1, n3 // 16, 1000 // greatest(nm, 1), 1) AS ns FROM p)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
coalesce(NOT base_failed AND {_inside('symbols', 'word_chars', 's', False)} AND {_inside('length_', 'n_words', 'l', True)} AND {_inside('lines', 'n_words', 'n', False)}, false) AS kept
FROM t LEFT JOIN f ON t.lang IS NOT DISTINCT FROM f.lang AND t.source IS NOT DISTINCT FROM f.source"""
