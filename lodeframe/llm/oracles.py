"""DuckDB SQL for the queries of this subpackage that SQL can express."""

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# The reflected CRC of the decimal digits of an id, bit by bit.
CRC = "xor(list_reduce(list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT), lambda a, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b)), 4294967295::BIGINT), 4294967295::BIGINT)"


def _windows(n: int) -> str:
    return f"SELECT doc_id, unnest(range(1, len(l) - {n - 2})) AS i, unnest(list_transform(range(1, len(l) - {n - 2}), lambda k: array_to_string(l[k:k + {n - 1}], ' '))) AS g FROM w WHERE len(l) >= {n}"


OP1 = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS l FROM documents),
five AS ({_windows(5)}),
eight AS ({_windows(8)}),
rep5 AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM five) WHERE c > 1) GROUP BY 1),
rep8 AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM eight) WHERE c > 1) GROUP BY 1),
diagonals AS (SELECT a.doc_id, b.i - a.i AS d, a.i, a.i - row_number() OVER (PARTITION BY a.doc_id, b.i - a.i ORDER BY a.i) AS run FROM eight a JOIN eight b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i),
longest AS (SELECT doc_id, max(n) + 7 AS n FROM (SELECT doc_id, d, run, count(*) AS n FROM diagonals GROUP BY ALL) GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
facts AS (
  SELECT w.doc_id, len(l)::BIGINT AS n_words, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(rep5.n, 0) AS n_repeat_words, coalesce(rep8.n, 0) AS covered_words, coalesce(longest.n, 0) AS longest_repeat
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN rep5 USING (doc_id) LEFT JOIN rep8 USING (doc_id) LEFT JOIN longest USING (doc_id)
), judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM facts)
SELECT *, NOT base_failed AND covered_words <= 0.18::DOUBLE * n_words AND longest_repeat <= 50 AS kept FROM judged
"""

OP3 = f"""
WITH d AS (SELECT doc_id, coalesce({CRC.format("CAST(doc_id AS VARCHAR)")} % 7 = 2, FALSE) AS held_out, list_concat(list_concat([' begin'], {WORDS.format(LOWER)}), [' end']) AS l FROM documents),
u AS (SELECT doc_id, held_out, i, l[i] AS x, l[i - 1] AS h, CASE WHEN i > 2 THEN l[i - 2] END AS g FROM (SELECT *, unnest(range(2, len(l) + 1)) AS i FROM d)),
c1 AS (SELECT x, count(*) AS c FROM u WHERE NOT held_out GROUP BY 1),
c0 AS (SELECT h, count(*) AS c FROM u WHERE NOT held_out GROUP BY 1),
c2 AS (SELECT h, x, count(*) AS c FROM u WHERE NOT held_out GROUP BY 1, 2),
c3 AS (SELECT g, h, x, count(*) AS c FROM u WHERE NOT held_out AND g IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c1),
p AS (
  SELECT doc_id, held_out, t.n, coalesce(c1.c, 0) AS c, (coalesce(c1.c, 0) + 1) / (t.n + t.v + 1) AS p1, coalesce(c0.c, 0) AS ch, coalesce(c2.c, 0) AS ch_x, coalesce(b.c, 0) AS cgh, coalesce(c3.c, 0) AS cgh_x
  FROM u LEFT JOIN c1 ON u.x = c1.x LEFT JOIN c0 ON u.h = c0.h LEFT JOIN c2 ON u.h = c2.h AND u.x = c2.x
    LEFT JOIN c2 b ON u.g = b.h AND u.h = b.x LEFT JOIN c3 ON u.g = c3.g AND u.h = c3.h AND u.x = c3.x, t
),
two AS (SELECT *, CASE WHEN ch > 0 THEN (ch_x + 4 * p1) / (ch + 4) ELSE p1 END AS p2 FROM p)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(log10(p1)), 6) AS base_score,
  round(sum(log10(CASE WHEN cgh > 0 THEN (cgh_x + 4 * p2) / (cgh + 4) ELSE p2 END)), 6) AS score
FROM two GROUP BY 1, 2
"""

OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER)} AS l FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')] ELSE list_transform(range(1, len(l) - 3), lambda k: array_to_string(l[k:k + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
  HAVING 100 * count(*) >= 85 * ((SELECT n FROM n WHERE doc_id = a.doc_id) + (SELECT n FROM n WHERE doc_id = b.doc_id) - count(*))),
r AS (SELECT a AS root, b AS doc_id FROM e UNION SELECT r.root, e.b FROM r JOIN e ON r.doc_id = e.a)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(root), n.doc_id)) AS component_id, n.doc_id <= coalesce(min(root), n.doc_id) AS kept FROM n LEFT JOIN r ON n.doc_id = r.doc_id GROUP BY n.doc_id, n.n
"""



def _spans(pattern: str, kind: int, group: int = 0) -> str:
    pattern = "'" + pattern.replace("'", "''") + "'"
    size = lambda x: f"coalesce(list_sum(list_transform({x}, lambda z: length(z))), 0)"
    begin = f"({size('s[1:i]')} + {size('m[1:i - 1]')})"
    found = f"SELECT doc_id, regexp_extract_all(t, {pattern}) AS m, regexp_extract_all(t, {pattern}, {group}) AS g, string_split_regex(t, {pattern}) AS s FROM d"
    return f"SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'a': {begin}::BIGINT, 'k': {kind}, 'b': ({begin} + length(m[i]))::BIGINT, 'v': g[i]}})) AS x FROM ({found})"


ALIVE = "regexp_matches(x.v, '[0-9]') AND regexp_matches(x.v, '[A-Za-z]') AND len(list_distinct(string_split(x.v, ''))) >= least(10, ceil(length(x.v) * 0.7)) AND NOT regexp_matches(x.v, '(?i)example|sample|dummy|changeme|placeholder|xxxx|1234567|abcdef0|todo')"
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

OP7 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, concat_ws('/', source, lang) AS repository, source AS owner FROM documents),
base AS (SELECT * FROM ({_spans(ASSIGN, 0, 2)}) WHERE length(x.v) >= 6 UNION ALL {_spans("AKIA[A-Z0-9]{16,}", 1)} UNION ALL {_spans("[0-9a-f]{24,}", 2)}),
loose AS (SELECT * FROM ({_spans("[A-Za-z0-9+/_=-]{20,}", 3)}) l WHERE {ALIVE} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = l.doc_id AND b.x.a < l.x.b AND l.x.a < b.x.b)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM loose),
live AS (SELECT x.v AS v FROM every JOIN d USING (doc_id) WHERE {ALIVE} GROUP BY 1 HAVING count(DISTINCT owner) < 3),
own AS (SELECT doc_id, x FROM every WHERE x.v IN (SELECT v FROM live)),
listed AS (SELECT doc_id, x FROM base UNION ALL SELECT doc_id, x FROM own WHERE x.k = 3),
named AS (SELECT doc_id, x, ['assign', 'access', 'hex', 'loose'][x.k + 1] || ':' || x.a || ':' || x.b AS s FROM listed),
b AS (SELECT doc_id, count(*) FILTER (x.k = 0) AS n_assign, count(*) FILTER (x.k = 1) AS n_access, count(*) FILTER (x.k = 2) AS n_hex, string_agg(s, ',' ORDER BY x.a, x.k) FILTER (x.k < 3) AS base, string_agg(s, ',' ORDER BY x.a, x.k) AS spans FROM named GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_live FROM own GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP11 = f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS hit FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(0, CASE hit WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM raw WHERE hit <> 0
),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    left(role, 1) AS c, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e FROM damaged
),
f AS (SELECT *, e = '' AS blank, e <> '' AND nth > 1 AS again, e <> '' AND nth = 1 AND right(e, 1) NOT IN ('.', '!', '?') AS short, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM o),
insertions(p, r, price, letters) AS (VALUES (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'IJ'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'IJ'), (2, 2, 0, ''), (2, 3, 3, 'J'), (3, 3, 0, ''), (3, 2, 3, 'I')),
moves(r, q, letter, need) AS (VALUES (0, 0, 'D', ''), (1, 1, 'D', ''), (2, 2, 'D', ''), (3, 3, 'D', ''), (0, 2, 'R', ''), (1, 2, 'R', ''), (3, 2, 'R', ''), (2, 3, 'S', ''), (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (2, 3, 'K', 'a'), (3, 2, 'K', 'u')),
sizes AS (SELECT conv_id, count(*) AS n FROM f GROUP BY 1),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM sizes
  UNION ALL
  SELECT w.conv_id, w.i + 1, m.q, min({{'cost': (w.best.cost + x.price + CASE m.letter WHEN 'D' THEN 4 WHEN 'K' THEN 0 ELSE 3 END + CASE WHEN m.letter <> 'D' AND f.short THEN 3 ELSE 0 END)::BIGINT, 'audit': w.best.audit || x.letters || m.letter}})
  FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN insertions x ON x.p = w.state JOIN moves m ON m.r = x.r AND (m.letter = 'D' OR NOT (f.blank OR f.again) AND (m.letter <> 'K' OR m.need = f.c))
  GROUP BY 1, 2, 3
),
ends AS (
  SELECT w.conv_id, min({{'cost': (w.best.cost + coalesce(x.price, 0))::BIGINT, 'audit': w.best.audit || coalesce(x.letters, '')}}) AS best
  FROM walk w JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.n = w.i LEFT JOIN insertions x ON x.p = w.state AND x.r = 3 AND w.state > 0 GROUP BY 1
),
letters AS (SELECT conv_id, k, string_split(audit, '')[k] AS letter FROM (SELECT conv_id, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS k FROM ends)),
placed AS (SELECT *, 1 + coalesce(sum((letter NOT IN ('I', 'J'))::INTEGER) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS i FROM letters),
repaired AS (
  SELECT l.conv_id, string_agg(CASE l.letter WHEN 'I' THEN 'user:' WHEN 'J' THEN 'assistant:' WHEN 'K' THEN f.role || ':' || f.text WHEN 'R' THEN 'user:' || f.text ELSE 'assistant:' || f.text END, chr(10) ORDER BY l.k) AS lines
  FROM placed l LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.i = l.i WHERE l.letter <> 'D' GROUP BY 1
),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (short) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(ends.best.cost, 0) AS cost, translate(coalesce(ends.best.audit, ''), 'JS', 'IR') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""

OP12 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS x FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY x) AS c FROM w) WHERE c > 1),
g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM m),
s AS (SELECT r, k, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM g) GROUP BY 1, 2),
edges AS (SELECT r, 0 AS a, 0 AS b FROM d UNION ALL SELECT r, a, b FROM s),
rest AS (SELECT r, b AS begin, lead(a) OVER (PARTITION BY r ORDER BY b, a) AS until FROM edges),
kept AS (SELECT r, string_agg(substr(h, 2 * begin + 1, 2 * (coalesce(until, len(h) // 2) - begin)), '' ORDER BY begin) AS k FROM rest JOIN d USING (r) GROUP BY 1),
n AS (SELECT r, sum(b - a)::BIGINT AS removed, count(*) AS spans FROM s GROUP BY 1)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM d JOIN kept USING (r) LEFT JOIN n USING (r)
"""

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = f"""
WITH d AS (SELECT doc_id, unnest({TERMS}) AS t FROM documents),
s AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS tokens FROM s),
f AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY 1, 2),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY t, docs),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({TERMS}) AS t FROM benchmark) GROUP BY 1, 2),
scored AS (
  SELECT item_id, doc_id, sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // tokens))))::BIGINT AS score
  FROM q JOIN f USING (t) JOIN w USING (t) JOIN s USING (doc_id), c GROUP BY 1, 2
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""

SQL = {"op1_suffix_repetition": OP1, "op3_backoff_automaton": OP3, "op5_bbit_minhash": OP5, "op7_secret_owners": OP7, "op11_cyk_repair": OP11, "op12_run_index": OP12, "op13_max_sketch": OP13}
