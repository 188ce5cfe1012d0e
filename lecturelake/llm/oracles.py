"""SQL statements of the operators' results, for DuckDB; each restates its contract plainly, without hashes or routing."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _words(name: str, text: str, pattern: str, table: str, key: str) -> str:
    """Rows (key, pos, word) of a table's texts, in order."""
    return f"{name} AS (SELECT {key}, u.pos AS pos, u.word AS word FROM {table}, unnest(regexp_extract_all({text}, {pattern})) WITH ORDINALITY AS u(word, pos))"


def near(num: int, more: str = "") -> str:
    """Components of documents whose sets of 4-word shingles are alike by num hundredths; ``more``: further columns."""
    return f"""
WITH RECURSIVE {_words("w", _LOWER, _SPACED, "documents", "doc_id")},
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
g AS (SELECT doc_id, pos, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d AS g FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
s AS (SELECT DISTINCT doc_id, g FROM g WHERE g IS NOT NULL UNION SELECT doc_id, string_agg(word, ' ' ORDER BY pos) FROM w JOIN n USING (doc_id) WHERE n < 4 GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN k a ON a.doc_id = x JOIN k b ON b.doc_id = y WHERE 100 * c >= {num} * (a.k + b.k - c)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, coalesce(k, 0) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id{more} FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN c ON x = d.doc_id
"""


NGRAM_JOIN = near(85)
MIN_HASH = near(80, ", d.doc_id = least(d.doc_id, coalesce(y, d.doc_id)) AS kept")

SUBSTRING_DEDUP = f"""
WITH {_words("w", "coalesce(text, '')", _SPACED, "documents", "doc_id")},
v AS (SELECT doc_id, pos, word, count(*) OVER f AS n, string_agg(word, ' ') OVER f AS win FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
h AS (SELECT doc_id, pos, word, n = 35 AND count(*) OVER (PARTITION BY n, win) > 1 AS hit FROM v),
c AS (SELECT doc_id, pos, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM h),
t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN t USING (doc_id)
"""

_BYTES = """x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, u.k AS k, substr(h, CAST(u.k * 1000 + 1 AS BIGINT), 1398) AS part, length(h) // 2 AS n FROM x, unnest(range(0, length(h) // 1000 + 1)) AS u(k)),
y AS (SELECT doc_id, n, k * 500 + u.i AS pos, substr(part, CAST(2 * u.i + 1 AS BIGINT), 2) AS byte, part, u.i AS i FROM q, unnest(range(0, least(500, length(part) // 2))) AS u(i))"""

SUFFIX_DEDUP = f"""
WITH {_BYTES},
v AS (SELECT doc_id, pos, byte, n, CASE WHEN pos + 200 <= n THEN md5(substr(part, CAST(2 * i + 1 AS BIGINT), 400)) END AS win FROM y),
h AS (SELECT doc_id, pos, byte, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS hit FROM v),
c AS (SELECT doc_id, pos, byte, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS gone FROM h),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM c),
t AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed, count(*) FILTER (opens) AS spans, string_agg(byte, '' ORDER BY pos) FILTER (NOT gone) AS kept FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM documents d LEFT JOIN t USING (doc_id)
"""

DECONTAMINATION = f"""
WITH {_words("w", _LOWER, _PLAIN, "documents", "doc_id")}, {_words("b", _LOWER, _PLAIN, "benchmark", "item_id")},
bw AS (SELECT item_id, pos, list(word) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM b),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, l FROM bw WHERE item_id IS NOT NULL AND (len(l) = 10 OR pos = 1)),
lens AS (SELECT DISTINCT len(l) AS n FROM win),
dw AS (SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM w),
o AS (SELECT doc_id, pos, n, item FROM dw JOIN lens ON len(dw.l) >= n JOIN win ON win.l = dw.l[1:n]),
c AS (SELECT doc_id, count(DISTINCT u.p) AS hit FROM (SELECT DISTINCT doc_id, pos, n FROM o), unnest(range(pos, pos + n)) AS u(p) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item) AS items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM o GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(hit, 0) AS n_hit, coalesce(items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""

# the checksum byte by byte, with its table by the rule that makes it; then the least capacity by halving, each time with a greedy fill
_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"

SHARDING = f"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT {_CRC_TABLE} AS tab), {_BYTES},
bytes AS (SELECT doc_id, list(CAST('0x' || byte AS BIGINT) ORDER BY pos) AS l FROM y GROUP BY doc_id),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, l), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM bytes, tab),
d AS MATERIALIZED (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(crc, 0) AS crc, substr(md5(coalesce(text, chr(0) || 'null')), 1, 15) AS key FROM documents LEFT JOIN crc USING (doc_id)),
g AS MATERIALIZED (SELECT key, CAST(sum(size) AS BIGINT) AS size, CAST(sum(sum(size)) OVER (ORDER BY key) AS BIGINT) AS till FROM d GROUP BY key),
a AS MATERIALIZED (SELECT max(till) AS total, greatest(max(size), CAST(ceil(max(till) / 16) AS BIGINT)) - 1 AS low FROM g),
f AS (SELECT low AS lo, total AS hi, (low + total) // 2 AS mid, 0 AS shard, 0::BIGINT AS at, 0 AS done FROM a
 UNION ALL SELECT CASE WHEN last AND till < total THEN mid ELSE lo END, CASE WHEN last AND till >= total THEN mid ELSE hi END,
  CASE WHEN last THEN (CASE WHEN till < total THEN mid + hi ELSE lo + mid END) // 2 ELSE mid END, CASE WHEN last THEN 0 ELSE shard + 1 END, CASE WHEN last THEN 0 ELSE till END, 0
 FROM (SELECT *, (SELECT coalesce(max(till), 0) FROM g WHERE till <= f.at + f.mid) AS till, shard = 15 AS last FROM f, a WHERE hi - lo > 1)),
cap AS MATERIALIZED (SELECT min(hi) AS cap FROM f),
s AS (SELECT 0 AS shard, 0::BIGINT AS at, (SELECT coalesce(max(till), 0) FROM g, cap WHERE till <= cap) AS till
 UNION ALL SELECT shard + 1, till, (SELECT coalesce(max(g.till), 0) FROM g, cap WHERE g.till <= s.till + cap) FROM s WHERE shard < 15)
SELECT doc_id, d.size, crc AS text_crc32, 'bytes' AS law, s.shard, row_number() OVER (PARTITION BY s.shard ORDER BY doc_id % 256, doc_id, d.size, crc) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM d JOIN g USING (key) JOIN s ON g.till > s.at AND g.till <= s.till
"""

def _crc32(hexed: str) -> str:
    """Checksum of the bytes of a hex string, as an unsigned number; needs ``tab``."""
    listed = f"list_transform(range(length({hexed}) // 2), lambda i: CAST('0x' || substr({hexed}, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {listed}), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"


SPELLING = f"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT {_CRC_TABLE} AS tab),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM documents, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS u(run) GROUP BY ALL),
x AS (SELECT w, n, hex(encode(doc_id || ':' || w)) AS x FROM r),
h AS (SELECT w, n, {_crc32('x')} AS h FROM x, tab),
o AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS MATERIALIZED (SELECT word, n, u.i AS i, substr(word, 1, u.i) || substr(word, u.i + 2) AS less FROM v, unnest(range(length(word))) AS u(i)),
short AS (SELECT DISTINCT d.word AS a, d.n AS an, v.word AS b, v.n AS bn FROM d JOIN v ON d.less = v.word),
near AS MATERIALIZED (SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM d a JOIN d b ON a.i = b.i AND a.less = b.less AND a.word <> b.word UNION ALL SELECT * FROM short UNION ALL SELECT b, bn, a, an FROM short),
c AS (SELECT a AS word, count(*) AS n_near FROM near GROUP BY a),
f AS MATERIALIZED (SELECT a AS word, b AS form, bn AS form_n FROM near WHERE bn >= 10 * an QUALIFY row_number() OVER (PARTITION BY a ORDER BY bn DESC, b) = 1),
w AS (SELECT word, form AS root, 1 AS k FROM f UNION ALL SELECT w.word, f.form, k + 1 FROM w JOIN f ON w.root = f.word),
e AS (SELECT word, max_by(root, k) AS root FROM w GROUP BY word)
SELECT v.word, form, coalesce(root, v.word) AS root, v.n, coalesce(n_near, 0) AS n_near, form_n FROM v LEFT JOIN c USING (word) LEFT JOIN f USING (word) LEFT JOIN e USING (word)
"""

PREFIX_TRIE = rf"""
WITH tab AS MATERIALIZED (SELECT {_CRC_TABLE} AS tab),
t AS MATERIALIZED (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS e, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT c, hex(encode(CAST(c AS VARCHAR))) AS x, count(*) AS n FROM t GROUP BY c),
h AS MATERIALIZED (SELECT c, n, {_crc32('x')} % 4 AS h FROM b, tab),
k AS MATERIALIZED (SELECT h.c, h.h, least(h.h, coalesce(s.n, 0)) AS k FROM h LEFT JOIN h s ON s.c = h.c - h.c % 20),
r AS (SELECT k.c, pos AS d, e, words FROM k JOIN t ON t.c = k.c - k.c % 20 AND pos <= k UNION ALL SELECT k.c, k + pos - h, e, words FROM k JOIN t ON t.c = k.c AND pos > h),
p AS MATERIALIZED (SELECT c, d, words, string_agg(e, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM r UNION ALL SELECT c, 0, 0, '' FROM k),
l AS (SELECT c, max(d) AS d, max_by(path, d) AS path FROM p GROUP BY c),
e AS (SELECT path, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM l GROUP BY path),
n AS MATERIALIZED (SELECT d, path, min(c) AS c, count(*) AS n, any_value(words) AS words FROM p GROUP BY d, path),
q AS MATERIALIZED (SELECT n.*, m.c AS parent FROM n LEFT JOIN n m ON m.d = n.d - 1 AND starts_with(n.path, m.path)),
i AS (SELECT d - 1 AS d, parent AS c, count(*) AS children FROM q WHERE d > 0 GROUP BY ALL),
s AS (SELECT q.*, coalesce(children, 0) AS children FROM q LEFT JOIN i USING (d, c)),
u AS (SELECT a.d, a.c, count(*) FILTER (z.children = 0) AS leaves, CAST(sum((z.n - 1) * z.words) AS BIGINT) AS saved FROM s a JOIN s z ON z.d >= a.d AND starts_with(z.path, a.path) GROUP BY ALL)
SELECT c AS conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n AS n_convs, children AS n_children, leaves AS n_leaves, saved AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256 FROM s JOIN u USING (d, c) LEFT JOIN e USING (path)
"""


def url_filters(rules: tuple[tuple[str, str], ...], damping: float, factor: float, floor: float, rounds: int = 200) -> str:
    """Rules by their text; ranks by so many plain rounds. The pages' absolute links and the bonds of hosts are the edges."""
    listed = ", ".join(f"('{verdict}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for verdict, rule in rules)
    host = lambda url: f"translate(regexp_extract(CASE WHEN {url} LIKE '%://%' THEN substr({url}, instr({url}, '://') + 3) ELSE '' END, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE rules(verdict, rule, h, p) AS (VALUES {listed}),
u AS MATERIALIZED (SELECT page_id, html, {host("coalesce(url, '')")} AS host, regexp_extract(CASE WHEN coalesce(url, '') LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END, '^[^/?#]*([^?#]*)', 1) AS path FROM documents_pages),
fit AS (SELECT page_id, host, path, max_by(rule, (length(rule), rule)) AS rule, max_by(verdict, (length(rule), rule)) AS verdict FROM u JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY ALL),
j AS MATERIALIZED (SELECT u.*, rule, verdict FROM u LEFT JOIN fit USING (page_id)),
links AS (SELECT host AS src, {host("CASE WHEN starts_with(t, '//') THEN 'http:' || t ELSE t END")} AS dst, 1.0::DOUBLE AS w FROM (SELECT host, unnest(list_distinct(regexp_extract_all(html, '(?i)href\s*=\s*["'']?((?:https?:)?//[^"''\s>]+)', 1))) AS t FROM u)),
labels AS (SELECT host, string_split(host, '.') AS l FROM (SELECT DISTINCT host FROM u) WHERE regexp_matches(host, '^[^.]+(\.[^.]+)*\.[^.\d][^.]*$')),
bonds AS (SELECT host AS src, array_to_string(l[len(l) - i.n + 1:], '.') AS dst, 1.0 / (len(l) - 2) AS w FROM labels, unnest(range(2, len(l))) AS i(n)),
edges AS MATERIALIZED (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM links UNION ALL SELECT * FROM bonds UNION ALL SELECT dst, src, w FROM bonds) WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
shares AS MATERIALIZED (SELECT 'good' AS kind, src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM edges UNION ALL SELECT 'bad', dst, src, w / sum(w) OVER (PARTITION BY dst) FROM edges),
counts AS (SELECT host, count(*) FILTER (verdict = 'allow') AS good, count(*) FILTER (verdict = 'block') AS bad FROM j WHERE host <> '' GROUP BY host),
seeds AS MATERIALIZED (SELECT 'good' AS kind, host, good / (good + bad) AS seed FROM counts WHERE good > 0 UNION ALL SELECT 'bad', host, bad / (good + bad) FROM counts WHERE bad > 0),
walk AS (SELECT 0 AS n, kind, host, CAST(seed AS DOUBLE) AS rank FROM seeds
 UNION ALL SELECT n, kind, host, sum(rank) FROM (SELECT n + 1 AS n, walk.kind, dst AS host, rank * share * {damping} AS rank FROM walk JOIN shares ON shares.kind = walk.kind AND src = host
  UNION ALL SELECT (SELECT min(n) + 1 FROM walk), kind, host, seed * {1 - damping} FROM seeds) WHERE n <= {rounds} GROUP BY ALL),
judged AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'good'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'bad'), 0) AS distrust FROM walk WHERE n = {rounds} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN distrust > {factor} * trust AND distrust > {floor} THEN 'block' END, 'allow') AS verdict FROM j LEFT JOIN judged USING (host)
""".replace("documents_pages", "pages")
