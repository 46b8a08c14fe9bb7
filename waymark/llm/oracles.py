"""The DuckDB SQL of the queries of this package that SQL can express."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = (
    r"coalesce(regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
)

TOPK = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
placed AS (
  SELECT *, md5(concat('20240229', ':', coalesce(doc_id::VARCHAR, ''), ':', size)) AS place FROM d),
sums AS (
  SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS r
  FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((r - 1) % 3 + 1)::INT] AS w, (3 * s)::DOUBLE AS cap FROM sums),
levels AS (
  SELECT *, ((SELECT sum(s) FROM sums)::DOUBLE - (sum(cap) OVER o - cap))
            / ((SELECT sum(w) FROM w) - (sum(w) OVER o - w)) AS level,
         row_number() OVER o AS k
  FROM w WINDOW o AS (ORDER BY cap / w, r ROWS UNBOUNDED PRECEDING)),
water AS (SELECT level FROM levels WHERE cap >= w * level ORDER BY k LIMIT 1),
t AS (
  SELECT source, s, least(cap, w.w * level) AS target FROM w, water),
plan AS (
  SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END::BIGINT AS whole FROM t),
before AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM placed)
SELECT doc_id, size, s AS source_size, target,
       (whole * size + greatest(least(size, floor(target)::BIGINT - whole * s - before), 0))::BIGINT AS taken
FROM before b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_BENCH_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_BENCH_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
items AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT item_id, n,
         unnest([array_to_string(w[i : i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS g
  FROM items),
places AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos, w
  FROM d, (SELECT DISTINCT n FROM grams) x WHERE len(w) >= n),
hits AS (
  SELECT p.doc_id, p.n, p.pos, g.item_id FROM places p JOIN grams g
  ON g.n = p.n AND g.g = array_to_string(p.w[p.pos : p.pos + p.n - 1], ' ')),
met AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (
    SELECT doc_id, unnest(range(pos, pos + n)) AS spot FROM hits) x GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (
    SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) x GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN met USING (doc_id) LEFT JOIN named USING (doc_id)"""

#: crc32 of a text of ASCII characters: after each byte, eight steps of the reversed polynomial.
_CRC32 = """xor(4294967295::BIGINT, list_reduce(
  list_prepend(4294967295::BIGINT, flatten([
    [ascii(s)::BIGINT, 256, 256, 256, 256, 256, 256, 256, 256] FOR s IN string_split({0}, '')])),
  LAMBDA c, x: CASE WHEN x < 256 THEN xor(c, x) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END))"""

TRIE = f"""
WITH t AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, ({_CRC32.format("conv_id::VARCHAR")} % 9)::INT AS h FROM t),
r AS (
  SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h + 1:]) AS path
  FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 5),
m AS (SELECT conv_id, d, path[1:d] AS key, d = len(path) AS ends FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM r)),
n AS (
  SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM m GROUP BY d, key),
c AS (SELECT key[1:d - 1] AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
k AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
         CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(key[d].text)) END AS saved
  FROM n LEFT JOIN c USING (key)),
s AS (
  SELECT key[1:above] AS key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS above FROM k) GROUP BY 1)
SELECT k.conv_id, k.d::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children::BIGINT AS n_children,
       n_leaves, saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM k JOIN s ON s.key = k.key LEFT JOIN n p ON k.d > 0 AND p.key = k.key[1:k.d - 1]"""


def _spans(kind: int, pattern: str, column: str = "text") -> str:
    """A list of (start, kind, value) for the matches of a pattern in (id, text): each
    begins where the pieces of text and the matches before it end."""
    p = pattern.replace("'", "''")
    return f"""
  SELECT id, {kind} AS no, m[i] AS value,
         list_sum([len(x) FOR x IN g[1:i]]) + coalesce(list_sum([len(x) FOR x IN m[1:i - 1]]), 0) AS start
  FROM (SELECT id, m, g, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT id, regexp_extract_all({column}, '{p}', 0) AS m, string_split_regex({column}, '{p}') AS g FROM d))"""


def _secrets() -> str:
    from . import secrets as s  # the patterns and limits; the method is another one

    quote = lambda x: "'" + x.replace("'", "''") + "'"
    any_of = " OR ".join(f"regexp_matches(value, {quote(p)})" for p in [s.ACCESS, s.HEX, *s.ALLOWED])
    limits = "CASE " + " ".join(
        f"WHEN regexp_matches(value, {quote(p)}) THEN {s.limit(w, b)}" for p, _, w, b in s.CLASSES
    ) + " END"
    (width,) = {c[2] for c in s.CLASSES}
    sums = "[0, " + ", ".join(str(s.n_log_n(n)) for n in range(1, width + 1)) + "]"
    return f"""
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS id FROM documents),
d0 AS (SELECT id, text FROM rows),
assigned AS (WITH d AS (SELECT * FROM d0) {_spans(0, s.ASSIGN)}),
base AS (
  SELECT * FROM assigned WHERE len(regexp_extract(value, {quote(s.ASSIGN)}, 1)) >= {s.LEAST_VALUE}
  UNION ALL (WITH d AS (SELECT * FROM d0) {_spans(1, s.ACCESS)})
  UNION ALL (WITH d AS (SELECT * FROM d0) {_spans(2, s.HEX)})),
cuts AS (SELECT id, list(start ORDER BY start) AS a, list(start + len(value) ORDER BY start) AS b FROM base WHERE no = 0 GROUP BY id),
masked AS (
  SELECT d0.id, CASE WHEN a IS NULL THEN text ELSE
    concat(list_aggregate([concat(substr(text, (CASE WHEN i = 1 THEN 0 ELSE b[i - 1] END + 1)::BIGINT,
        (a[i] - CASE WHEN i = 1 THEN 0 ELSE b[i - 1] END)::BIGINT), repeat(' ', (b[i] - a[i])::BIGINT)) FOR i IN range(1, len(a) + 1)], 'string_agg', ''),
      substr(text, (b[-1] + 1)::BIGINT)) END AS text
  FROM d0 LEFT JOIN cuts ON cuts.id = d0.id),
candidates AS (
  SELECT *, {limits} AS most FROM (WITH d AS (SELECT * FROM masked) {_spans(3, s.CANDIDATE)})
  WHERE NOT ({any_of})),
windows AS (
  SELECT id, start, value, most, w, substr(value, w, {width}) AS part
  FROM (SELECT *, unnest(range(1, len(value) - {width} + 2)) AS w FROM candidates WHERE most >= 0)),
counts AS (
  SELECT id, start, value, most, w, sign, count(*) AS n
  FROM (SELECT *, unnest(string_split(part, '')) AS sign FROM windows) GROUP BY ALL),
even AS (
  SELECT DISTINCT id, start, value FROM (
    SELECT id, start, value, most, w, sum({sums}[n + 1]) AS total FROM counts GROUP BY ALL) WHERE total <= most),
spans AS (
  SELECT id, no, start, concat_ws(':', ['assign', 'access', 'hex'][no + 1], start::BIGINT, (start + len(value))::BIGINT) AS w FROM base
  UNION ALL SELECT id, 3, start, concat_ws(':', 'entropy', start::BIGINT, (start + len(value))::BIGINT) FROM even),
sums AS (
  SELECT id, count(*) FILTER (WHERE no = 0) AS n_assign, count(*) FILTER (WHERE no = 1) AS n_access,
         count(*) FILTER (WHERE no = 2) AS n_hex, string_agg(w, ',' ORDER BY start, no) FILTER (WHERE no < 3) AS base,
         string_agg(w, ',' ORDER BY start, no) AS spans
  FROM spans GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM rows LEFT JOIN sums USING (id)"""


ORACLES = {
    "op2_topk": TOPK,
    "op3_mixing": MIXING,
    "op5_decontaminate": DECONTAMINATE,
    "op11_secrets": _secrets(),
    "op13_prefix_trie": TRIE,
}
