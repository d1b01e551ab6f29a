"""DuckDB SQL over the test tables for the operators that SQL can express, written from the contracts and the README's
definitions, not from the operators' code. The classifiers and searches that sample hold for tables within their bounds.
"""

from __future__ import annotations


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))"
    fold = "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), {fold}), 4294967295)"


def remainder(mod: int) -> str:
    return f"coalesce({crc32('CAST(doc_id AS VARCHAR)')} % {mod}, -1)"


# -- op1: rank-order profiles of 400 n-grams

LANGUAGE = f"""
WITH d AS (SELECT row_number() OVER () r, doc_id, text, lang, {remainder(4)} = 2 held_out FROM documents),
c AS (SELECT r, generate_subscripts(s, 1) i, unnest(s) c FROM (SELECT r, string_split(regexp_replace(' ' || lower(text) || ' ', '[^\\p{{L}}]+', ' ', 'g'), '') s FROM d WHERE text IS NOT NULL)),
p AS (SELECT r, i, CASE c WHEN ' ' THEN 0 ELSE unicode(c) END::BIGINT a FROM c),
t AS (SELECT r, a, lead(a) OVER w b, lead(a, 2) OVER w e FROM p WINDOW w AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, a AS code FROM t WHERE a <> 0 UNION ALL SELECT r, ((a + 1) << 21) | b FROM t WHERE a + b > 0 UNION ALL SELECT r, ((a + 1) << 42) | (b << 21) | e FROM t WHERE b <> 0 AND e IS NOT NULL),
n AS (SELECT r, code, count(*) n FROM g GROUP BY ALL),
own AS (SELECT r, code, row_number() OVER (PARTITION BY r ORDER BY n DESC, code) - 1 place FROM n QUALIFY place < 400),
prof AS (SELECT lang, code, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, code) - 1 place FROM n JOIN d USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, code QUALIFY place < 400),
away AS (SELECT own.r, l.lang, sum(coalesce(abs(prof.place - own.place), 400)) away, count(*) n FROM own CROSS JOIN (SELECT DISTINCT lang FROM prof) l LEFT JOIN prof ON prof.lang = l.lang AND prof.code = own.code GROUP BY ALL),
best AS (SELECT r, lang, 1 - CAST(away AS DOUBLE) / (400 * n) score FROM away QUALIFY row_number() OVER (PARTITION BY r ORDER BY away, lang) = 1)
SELECT doc_id, held_out, coalesce(best.lang, 'und') lang_pred, coalesce(score, 0.0::DOUBLE) score FROM d LEFT JOIN best USING (r)
"""

# -- op2: the 20 largest integer inner products

TOP_K = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""

# -- op3, base kinds

_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_TERM = f"list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) WHEN CAST(c AS INT) > 4 THEN 2 * CAST(c AS INT) - 9 ELSE 2 * CAST(c AS INT) END)"
_HOLDS = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(x, '.'), lambda q: len(ltrim(q, '0')) < 4 AND coalesce(TRY_CAST(ltrim(q, '0') AS INT), 0) <= 255))",
    "card": f"len({_DIGITS}) BETWEEN 16 AND 19 AND list_sum({_TERM}) % 10 = 0",
    "phone": f"len({_DIGITS}) BETWEEN 8 AND 15",
}


def _base_kind(kind: str) -> str:
    return f"""SELECT r, '{kind}' kind, {list(_BASE).index(kind)} k, stop - len(x) start, stop FROM (
      SELECT r, x, sum(len(g) + len(x)) OVER (PARTITION BY r ORDER BY i) stop FROM (
        SELECT r, generate_subscripts(m, 1) i, unnest(m) x, unnest(list_slice(g, 1, len(m))) g FROM (SELECT r, regexp_extract_all(t, '{_BASE[kind]}') m, string_split_regex(t, '{_BASE[kind]}') g FROM d) WHERE len(m) > 0)) WHERE {_HOLDS[kind]}"""


PII_BASE = f"""
WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') t FROM documents), s AS ({" UNION ALL ".join(map(_base_kind, _BASE))}),
a AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') n_{k}" for k in _BASE)}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY k, start) spans FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) n_{k}" for k in _BASE)}, sha256(coalesce(spans, '')) base_sha256 FROM d LEFT JOIN a USING (r)
"""

# -- op7: what a round trip gives back

_SHA1_BASE32 = "list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(sha1(h), 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), 'string_agg', '')"
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') h FROM pages), k AS (SELECT *, max(page_id) OVER (PARTITION BY h) top, count(*) OVER (PARTITION BY h) n FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) payload_bytes, {_SHA1_BASE32} payload_digest, CASE WHEN n = 1 OR top IS NULL OR top IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END record_type,
CASE WHEN n > 1 AND top IS DISTINCT FROM page_id THEN top END refers_to FROM k
"""

# -- op8: all pairs of different texts by their common shingles of five words, and the classes of the links

JACCARD = """
WITH RECURSIVE d AS (SELECT row_number() OVER () r, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '') w FROM documents),
t AS (SELECT w, min(r) tid, count(*) size, min(doc_id) low FROM d WHERE len(w) > 0 GROUP BY w),
s AS (SELECT DISTINCT tid, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) g FROM t),
z AS (SELECT tid, count(*) n FROM s GROUP BY tid),
l AS (SELECT a.tid u, b.tid v FROM s a JOIN s b ON a.g = b.g AND a.tid <> b.tid JOIN z x ON x.tid = a.tid JOIN z y ON y.tid = b.tid GROUP BY a.tid, b.tid, x.n, y.n HAVING count(*) / (x.n + y.n - count(*)) >= 0.8),
reach(u, v) AS (SELECT tid, tid FROM t UNION SELECT reach.u, l.v FROM reach JOIN l ON reach.v = l.u),
c AS (SELECT u, min(low) class_id FROM reach JOIN t ON t.tid = v GROUP BY u),
n AS (SELECT u, sum(size) n FROM l JOIN t ON t.tid = v GROUP BY u)
SELECT doc_id, coalesce(class_id, doc_id) class_id, CAST(coalesce(t.size - 1 + coalesce(n.n, 0), 0) AS BIGINT) n_links FROM d LEFT JOIN t ON t.w = d.w LEFT JOIN c ON c.u = t.tid LEFT JOIN n ON n.u = t.tid
"""

# -- op10: trigram Katz; K = 5

_K = 5


def _discounts(name: str, counts: str) -> str:
    """``name`` (r, d): discounts of counts 1..5 from the n-gram counts in ``counts`` (c)."""
    n = lambda r: f"(SELECT count(*) FROM {counts} WHERE c = {r})::DOUBLE"
    return f"""{name}_n AS (SELECT r, (SELECT count(*) FROM {counts} WHERE c = r)::DOUBLE n FROM range(1, {_K + 2}) x(r)),
{name}_raw AS (SELECT a.r, ((a.r + 1) * b.n / (a.r * a.n) - k) / (1 - k) d FROM {name}_n a JOIN {name}_n b ON b.r = a.r + 1, (SELECT {_K + 1} * {n(_K + 1)} / nullif({n(1)}, 0) k)),
{name}_ok AS (SELECT (SELECT min(n) > 0 FROM {name}_n) AND {n(1)} > {_K + 1} * {n(_K + 1)} AND coalesce((SELECT min(d) > 0 AND max(d) < 1 FROM {name}_raw), false) ok),
{name}_z AS (SELECT ln(r) x, ln(2 * n / (coalesce(lead(r) OVER w, 2 * r - coalesce(lag(r) OVER w, 0)) - coalesce(lag(r) OVER w, 0))) y FROM {name}_n WHERE n > 0 WINDOW w AS (ORDER BY r)),
{name}_e AS (SELECT CASE WHEN count(*) > 1 THEN regr_slope(y, x) + 1 END e FROM {name}_z),
{name} AS (SELECT {name}_n.r, CASE WHEN ok THEN d WHEN e <= -1e-6 THEN (pow(1 + 1.0 / {name}_n.r, e) - pow({_K + 1}, e)) / (1 - pow({_K + 1}, e))
  WHEN {name}_n.r = 1 AND n > 0 THEN 1 - least(0.9, greatest(0.1, n / (n + 2 * {n(2)}))) ELSE 1 END d FROM {name}_n LEFT JOIN {name}_raw ON {name}_raw.r = {name}_n.r, {name}_ok, {name}_e WHERE {name}_n.r <= {_K})"""


def _order(n: int, history: str) -> str:
    """s{n}: per n-gram seen in training, its probability; b{n}: per history, the weight of the shorter one."""
    h = history.split(", ")
    short = {2: "s1", 3: "s2"}[n]
    on = " AND ".join([f"g{n}.w = {short}.w", *(f"g{n}.{x} = {short}.{x}" for x in h[1:])])
    return f"""h{n} AS (SELECT {history}, sum(c) total FROM g{n} GROUP BY ALL),
x{n} AS (SELECT {history}, w, c, total, coalesce(d, 1) * c / total share FROM g{n} JOIN h{n} USING ({history}) LEFT JOIN d{n} ON d{n}.r = c),
f{n} AS (SELECT {history}, total, bool_and(share * total = c) none, sum(share) seen FROM x{n} GROUP BY ALL),
s{n} AS (SELECT {history}, w, share * CASE WHEN none THEN total / (total + 1) ELSE 1 END p FROM x{n} JOIN f{n} USING ({history}, total)),
b{n} AS (SELECT {history}, CASE WHEN none THEN 1 / (total + 1) ELSE 1 - seen END / (1 - mass) b FROM f{n} JOIN (SELECT {", ".join(f"g{n}.{x}" for x in h)}, sum({short}.p) mass FROM g{n} JOIN {short} ON {on} GROUP BY ALL) USING ({history}))"""


KATZ = f"""
WITH d AS (SELECT row_number() OVER () r, doc_id, {remainder(10)} = 0 held_out, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') w FROM documents),
k AS (SELECT r, held_out, unnest(list_concat(w, [''])) w, unnest(range(len(w) + 1)) i FROM d),
t AS (SELECT r, held_out, w, coalesce(lag(w) OVER o, chr(1) || ' ') v, coalesce(lag(w, 2) OVER o, chr(1) || ' ') u FROM k WINDOW o AS (PARTITION BY r ORDER BY i)),
g1 AS (SELECT w, count(*) c FROM t WHERE NOT held_out GROUP BY ALL), g2 AS (SELECT v, w, count(*) c FROM t WHERE NOT held_out GROUP BY ALL), g3 AS (SELECT u, v, w, count(*) c FROM t WHERE NOT held_out GROUP BY ALL),
size AS (SELECT sum(c)::DOUBLE n, count(*) v FROM g1), {_discounts("d1", "g1")}, {_discounts("d2", "g2")}, {_discounts("d3", "g3")},
s1 AS (SELECT w, coalesce(d, 1) * c / n p, c FROM g1 CROSS JOIN size LEFT JOIN d1 ON d1.r = c),
u1 AS (SELECT sum((1 - coalesce(d, 1)) * c) / any_value(n) p FROM g1 CROSS JOIN size LEFT JOIN d1 ON d1.r = c),
{_order(2, "v")}, {_order(3, "u, v")},
p AS (SELECT t.r, s1.c, log10((coalesce(s1.c, 0) + 0.1) / (n + 0.1 * (size.v + 1))) base, log10(coalesce(s3.p, coalesce(b3.b, 1) * coalesce(s2.p, coalesce(b2.b, 1) * coalesce(s1.p, u1.p)))) score
  FROM t CROSS JOIN size CROSS JOIN u1 LEFT JOIN s1 USING (w) LEFT JOIN s2 ON s2.v = t.v AND s2.w = t.w LEFT JOIN b2 ON b2.v = t.v LEFT JOIN s3 ON s3.u = t.u AND s3.v = t.v AND s3.w = t.w LEFT JOIN b3 ON b3.u = t.u AND b3.v = t.v)
SELECT doc_id, any_value(held_out) held_out, count(*) n_tokens, count(c) n_known, (SELECT CAST(n AS BIGINT) FROM size) train_tokens, round(sum(base), 4) base_score, round(sum(score), 4) score FROM d JOIN p USING (r) GROUP BY r, doc_id
"""

ORACLES: dict[str, str] = {"op1_language": LANGUAGE, "op2_topk": TOP_K, "base_of_op3": PII_BASE, "op7_warc": WARC, "op8_jaccard": JACCARD, "rounded_op10": KATZ}
