"""SQL twins (DuckDB) of the queries that SQL can express: op6, op7 and op9 to op13."""

from __future__ import annotations

from . import contamination, rules, vector_codes

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CHARS = " || ".join(f"substr('{_BASE32}', 1 + (v >> {s}) % 32, 1)" for s in (15, 10, 5, 0))

OP6 = rf"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, octet_length(encode(html)) AS n, sha1(html) AS hex FROM p),
f AS (SELECT hex, min(page_id) AS first, count(*) AS c FROM d GROUP BY hex),
h AS (SELECT DISTINCT hex FROM d),
b AS (SELECT hex, string_agg({_CHARS}, '' ORDER BY i) AS digest FROM (SELECT hex, i, ('0x' || substr(hex, (5 * i + 1)::BIGINT, 5))::BIGINT AS v FROM h, unnest(range(0, 8)) r(i)) GROUP BY hex)
SELECT d.page_id, d.n AS payload_bytes, b.digest AS payload_digest, CASE WHEN f.c > 1 AND d.page_id IS DISTINCT FROM f.first AND f.first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN f.c > 1 AND d.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to, d.url
FROM d JOIN f USING (hex) JOIN b USING (hex)
"""

OP7 = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
t AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, g FROM t GROUP BY ALL HAVING count(*) > 1),
k AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM t JOIN r USING (doc_id, g), unnest([0, 1, 2]) u(o) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT w.doc_id, w.source, len(w.w) AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_replace(text, '[^{rules.SYMBOLS}]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(k.n, 0) AS n_repeat_words FROM w LEFT JOIN k USING (doc_id) LEFT JOIN l USING (doc_id)),
j AS MATERIALIZED (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT} * n_words AS base_failed FROM c),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM j GROUP BY source),
o AS (SELECT sum(f) / sum(n) AS mean, sum(n * (f / n) * (f / n)) / sum(n) AS q, count(*) / sum(n) AS s FROM h),
b AS (SELECT mean, q - mean * mean - mean * (1 - mean) * s AS between_ FROM o),
p AS (SELECT mean, CASE WHEN between_ > 1e-12 AND mean > 0 AND mean < 1 THEN least(greatest(mean * (1 - mean) / between_ - 1, 1.0), {rules.HEAVIEST}) ELSE {rules.HEAVIEST} END AS weight FROM b),
t9 AS (SELECT least({rules.HIGHEST}, greatest({rules.FACTOR} * mean, mean + {rules.TAIL} * sqrt(mean * (1 - mean) / (weight + 1)))) AS most FROM p),
v AS (SELECT source, (f + mean * weight) / (n + weight) AS rate, (f + mean * weight) / (n + weight) <= most AS ok FROM h, p, t9)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(v.rate, 6) AS host_rate, v.ok AS host_ok, NOT base_failed AND v.ok AS kept
FROM j JOIN v ON v.source IS NOT DISTINCT FROM j.source
"""


def _picked(array: str, mask: str) -> str:
    return " || ' ' || ".join(f"{array}[i + {k}]" for k, bit in enumerate(mask) if bit == "1")


def _seeds(table: str, key: str, array: str) -> str:
    masks = contamination.MASKS
    each = (f"SELECT {key}, i, {m} AS m, {_picked(array, mask)} AS seed FROM (SELECT {key}, {array}, unnest(range(1, len({array}) - {len(mask) - 2})) AS i FROM {table})" for m, mask in enumerate(masks))
    return " UNION ALL ".join(each)


_C = contamination
#: (items of fewer than SPAN tokens, of which the benchmark has none, are left out)
OP9 = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS a FROM documents),
b AS MATERIALIZED (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS c FROM benchmark),
x AS ({_seeds('d', 'doc_id', 'a')}),
y AS ({_seeds('b', 'item_id', 'c')}),
h AS (SELECT DISTINCT x.doc_id, y.item_id, x.i - y.i AS shift FROM x JOIN y ON x.m = y.m AND x.seed = y.seed),
s AS (SELECT h.doc_id, h.item_id, greatest(0, -shift) AS low, least(len(c), len(a) - shift) AS high, least({_C.LEAST}, len(c)) AS need, list_transform(range(greatest(0, -shift), least(len(c), len(a) - shift)), lambda k: (c[k + 1] = a[k + 1 + shift])::INT) AS e FROM h JOIN d USING (doc_id) JOIN b USING (item_id)),
f AS (SELECT DISTINCT doc_id, item_id FROM s WHERE high - low >= need AND (list_sum(e) >= {_C.SHARE} * (high - low) OR list_max(list_transform(range(1, high - low - need + 2), lambda w: list_sum(e[w:w + need - 1]))) >= {_C.SHARE} * need)),
n AS (SELECT doc_id, count(*) AS k, string_agg(item_id, ',' ORDER BY item_id) AS item_ids FROM f GROUP BY doc_id)
SELECT d.doc_id, n.item_ids IS NOT NULL AS contaminated, coalesce(n.k, 0) AS n_items, coalesce(n.item_ids, '') AS item_ids FROM d LEFT JOIN n USING (doc_id)
"""

OP10 = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0))),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
m AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id, w.doc_id <= coalesce(m.low, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = w.doc_id
"""

_V = vector_codes


def _rounds(n: int) -> str:
    """CTEs e0 .. en: (p, e, v) entries of the codebooks after each round, by all distances."""
    out = [f"e0 AS (SELECT p, e, part AS v FROM (SELECT *, dense_rank() OVER (ORDER BY vec_id) - 1 AS e FROM x) WHERE e < {_V.ENTRIES})"]
    for k in range(n):
        out.append(f"a{k} AS MATERIALIZED ({_nearest(k)})")
        out.append(f"m{k} AS (SELECT p, e, i, floor(sum(part[i]) / count(*))::BIGINT AS c FROM (SELECT *, unnest(range(1, len(part) + 1)) AS i FROM a{k}) GROUP BY ALL)")
        out.append(f"e{k + 1} AS MATERIALIZED (SELECT o.p, o.e, coalesce(any_value(n.v), any_value(o.v)) AS v FROM e{k} o LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS v FROM m{k} GROUP BY ALL) n ON n.p = o.p AND n.e = o.e GROUP BY ALL)")
    return ",\n".join(out)


def _nearest(k: int) -> str:
    return f"SELECT vec_id, label, p, part, b.e AS e, b.d AS d FROM (SELECT vec_id, label, x.p, part, min({{'d': list_sum(list_transform(range(1, len(part) + 1), lambda i: (part[i] - v[i]) * (part[i] - v[i]))), 'e': e}}) AS b FROM x JOIN e{k} USING (p) GROUP BY ALL)"


OP11 = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * {_V.SCALE})::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // {_V.PARTS}) + 1 : (p + 1) * (len(v) // {_V.PARTS})] AS part FROM (SELECT *, unnest(range(0, {_V.PARTS})) AS p FROM k)),
{_rounds(_V.ROUNDS)},
f AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM ({_nearest(_V.ROUNDS)}) GROUP BY vec_id),
s AS (SELECT label, sum(error)::BIGINT AS label_error FROM f GROUP BY label),
b AS (SELECT sha256(string_agg(v[i]::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM e{_V.ROUNDS}))
SELECT f.vec_id, f.code, f.error, s.label_error, b.codebooks_sha256 FROM f JOIN s ON s.label IS NOT DISTINCT FROM f.label, b
"""

#: (backslashes and control strings count one more character; a run of turns of one role has one header)
_ESCAPES = "(" + " + ".join(f"(length({{0}}) - length(replace({{0}}, '{s}', ''))) // {len(s)}" for s in ("\\", "[INST]", "[/INST]", "<s>", "</s>")) + ")"
OP12 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(0, 2) r(t))),
r AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS goes_on FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(length(text) + {_ESCAPES.format('text')} + 7 + CASE WHEN goes_on THEN 0 ELSE 13 + length(role) + {_ESCAPES.format('role')} END)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""

OP13 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT doc_id, text, u, len(u) AS n, list_transform(range(0, 4), lambda i: ('0x' || substr(h, (8 * i + 1)::BIGINT, 8))::BIGINT) AS h FROM t),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, n, form, text, array_to_string(u[1:low], '') AS a, array_to_string(u[low + 1:high], '') AS m, array_to_string(u[high + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

ORACLES = {"op6_warc": OP6, "op7_quality_rules": OP7, "op9_decontamination": OP9, "op10_near_duplicates": OP10, "op11_vector_codes": OP11, "op12_chat_format": OP12, "op13_infill": OP13}
