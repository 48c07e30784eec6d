"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP7 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(source, '') AS site, md5(text) AS whole FROM documents),
firsts AS (SELECT whole, min(site) AS site FROM docs GROUP BY whole),
lines AS (SELECT DISTINCT whole, trim(unnest(string_split(text, chr(10)))) AS line FROM docs),
spread AS (SELECT line FROM lines JOIN firsts USING (whole) WHERE line <> '' GROUP BY 1 HAVING count(DISTINCT site) >= 5),
numbered AS (SELECT r, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM docs),
marked AS (SELECT n.r, n.i, n.line, s.line IS NOT NULL AS found FROM numbered n LEFT JOIN spread s ON trim(n.line) = s.line),
totals AS (SELECT r, count(*) AS n_lines, sum(CASE WHEN found THEN 1 ELSE 0 END) AS n_found, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT found), '') AS kept FROM marked GROUP BY r)
SELECT d.doc_id, CASE WHEN n_found > 0 THEN kept ELSE d.text END AS text, CASE WHEN d.text IS NULL THEN 0 ELSE n_lines END::BIGINT AS n_lines, n_found::BIGINT AS n_removed
FROM docs d JOIN totals t USING (r)
"""

OP6 = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingled AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
sets AS (SELECT r, doc_id, len(s) AS n, list_sort(s) AS s FROM shingled),
classes AS (SELECT s, any_value(n) AS n, min(doc_id) AS node FROM sets WHERE n > 0 GROUP BY s),
members AS (SELECT node, n, unnest(s) AS x FROM classes),
common AS (SELECT a.node AS a, b.node AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM members a JOIN members b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM common WHERE 100 * k >= 80 * (na + nb - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node AS a, node AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
labels AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)
SELECT d.doc_id, d.n::BIGINT AS n_shingles, coalesce(l.component, d.doc_id) AS component_id, d.doc_id = coalesce(l.component, d.doc_id) AS kept
FROM sets d LEFT JOIN classes c ON d.s = c.s AND d.n > 0 LEFT JOIN labels l ON c.node = l.node
"""

OP2 = r"""
WITH words AS (SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 'i', item_id, row_number() OVER (), text FROM benchmark),
split AS (SELECT kind, id, r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM words),
shingled AS (SELECT kind, id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM split),
sets AS (SELECT kind, id, r, len(s) AS n, unnest(s) AS x FROM shingled),
short AS (SELECT id, r, ' ' || array_to_string(w, ' ') || ' ' AS x FROM split WHERE kind = 'i' AND len(w) BETWEEN 1 AND 4)
SELECT d.id AS doc_id, i.id AS item_id, 1::BIGINT AS n_shingles, 1::BIGINT AS n_shared FROM short i JOIN split d ON d.kind = 'd' AND contains(' ' || array_to_string(d.w, ' ') || ' ', i.x)
UNION ALL SELECT d.id AS doc_id, i.id AS item_id, any_value(i.n)::BIGINT AS n_shingles, count(*)::BIGINT AS n_shared
FROM sets d JOIN sets i ON d.kind = 'd' AND i.kind = 'i' AND d.x = i.x AND i.r NOT IN (SELECT r FROM short) GROUP BY d.r, i.r, d.id, i.id HAVING 100 * count(*) >= 80 * any_value(i.n)
"""

OP10 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM docs),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
dups AS (SELECT r, sum(k - 1) AS n FROM (SELECT r, line, count(*) AS k FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2) GROUP BY r),
windows AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM split)),
twice AS (SELECT r, i FROM windows SEMI JOIN (SELECT r, x FROM windows GROUP BY 1, 2 HAVING count(*) > 1) USING (r, x)),
repeats AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS p FROM twice, range(5) t(k)) GROUP BY r),
counts AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(w, lambda x: x LIKE '%!!')) AS shouts, len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS unlettered,
  length(regexp_replace(text, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(text, '[^{}]', '', 'g')) AS braces,
  coalesce(list_sum(list_transform(list_filter(w, lambda x: length(x) > 100), lambda x: length(x))), 0) AS long_word_chars, len(list_distinct(w)) AS n_distinct,
  coalesce(l.n, 0) AS n_lines, coalesce(l.ellipses, 0) AS ellipses, coalesce(l.bullets, 0) AS bullets
  FROM split LEFT JOIN dups d USING (r) LEFT JOIN repeats p USING (r)
  LEFT JOIN (SELECT r, count(*) AS n, count(*) FILTER (WHERE line LIKE '%...') AS ellipses, count(*) FILTER (WHERE line LIKE '- %' OR line LIKE '* %') AS bullets FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r) l USING (r)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars > 20 * n_words OR 2 * word_chars < 3 * n_words OR 2 * n_dup_lines > n_lines OR 2 * digits > word_chars OR 2 * capitals > word_chars
  OR 5 * braces > n_words OR 10 * shouts > 3 * n_words OR 2 * unlettered > n_words OR 10 * ellipses > 3 * n_lines OR 10 * bullets > 9 * n_lines OR 2 * long_word_chars > word_chars OR n_distinct < 6) AS kept FROM based
"""

_SECRETS = (  # kind, expression, what keeps a match
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["\']?\x20*[:=]\x20*["\']?[A-Za-z0-9+/_.=-]+""", r"""length(regexp_extract(m, '^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?(.*)$', 1)) >= 6"""),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", "[0-9a-f]{24,}", "true"),
    ("github", "gh[pousr]_[A-Za-z0-9]+", "length(m) >= 40"),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", "length(m) >= 15"),
    ("google", "AIza[A-Za-z0-9_-]+", "length(m) >= 39"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "length(m) >= 40"),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
)


def _secret_spans(k: int, kind: str, expression: str, kept: str) -> str:
    """Spans of one kind: pieces between matches and the matches themselves tell where each match begins."""
    e = expression.replace("'", "''").replace("\\''", "''")
    return f"""SELECT r, {k} AS k, '{kind}' AS kind, b, b + length(m) AS e FROM (SELECT r, ms[j] AS m, list_sum(list_transform(ps[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:j - 1], lambda x: length(x))), 0) AS b
 FROM (SELECT r, string_split_regex(t, '{e}') AS ps, regexp_extract_all(t, '{e}') AS ms, unnest(range(1, len(regexp_extract_all(t, '{e}')) + 1)) AS j FROM docs)) WHERE {kept}"""


OP9 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_secret_spans(k, *rule) for k, rule in enumerate(_SECRETS))}),
joined AS (SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  string_agg(kind || ':' || b::BIGINT || ':' || e::BIGINT, ',' ORDER BY b, k) FILTER (WHERE k < 3) AS base, string_agg(kind || ':' || b::BIGINT || ':' || e::BIGINT, ',' ORDER BY b, k) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN joined USING (r)
"""

#: CRC-32 takes half a byte at a time, the lower half first, with the 16 remainders of its polynomial.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(h)), lambda i: ('0x' || h[i + 2 - 2 * (i % 2)])::BIGINT)),
 lambda c, x: xor(c >> 4, rest[(xor(c, x) & 15) + 1])), 4294967295::BIGINT)"""
OP1 = f"""
WITH poly AS (SELECT list(list_reduce(list_prepend(n::BIGINT, [0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS rest FROM range(16) r(n)),
docs AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS g, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS tie,
  list_filter(string_split(hex(encode(coalesce(text, ''))), ''), lambda x: x <> '') AS h FROM documents),
coded AS (SELECT doc_id, size, g, tie, {_CRC} AS text_crc32 FROM docs, poly),
whole AS (SELECT count(*) AS n, sum(size)::BIGINT AS total FROM coded),
grouped AS (SELECT *, count(*) OVER (PARTITION BY g) AS copies FROM coded, whole),
celled AS (SELECT *, g >> 48 AS bucket, CASE WHEN copies > greatest(2 * n / 4096.0, 64) THEN g END AS large, CASE WHEN copies > greatest(2 * n / 4096.0, 64) THEN tie % ceil(copies * 4096 / n)::BIGINT END AS part FROM grouped),
placed AS (SELECT *, sum(size) OVER w - size AS begins, row_number() OVER w - 1 AS pos FROM celled WINDOW w AS (ORDER BY bucket, large NULLS FIRST, part NULLS FIRST, g, tie, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
runs AS (SELECT *, sum(size) OVER (PARTITION BY g) AS run, min(begins) OVER (PARTITION BY g) AS run_begins FROM placed),
middles AS (SELECT *, CASE WHEN run <= 0.01 * total / 40 THEN 2 * run_begins + run ELSE 2 * begins + size END AS middle FROM runs),
sharded AS (SELECT *, least(39, (middle * 40) // (2 * total))::INT AS shard FROM middles)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, (pos - min(pos) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard FROM sharded
"""

def _op12() -> str:
    """Counts of all grams up to five words, cuts of the frequent ones, and what a longer one of equal count holds."""
    cuts = " UNION ALL ".join(f"SELECT lang, phrase, len, c AS a, {k} AS k, array_to_string(w[:{k}], ' ') AS x, array_to_string(w[{k + 1}:], ' ') AS y FROM candidates WHERE len > {k}" for k in range(1, 5))
    return rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
sums AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
grams AS (SELECT lang, k AS len, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i : i + k - 1])) AS w FROM split, range(1, 6) t(k) WHERE len(w) >= k),
counts AS (SELECT lang, len, w, array_to_string(w, ' ') AS phrase, count(*) AS c FROM grams GROUP BY lang, len, w HAVING count(*) >= 100),
candidates AS (SELECT * FROM counts WHERE len > 1),
cuts AS ({cuts}),
scored AS (SELECT c.lang, c.phrase, c.a, l.c AS l, r.c AS r, s.n, k, (1000 * c.a::HUGEINT * s.n // (l.c::HUGEINT * r.c))::BIGINT AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.x JOIN counts r ON r.lang = c.lang AND r.phrase = c.y JOIN sums s ON s.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM weakest v WHERE NOT EXISTS (SELECT 1 FROM candidates x WHERE x.lang = v.lang AND x.c >= v.a AND x.phrase <> v.phrase AND contains(' ' || x.phrase || ' ', ' ' || v.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= 2000
"""


OP12 = _op12()

OP13 = f"""
WITH poly AS (SELECT list(list_reduce(list_prepend(n::BIGINT, [0, 0, 0, 0]::BIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS rest FROM range(16) r(n)),
turns AS (SELECT conv_id, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))[:32] AS s, octet_length(encode(coalesce(text, ''))) AS b FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(s ORDER BY turn NULLS FIRST, s) AS s, list(b ORDER BY turn NULLS FIRST, s) AS b, list_filter(string_split(hex(encode(conv_id::VARCHAR)), ''), lambda x: x <> '') AS h FROM turns GROUP BY conv_id),
headed AS (SELECT conv_id, s, b, ({_CRC} % 9)::INT AS h FROM own, poly),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(f.s[:c.h], []), c.s[c.h + 1:]) AS s, list_concat(coalesce(f.b[:c.h], []), c.b[c.h + 1:]) AS b FROM headed c LEFT JOIN own f ON f.conv_id = c.conv_id - c.conv_id % 5),
prefixes AS (SELECT conv_id, len(s) AS n, d, array_to_string(s[:d], '') AS node, CASE WHEN d > 0 THEN b[d] ELSE 0 END AS b FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(b) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM prefixes GROUP BY node, d),
children AS (SELECT node[:32 * d - 32] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
above AS (SELECT node[:32 * e] AS node, saved, c.n IS NULL AS leaf FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM nodes) LEFT JOIN children c USING (node)),
totals AS (SELECT node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves FROM above GROUP BY node)
SELECT x.conv_id, x.d AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(c.n, 0) AS n_children, t.n_leaves, t.saved_tokens, x.ends_sha256
FROM nodes x JOIN totals t USING (node) LEFT JOIN children c USING (node) LEFT JOIN nodes p ON x.d > 0 AND p.node = x.node[:32 * x.d - 32]
"""

ORACLES = {"op12_collocations": OP12, "op13_prefix_trie": OP13, "op1_sharding": OP1, "op9_secrets": OP9, "op10_quality": OP10, "op2_decontamination": OP2, "op6_near_dedup": OP6, "op7_line_dedup": OP7}
