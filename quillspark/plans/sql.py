"""Pieces of DuckDB SQL that several oracles share; they restate the adapters and operators independently."""

from __future__ import annotations

EVENTS = """
events_ctx AS (
  SELECT user_id AS context_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
    CASE WHEN event_type IN ('click', 'error') THEN 'tool_output' WHEN event_type = 'view' THEN 'user_message' WHEN event_type = 'signup' THEN 'system' ELSE 'agent_message' END AS kind,
    CASE event_type WHEN 'purchase' THEN 'paid $' || value::DECIMAL(18,2)::VARCHAR WHEN 'error' THEN 'exit code ' || event_id WHEN 'click' THEN 'ok' WHEN 'view' THEN 'view ' || props ELSE 'joined' END AS content
  FROM events)"""
DOCUMENTS = """
docs_ctx AS (SELECT source AS context_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, 'tool_output' AS kind, text AS content FROM documents)"""
CONVERSATIONS = """
conv_ctx AS (SELECT conv_id AS context_id, turn AS pos,
  CASE lower(trim(role)) WHEN 'user' THEN 'user_message' WHEN 'human' THEN 'user_message' WHEN 'system' THEN 'system' WHEN 'tool' THEN 'tool_output' WHEN 'function' THEN 'tool_output' WHEN 'output' THEN 'tool_output' ELSE 'agent_message' END AS kind,
  text AS content FROM conversations)"""


def normalised(text: str) -> str:
    return f"trim(regexp_replace({text}, '[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"


def tokens(text: str) -> str:
    n = f"length({normalised(text)})"
    return f"(CASE WHEN {n} > 0 THEN greatest(1, round_even({n} / 4.0, 0)::BIGINT) ELSE 0 END)::BIGINT"


def measured(source: str) -> str:
    return f"measured AS (SELECT *, {tokens('content')} AS token_count, pos AS original_index, substr(sha256({normalised('content')}), 1, 16) AS content_hash FROM {source})"


DEDUPED = "deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY context_id, content_hash ORDER BY pos) AS n FROM measured) WHERE n = 1)"


def any_of(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


CRITICAL = ("decision:", "constraint:", "must not", "do not", "never", "requirement:")
OBSOLETE = ("superseded by", "no longer", "reverted", "abandoned this approach")
SIGNALS = ("error", "exception", "traceback", "failed", "failure", "denied", "refused", "timeout", "timed out", "not found", "cannot", "unable", "exit code", "exit status", "fatal", "panic", "warning:")
#: RE2 has no look-around: account numbers are left out here, and the driver's tables have none.
FIGURE = r"[$€£¥]\s?\d[\d,]*\.?\d*|\b(?:USD|EUR|GBP|MXN|COP|JPY)\s?\d[\d,]*\.?\d*"
NOISE = r"(?i)^(\s*|(ok|done|success|\+ok)\s*|\s*\d+ files? changed[,\s\d\w()+-]*|\s*\[?\d+%\]?\s*(\||#|=)*\s*)$|^npm (WARN|notice)\b|^\s*(Installing|Downloading|Resolving|Fetching)\b"
NOISY = f"(NOT {any_of('content', SIGNALS)} AND (length(trim(content)) < 24 OR regexp_matches(trim(content), '{NOISE}')))"


def classified(source: str) -> str:
    return f"""ruled AS (SELECT *, count(*) OVER (PARTITION BY context_id) AS total, min(pos) OVER (PARTITION BY context_id, content_hash) AS first FROM {source}),
classified AS (SELECT *, CASE WHEN {any_of('content', CRITICAL)} THEN 'critical' WHEN regexp_matches(content, '{FIGURE}') THEN 'critical' WHEN kind IN ('memory', 'system') THEN 'critical'
  WHEN {any_of('content', OBSOLETE)} THEN 'obsolete' WHEN pos > first THEN 'redundant' WHEN kind = 'tool_output' AND {NOISY} THEN 'irrelevant'
  WHEN total > 10 AND original_index >= total - greatest(3, total // 10) THEN 'critical' ELSE 'relevant' END AS relevance FROM ruled)"""


SHORTENED = "(CASE WHEN kind = 'tool_output' AND relevance <> 'critical' AND length(content) > 2000 THEN substr(content, 1, 1200) || chr(10) || chr(10) || '[... ' || format('{:,}', length(content) - 1800) || ' characters elided by quillspark ...]' || chr(10) || chr(10) || right(content, 600) ELSE content END)"


def pipeline(source: str, budget: int) -> str:
    """measured, deduped, classified, shortened (informative items, cut), kept (within the budget) and placed."""
    bucket = "CASE relevance WHEN 'irrelevant' THEN 0 WHEN 'obsolete' THEN 1 WHEN 'redundant' THEN 2 WHEN 'relevant' THEN 3 ELSE 4 END"
    return f"""{measured(source)}, {DEDUPED}, {classified('deduped')},
shortened AS (SELECT *, {tokens('short')} AS after FROM (SELECT *, {SHORTENED} AS short FROM classified WHERE NOT (kind = 'tool_output' AND relevance = 'irrelevant'))),
summed AS (SELECT *, sum(after) OVER (PARTITION BY context_id) AS whole, coalesce(sum(after) OVER (PARTITION BY context_id ORDER BY {bucket}, original_index DESC, pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM shortened),
kept AS (SELECT * FROM summed WHERE relevance = 'critical' OR whole - gone <= {budget}),
zoned AS (SELECT *, CASE WHEN relevance <> 'critical' THEN 1 WHEN 2 * count(*) FILTER (WHERE relevance = 'critical') OVER (PARTITION BY context_id ORDER BY pos) <= count(*) FILTER (WHERE relevance = 'critical') OVER (PARTITION BY context_id) + 1 THEN 0 ELSE 2 END AS zone FROM kept),
placed AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY zone, pos) - 1 AS placed FROM zoned)"""


def terms(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


def bm25(queries: str, docs: str) -> str:
    """ranked(query_id, doc_id, score, rank) of two sub-selects (query_id, query) and (doc_id, text)."""
    return f"""asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({terms('query')}) AS term FROM ({queries})) GROUP BY 1, 2),
split AS (SELECT doc_id, {terms('text')} AS t FROM ({docs})), totals AS (SELECT count(*) AS n_docs, avg(len(t)) AS mean_length FROM split),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM split) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
scored AS (SELECT query_id, doc_id, sum(times * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean_length))) AS score
  FROM tf JOIN df USING (term) JOIN asked USING (term), totals GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored WHERE score > 0)"""


STAR = """
nodes AS (SELECT 'region:' || r_regionkey AS id, 'region' AS kind, r_name AS name FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name FROM supplier UNION ALL SELECT 'part:' || p_partkey, 'part', p_name FROM part),
edges AS (SELECT 'region:' || n_regionkey AS source, 'nation:' || n_nationkey AS target, 'contains' AS kind FROM nation UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'contains' FROM customer
  UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'contains' FROM supplier UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'calls' FROM lineitem
  UNION ALL SELECT DISTINCT 'customer:' || o_custkey, 'part:' || l_partkey, 'tests' FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ways AS (SELECT source, target, kind FROM edges UNION ALL SELECT target, source, kind FROM edges)"""

LOG = """
log AS (SELECT event_id AS id, event_type AS record_type, user_id, CASE WHEN value < 20 THEN 'rejected' ELSE 'active' END AS status,
  CASE WHEN event_id % 7 = 0 AND event_id >= 3 THEN event_id - 3 END AS supersedes, ts, props AS payload FROM events)"""
PAGES = r"""
paths AS (SELECT page_id, regexp_extract(url, '//[^/]+(/[^?#]*)', 1) AS path FROM pages),
links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)"""
METRICS = """
metrics AS (SELECT lang AS condition, doc_id AS rep, 'quality' AS metric, quality::DOUBLE AS value FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL
  UNION ALL SELECT lang, doc_id, 'toxic', toxic::DOUBLE FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL)"""

#: The project that code._project writes: sources s (parsed if k % 17 <> 0) and tests t; what names what, line by line.
PROJECT = """
k AS (SELECT p_partkey AS k, (p_partkey * 7) % 50 + 1 AS n FROM part),
s AS (SELECT k, n, 'src/p' || k || '.py' AS p, n % 17 <> 0 AS known FROM k WHERE k % 17 <> 0),
t AS (SELECT k, 'tests/test_p' || k || '.py' AS p, k % 17 <> 0 AS known FROM k WHERE k % 2 = 0),
outside AS (SELECT DISTINCT unnest(['os.path', 'json']) AS m FROM s UNION SELECT 'p' || n FROM s WHERE NOT known UNION SELECT 'p' || k FROM t WHERE NOT known UNION SELECT 'shared' FROM t),
code_nodes AS (
  SELECT 'file:' || p AS id, 'file' AS kind, 'p' || k || '.py' AS name, 'p' || k AS qualname, p AS path, NULL::INT AS line, NULL::INT AS end_line, '' AS signature, 'Part ' || k || '.' AS docstring, NULL::BOOLEAN AS is_async FROM s
  UNION ALL SELECT 'file:' || p, 'file', 'test_p' || k || '.py', 'tests.test_p' || k, p, NULL, NULL, '', '', NULL FROM t
  UNION ALL SELECT 'external:' || m, 'external', split_part(m, '.', -1), m, '', NULL, NULL, '', '', NULL FROM outside
  UNION ALL SELECT 'class:' || p || ':Part' || k, 'class', 'Part' || k, 'Part' || k, p, 6, 17, 'class Part' || k || '(Base, Other)', 'Holds ' || k || '.', NULL FROM s
  UNION ALL SELECT 'method:' || p || ':Part' || k || '.run', 'method', 'run', 'Part' || k || '.run', p, 9, 14, 'run(self, db, x: int, *rest, flag: bool, **more) -> str', 'Runs.', false FROM s
  UNION ALL SELECT 'method:' || p || ':Part' || k || '.stop', 'method', 'stop', 'Part' || k || '.stop', p, 16, 17, 'stop(self)', '', true FROM s
  UNION ALL SELECT 'class:' || p || ':Worker', 'class', 'Worker', 'Worker', p, 19, 21, 'class Worker(Part' || k || ')', '', NULL FROM s
  UNION ALL SELECT 'method:' || p || ':Worker.run', 'method', 'run', 'Worker.run', p, 20, 21, 'run(self)', '', false FROM s
  UNION ALL SELECT 'function:' || p || ':helper' || k, 'function', 'helper' || k, 'helper' || k, p, 23, 26, 'helper' || k || '(x, y)', '', false FROM s
  UNION ALL SELECT 'method:' || p || ':helper' || k || '.inner', 'method', 'inner', 'helper' || k || '.inner', p, 24, 25, 'inner()', '', false FROM s
  UNION ALL SELECT 'test:' || p || ':test_helper' || k, 'test', 'test_helper' || k, 'test_helper' || k, p, 4, 6, 'test_helper' || k || '()', '', false FROM t
  UNION ALL SELECT 'function:' || p || ':thing' || k, 'function', 'thing' || k, 'thing' || k, p, 8, 9, 'thing' || k || '()', '', false FROM t),
named AS (
  SELECT 'class:' || p || ':Part' || k AS source, 'inherits' AS kind, 6 AS line, 'Base' AS raw, NULL AS id, 4 AS step FROM s
  UNION ALL SELECT 'class:' || p || ':Part' || k, 'inherits', 6, 'Other', CASE WHEN known THEN 'class:src/p' || n || '.py:Part' || n END, 3 FROM s
  UNION ALL SELECT 'class:' || p || ':Worker', 'inherits', 19, 'Part' || k, 'class:' || p || ':Part' || k, 1 FROM s
  UNION ALL SELECT 'method:' || p || ':Part' || k || '.run', 'calls', 11, 'self.stop', 'method:' || p || ':Part' || k || '.stop', 2 FROM s
  UNION ALL SELECT 'method:' || p || ':Part' || k || '.run', 'calls', 12, 'helper' || n, CASE WHEN known THEN 'function:src/p' || n || '.py:helper' || n END, CASE WHEN n = k THEN 1 ELSE 3 END FROM s
  UNION ALL SELECT 'method:' || p || ':Part' || k || '.run', 'calls', 13, 'js.dumps', NULL, 4 FROM s
  UNION ALL SELECT 'method:' || p || ':Part' || k || '.run', 'calls', 14, 'Worker.run', 'method:' || p || ':Worker.run', 1 FROM s
  UNION ALL SELECT 'method:' || p || ':Part' || k || '.stop', 'calls', 17, 'helper' || k, 'function:' || p || ':helper' || k, 1 FROM s
  UNION ALL SELECT 'method:' || p || ':Worker.run', 'calls', 21, 'thing' || k, CASE WHEN k % 2 = 0 THEN 'function:tests/test_p' || k || '.py:thing' || k END, 4 FROM s
  UNION ALL SELECT 'method:' || p || ':helper' || k || '.inner', 'calls', 25, 'x.strip', NULL, 4 FROM s
  UNION ALL SELECT 'function:' || p || ':helper' || k, 'calls', 26, 'inner', 'method:' || p || ':helper' || k || '.inner', 1 FROM s
  UNION ALL SELECT 'test:' || p || ':test_helper' || k, 'calls', 5, 'helper' || k, CASE WHEN known THEN 'function:src/p' || k || '.py:helper' || k END, 3 FROM t
  UNION ALL SELECT 'test:' || p || ':test_helper' || k, 'calls', 6, 'Part' || k, CASE WHEN known THEN 'class:src/p' || k || '.py:Part' || k END, 4 FROM t
  UNION ALL SELECT 'test:' || p || ':test_helper' || k, 'calls', 6, 'run', NULL, 4 FROM t
  UNION ALL SELECT 'function:' || p || ':thing' || k, 'calls', 9, 'helper' || k, CASE WHEN known THEN 'function:src/p' || k || '.py:helper' || k END, 3 FROM t),
code_edges AS (
  SELECT source, coalesce(id, raw) AS target, kind, id IS NOT NULL AS resolved, line FROM named
  UNION SELECT source, id, 'tests', true, line FROM named WHERE starts_with(source, 'test:') AND id IS NOT NULL
  UNION SELECT 'file:' || p, 'external:' || m, 'imports', false, l FROM s, (VALUES ('os.path', 2), ('json', 3)) v(m, l)
  UNION SELECT 'file:' || p, CASE WHEN known THEN 'file:src/p' || n || '.py' ELSE 'external:p' || n END, 'imports', known, 4 FROM s
  UNION SELECT 'file:' || p, CASE WHEN known THEN 'file:src/p' || k || '.py' ELSE 'external:p' || k END, 'imports', known, 1 FROM t
  UNION SELECT 'file:' || p, 'external:shared', 'imports', false, 2 FROM t
  UNION SELECT CASE WHEN kind = 'method' THEN 'class:' || path || ':' || regexp_replace(qualname, '[.][^.]*$', '') ELSE 'file:' || path END, id, 'contains', true, NULL FROM code_nodes WHERE kind NOT IN ('file', 'external'))"""


def _turn(kind: str) -> str:
    return f"CASE {kind} WHEN 'contains' THEN 0 WHEN 'inherits' THEN 1 WHEN 'calls' THEN 2 ELSE 3 END"


def contexts(tasks: str, nodes: str, edges: str, limit: int = 20) -> str:
    """answers(task_id, id, score, depth, reasons) of sub-selects (task_id, task), (id, name, text, wanted, place) and (source, target, kind)."""
    seeds = max(limit // 2, 5)
    return f"""tasks AS ({tasks}), nd AS ({nodes}), ed AS (SELECT DISTINCT e.source, e.target, e.kind FROM ({edges}) e JOIN nd a ON a.id = e.source JOIN nd b ON b.id = e.target),
{bm25('SELECT task_id AS query_id, task AS query FROM tasks', 'SELECT id AS doc_id, text FROM nd WHERE wanted')},
seeds AS (SELECT query_id AS task_id, doc_id AS seed, rank, score / max(score) OVER (PARTITION BY query_id) AS base, name FROM ranked JOIN nd ON nd.id = doc_id WHERE rank <= {seeds}),
w AS (SELECT source, target FROM ed UNION SELECT target, source FROM ed),
one AS (SELECT DISTINCT seed, target AS id, 1 AS depth FROM seeds JOIN w ON source = seed), two AS (SELECT DISTINCT seed, target, 2 FROM one JOIN w ON source = id),
reach AS (SELECT seed, id, min(depth) AS depth FROM (FROM one UNION ALL FROM two) WHERE seed <> id GROUP BY 1, 2),
cells AS (SELECT a.task_id, a.rank AS i, b.rank AS j, coalesce(pow(0.4, r.depth), 0) AS x FROM seeds a JOIN seeds b ON a.task_id = b.task_id LEFT JOIN reach r ON r.seed = a.seed AND r.id = b.seed),
rowed AS (SELECT task_id, i, list(x ORDER BY j) AS x FROM cells GROUP BY 1, 2), grid AS (SELECT task_id, list(x ORDER BY i) AS m FROM rowed GROUP BY 1),
fold AS (SELECT task_id, 1::BIGINT AS pass, list(base ORDER BY rank) AS s, []::DOUBLE[] AS given FROM seeds GROUP BY 1
  UNION ALL SELECT f.task_id, f.pass + 1, list_transform(f.s, lambda x, y: x + f.s[f.pass] * g.m[f.pass][y]), list_append(f.given, f.s[f.pass]) FROM fold f JOIN grid g ON g.task_id = f.task_id WHERE f.pass <= len(f.s)),
folded AS (SELECT * FROM fold WHERE pass = len(s) + 1),
linked AS (SELECT source AS id, target AS seed, {_turn('kind')} AS o, CASE kind WHEN 'contains' THEN 'contains' WHEN 'inherits' THEN 'inherits from' WHEN 'calls' THEN 'calls' ELSE 'tests' END AS v FROM ed
  UNION ALL SELECT target, source, 10 + {_turn('kind')}, CASE kind WHEN 'contains' THEN 'contained in' WHEN 'inherits' THEN 'base of' WHEN 'calls' THEN 'called by' ELSE 'tested by' END FROM ed),
words AS (SELECT id, seed, min_by(v, o) AS v FROM linked GROUP BY 1, 2),
hits AS (SELECT s.task_id, r.id, s.rank, r.depth, f.given[s.rank] * pow(0.4, r.depth) AS part, coalesce(v, 'reachable from') || ' ' || s.name AS reason
  FROM seeds s JOIN folded f ON f.task_id = s.task_id JOIN reach r ON r.seed = s.seed JOIN nd ON nd.id = r.id AND wanted LEFT JOIN words q ON q.id = r.id AND q.seed = s.seed
  UNION ALL SELECT s.task_id, s.seed, 0, 0, NULL, 'matches ' || chr(39) || task || chr(39) || ' (rank ' || s.rank || ')' FROM seeds s JOIN tasks USING (task_id)),
said AS (SELECT task_id, id, list(reason ORDER BY f, reason) AS reasons FROM (SELECT task_id, id, reason, min(rank) AS f FROM hits GROUP BY 1, 2, 3) GROUP BY 1, 2),
sums AS (SELECT h.task_id, h.id, sum(part) AS part, min_by(h.depth, h.rank)::INT AS depth FROM hits h GROUP BY 1, 2),
scores AS (SELECT u.task_id, u.id, coalesce(f.s[e.rank], part) AS score, depth, reasons, place FROM sums u JOIN said USING (task_id, id) JOIN nd ON nd.id = u.id LEFT JOIN seeds e ON e.task_id = u.task_id AND e.seed = u.id LEFT JOIN folded f ON f.task_id = u.task_id),
answers AS (SELECT task_id, id, round(score, 6) AS score, depth, reasons FROM scores QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY round(score, 9) DESC, place, id) <= {limit})"""
