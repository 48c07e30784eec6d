"""Queries over graphs of source code, with the SQL that says what the code that they write must give."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import claims, codegraph, graph, rules
from ..sources import adapters as A
from ..sources import trees
from ..sources.graph_store import GraphStore
from ..sources.keyed import KeyedTable
from ..storage import saved, shared_folder
from . import sql as S
from .registry import query

SOURCE = '''"""Part {k}."""
import os.path
import json as js
from p{n} import helper{n}, Part{n} as Other

class Part{k}(Base, Other):
    """Holds {k}."""

    def run(self, db, x: int = 1, *rest, flag: bool, **more) -> str:
        """Runs."""
        self.stop()
        helper{n}(x)
        js.dumps(x)
        return Worker.run(self)

    async def stop(self):
        return helper{k}(1)

class Worker(Part{k}):
    def run(self):
        return thing{k}(2)

def helper{k}(x, /, y=None):
    def inner():
        return x.strip()
    return inner()
'''
TEST = """from p{k} import helper{k}
import shared

def test_helper{k}():
    helper{k}(1)
    Part{k}().run()

def thing{k}():
    helper{k}(2)
"""


def project(spark, sf_dir):
    """A source file for each part and a test file for every second: classes, methods and functions that share names, imports
    from each other, from outside and under other names, notes, types, a coroutine; some files don't parse."""
    k = F.col("p_partkey")
    fill = lambda code: F.replace(F.replace(F.lit(code), F.lit("{k}"), k.cast("string")), F.lit("{n}"), ((k * 7) % 50 + 1).cast("string"))
    parts = A.table(spark, sf_dir, "part")
    text = F.when(k % 17 == 0, F.lit("def broken(:\n")).otherwise(fill(SOURCE))
    sources = parts.select(F.concat(F.lit("src/p"), k.cast("string"), F.lit(".py")).alias("path"), text.alias("text"))
    return sources.unionByName(parts.where("p_partkey % 2 = 0").select(F.concat(F.lit("tests/test_p"), k.cast("string"), F.lit(".py")).alias("path"), fill(TEST).alias("text")))


def _parsed(spark, sf_dir):
    return saved(codegraph.parse(project(spark, sf_dir), largest=None), "parsed")


@query(f"WITH {S.PROJECT} SELECT * FROM code_nodes")
def code_graph_nodes(spark, sf_dir):
    return codegraph.code_graph(_parsed(spark, sf_dir))[0]


@query(f"WITH {S.PROJECT} SELECT * FROM code_edges")
def code_graph_edges(spark, sf_dir):
    return codegraph.code_graph(_parsed(spark, sf_dir))[1]


@query(f"WITH {S.PROJECT} SELECT source, kind, line, raw AS target, id AS target_id, CASE WHEN id IS NOT NULL THEN step END AS step FROM named")
def code_scopes(spark, sf_dir):
    """Which definition each reference names, and which of the four sets of candidates had it."""
    return codegraph.references(_parsed(spark, sf_dir)).select("source", "kind", "line", "target", "target_id", "step")


_TASKS = "SELECT r_regionkey AS task_id, 'runs helper' || (r_regionkey * 9 + 2) || ' of part ' || (r_regionkey + 3) || ' worker' AS task FROM region"
_TEXTS = """SELECT id, name, name || ' ' || qualname || ' ' || signature || ' ' || docstring AS text, kind IN ('function', 'method', 'class', 'test') AS wanted,
 path || ':' || lpad(coalesce(line, 0)::VARCHAR, 9, '0') AS place FROM code_nodes"""


@query(f"""WITH RECURSIVE {S.PROJECT}, {S.contexts(_TASKS, _TEXTS, "SELECT source, target, kind FROM code_edges WHERE resolved AND kind <> 'imports'")} SELECT * FROM answers""")
def code_context_for(spark, sf_dir):
    """Code for a task of each region: by names, signatures and notes, then along calls, containment, bases and tests."""
    nodes, edges = codegraph.code_graph(_parsed(spark, sf_dir))
    key = F.col("r_regionkey")
    task = F.concat(F.lit("runs helper"), (key * 9 + 2).cast("string"), F.lit(" of part "), (key + 3).cast("string"), F.lit(" worker"))
    tasks = A.table(spark, sf_dir, "region").select(key.alias("task_id"), task.alias("task"))
    return codegraph.code_contexts(nodes, edges, tasks).withColumn("score", F.round("score", 6))


@query(f"""WITH {S.PROJECT} SELECT 'nodes.' || kind AS what, count(*) AS n FROM code_nodes GROUP BY 1 UNION ALL SELECT 'edges.' || kind, count(*) FROM code_edges GROUP BY 1 UNION ALL SELECT 'nodes.total', count(*) FROM code_nodes UNION ALL SELECT 'edges.total', count(*) FROM code_edges
 UNION ALL SELECT 'edges.unresolved', count(*) FROM code_edges WHERE NOT resolved UNION ALL SELECT 'files', count(*) FROM code_nodes WHERE kind = 'file'""")
def code_graph_stats(spark, sf_dir):
    return codegraph.code_stats(*codegraph.code_graph(_parsed(spark, sf_dir)))


EXTRA = """
def extra{k}():
    return helper{k}(3)
"""
#: The second version of the project: files go (k % 5), change (k % 7), are mended (k % 34) and come (k % 11).
_SECOND = """k AS (SELECT p_partkey AS k FROM part),
files AS (SELECT k, 'src/p' || k || '.py' AS p, CASE WHEN k % 5 = 0 THEN 'vanished' WHEN k % 17 = 0 THEN CASE WHEN k % 34 = 0 THEN 'new' ELSE 'syntax' END WHEN k % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS outcome FROM k WHERE k % 5 <> 0 OR k % 17 <> 0
  UNION ALL SELECT k, 'tests/test_p' || k || '.py', 'unchanged' FROM k WHERE k % 2 = 0 UNION ALL SELECT k, 'src/new' || k || '.py', 'new' FROM k WHERE k % 11 = 0)"""


def _versions(spark, sf_dir):
    """A store that has read the project once and then its second version, and what the second run said of each file."""
    store = GraphStore(f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}", largest=None)
    store.ingest(project(spark, sf_dir))
    k = F.col("p_partkey")
    fill = lambda code: F.replace(F.replace(F.lit(code), F.lit("{k}"), k.cast("string")), F.lit("{n}"), ((k * 7) % 50 + 1).cast("string"))
    named = lambda prefix: F.concat(F.lit(prefix), k.cast("string"), F.lit(".py")).alias("path")
    parts = A.table(spark, sf_dir, "part")
    text = F.when((k % 17 == 0) & (k % 34 != 0), F.lit("def broken(:\n")).when(k % 7 == 0, fill(SOURCE + EXTRA)).otherwise(fill(SOURCE))
    files = parts.where("p_partkey % 5 <> 0").select(named("src/p"), text.alias("text")).unionByName(parts.where("p_partkey % 2 = 0").select(named("tests/test_p"), fill(TEST).alias("text")))
    return store, store.ingest(files.unionByName(parts.where("p_partkey % 11 = 0").select(named("src/new"), fill(EXTRA).alias("text"))))


@query(f"WITH {_SECOND} SELECT p AS path, outcome FROM files")
def code_ingest_report(spark, sf_dir):
    """What the second run found: only new and changed files are parsed."""
    return _versions(spark, sf_dir)[1]


@query(f"""WITH {_SECOND}, f AS (SELECT * FROM files WHERE outcome NOT IN ('vanished', 'syntax')), s AS (SELECT * FROM f WHERE starts_with(p, 'src/p')), t AS (SELECT * FROM f WHERE starts_with(p, 'tests'))
SELECT 'file:' || p AS id, NULL::INT AS line FROM f UNION ALL SELECT 'class:' || p || ':Part' || k, 6 FROM s UNION ALL SELECT 'method:' || p || ':Part' || k || '.run', 9 FROM s UNION ALL SELECT 'method:' || p || ':Part' || k || '.stop', 16 FROM s
 UNION ALL SELECT 'class:' || p || ':Worker', 19 FROM s UNION ALL SELECT 'method:' || p || ':Worker.run', 20 FROM s UNION ALL SELECT 'function:' || p || ':helper' || k, 23 FROM s UNION ALL SELECT 'method:' || p || ':helper' || k || '.inner', 24 FROM s
 UNION ALL SELECT 'function:' || p || ':extra' || k, 28 FROM s WHERE k % 7 = 0 UNION ALL SELECT 'function:' || p || ':extra' || k, 2 FROM f WHERE starts_with(p, 'src/new') UNION ALL SELECT 'test:' || p || ':test_helper' || k, 4 FROM t UNION ALL SELECT 'function:' || p || ':thing' || k, 8 FROM t""")
def code_incremental_nodes(spark, sf_dir):
    """The graph after two runs over two versions."""
    return _versions(spark, sf_dir)[0].graph(spark)[0].where("kind <> 'external'").select("id", "line")


@query(f"WITH {S.LOG} SELECT id, CASE WHEN id % 3 = 0 THEN 'rewritten' ELSE record_type END AS record_type FROM log WHERE id % 10 <> 1 UNION ALL SELECT -id, 'added' FROM log WHERE id % 3 = 0 AND id > 0")
def keyed_upsert(spark, sf_dir):
    """A log in a keyed table: a third of its records are written again, some are added, some are taken out."""
    log = A.event_log(spark, sf_dir).select("id", "record_type")
    table = KeyedTable(f"{shared_folder(spark)}/keyed-{uuid.uuid4().hex}", "id", "id long, record_type string", 16)
    table.upsert(log)
    third = log.where("id % 3 = 0")
    table.upsert(third.select("id", F.lit("rewritten").alias("record_type")).unionByName(third.where("id > 0").select((-F.col("id")).alias("id"), F.lit("added").alias("record_type"))))
    table.replace(log.where("id % 10 = 1"), log.where("false"))
    return table.read(spark)


_REPORT = f"""{S.PROJECT}, u AS (SELECT s_suppkey AS x, (s_suppkey * 7) % 50 + 1 AS y FROM supplier),
claims AS (SELECT x AS text_id, 'symbol_relation' AS kind, 'Part' || x AS subject, 'inherits' AS relation, 'Base' AS target, false AS negated, false AS called FROM u
  UNION ALL SELECT x, 'symbol_relation', 'Part' || x || '.run', 'calls', 'helper' || y, false, false FROM u UNION ALL SELECT x, 'symbol_relation', 'Part' || x || '.run', 'calls', 'src/p' || y || '.py', false, false FROM u
  UNION ALL SELECT x, 'symbol_relation', 'helper' || x, 'calls', 'inner', true, false FROM u UNION ALL SELECT x, 'symbol_relation', 'helper' || x, 'calls', 'Worker', false, false FROM u
  UNION ALL SELECT x, 'symbol_relation', 'test_helper' || x, 'calls', 'dumps', false, false FROM u UNION ALL SELECT x, 'symbol_relation', 'p' || x || '.py', 'imports', 'src/p1.py', false, false FROM u UNION ALL SELECT x, 'symbol_relation', 'run', 'imports', 'src/p1.py', false, false FROM u
  UNION ALL SELECT x, 'symbol_exists', 'Worker.run', NULL, NULL, false, false FROM u UNION ALL SELECT x, 'symbol_exists', 'thing' || x, NULL, NULL, false, true FROM u UNION ALL SELECT x, 'symbol_exists', 'elper_' || x, NULL, NULL, false, false FROM u
  UNION ALL SELECT x, 'symbol_exists', 'no_such_' || x, NULL, NULL, false, false FROM u UNION ALL SELECT x, 'file_exists', 'tests//./test_p' || x || '.py', NULL, NULL, false, false FROM u UNION ALL SELECT x, 'file_exists', '/src/', NULL, NULL, false, false FROM u
  UNION ALL SELECT x, 'file_exists', 'src/../../x.py', NULL, NULL, false, false FROM u),
wanted AS (SELECT DISTINCT subject AS wanted FROM claims WHERE kind = 'symbol_exists' OR relation <> 'imports' UNION SELECT target FROM claims WHERE relation <> 'imports' AND NOT contains(target, '/')),
exact AS (SELECT wanted, id, 0 AS o, '' AS name FROM wanted JOIN code_nodes ON name = wanted), whole AS (SELECT wanted, id, length(name) AS o, name FROM wanted JOIN code_nodes ON qualname = wanted WHERE wanted NOT IN (SELECT wanted FROM exact)),
loose AS (SELECT wanted, id, length(name) AS o, name FROM wanted JOIN code_nodes ON name ILIKE '%' || wanted || '%' OR qualname ILIKE '%' || wanted || '%' WHERE wanted NOT IN (SELECT wanted FROM exact UNION SELECT wanted FROM whole) QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY length(name), name, id) <= 10),
found AS (SELECT wanted, f.id, row_number() OVER (PARTITION BY wanted ORDER BY o, f.name, f.id) AS place, path, CASE WHEN line IS NULL THEN path ELSE path || ':' || line END AS loc FROM (FROM exact UNION ALL FROM whole UNION ALL FROM loose) f JOIN code_nodes n ON n.id = f.id),
defined AS (SELECT wanted, count(*) AS n, list(loc ORDER BY place) AS locs FROM found GROUP BY 1), asks AS (SELECT DISTINCT kind, subject, relation, target FROM claims),
sure AS (SELECT a.subject, a.relation, a.target, min_by(s.loc, s.place) AS loc FROM asks a JOIN found s ON s.wanted = a.subject JOIN code_edges e ON e.source = s.id AND e.kind = a.relation AND e.resolved JOIN found t ON t.wanted = a.target AND t.id = e.target GROUP BY 1, 2, 3),
maybe AS (SELECT DISTINCT a.subject, a.relation, a.target FROM asks a JOIN found s ON s.wanted = a.subject JOIN code_edges e ON e.source = s.id AND e.kind = a.relation AND NOT e.resolved AND split_part(e.target, '.', -1) = split_part(a.target, '.', -1)),
used AS (SELECT DISTINCT a.subject, a.target FROM asks a JOIN found s ON s.wanted = a.subject JOIN code_edges e ON e.kind = 'imports' AND e.resolved AND e.source = 'file:' || s.path AND e.target = 'file:' || a.target),
files AS (SELECT 'src/p' || k || '.py' AS path FROM k UNION ALL SELECT p FROM t),
coded AS (SELECT c.*, d.locs, r.loc, CASE WHEN c.kind = 'file_exists' THEN CASE WHEN starts_with(c.subject, 'src/..') THEN 'contradicted 1.0' WHEN c.subject = '/src/' OR replace(c.subject, '//./', '/') IN (SELECT path FROM files) THEN 'supported 1.0' ELSE 'contradicted 1.0' END
  WHEN c.kind = 'symbol_exists' THEN CASE WHEN d.n IS NULL THEN 'contradicted 1.0' ELSE 'supported 1.0' END WHEN c.relation = 'imports' THEN CASE WHEN c.subject = 'run' THEN 'unverifiable 0.0' ELSE 'contradicted 1.0' END WHEN d.n IS NULL THEN 'contradicted 1.0'
  WHEN contains(c.target, '/') THEN CASE WHEN c.target NOT IN (SELECT path FROM code_nodes WHERE kind = 'file') THEN 'contradicted 1.0' WHEN (c.subject, c.target) IN (SELECT (subject, target) FROM used) THEN 'unverifiable 0.0' ELSE 'contradicted 0.9' END
  WHEN c.target NOT IN (SELECT wanted FROM found) THEN 'contradicted 1.0' WHEN r.loc IS NOT NULL THEN 'supported 1.0' WHEN (c.subject, c.relation, c.target) IN (SELECT (subject, relation, target) FROM maybe) THEN 'unverifiable 0.0' ELSE 'contradicted 0.9' END AS v
  FROM claims c LEFT JOIN defined d ON d.wanted = c.subject LEFT JOIN sure r ON r.subject = c.subject AND r.relation = c.relation AND r.target = c.target),
checks AS (SELECT text_id, kind, subject, relation, target, negated, CASE WHEN negated AND v LIKE 'supp%' THEN 'contradicted' WHEN negated AND v LIKE 'contra%' THEN 'supported' ELSE split_part(v, ' ', 1) END AS status, split_part(v, ' ', 2)::DOUBLE AS confidence,
  CASE WHEN kind = 'symbol_exists' THEN coalesce(locs[:5], []) WHEN v LIKE 'supp%' THEN CASE WHEN kind = 'file_exists' THEN [subject] ELSE [loc] END ELSE [] END AS evidence FROM coded)"""


def _claim_texts(spark, sf_dir):
    x = F.col("s_suppkey").cast("string")
    y = ((F.col("s_suppkey") * 7) % 50 + 1).cast("string")
    text = F.lit(
        "`Part{x}` inherits from `Base`. `Part{x}.run` calls `helper{y}` and `src/p{y}.py`; `helper{x}` never calls `inner`, but `helper{x}` calls `Worker`. `test_helper{x}` calls `dumps`. `p{x}.py` imports `src/p1.py`. "
        "`run` imports `src/p1.py`. See `Worker.run`, `thing{x}()`, `elper_{x}`, `no_such_{x}`, `tests//./test_p{x}.py`, `/src/` and `src/../../x.py`."
    )
    return A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("text_id"), F.replace(F.replace(text, F.lit("{x}"), x), F.lit("{y}"), y).alias("text"))


def _claim_checks(spark, sf_dir):
    files = project(spark, sf_dir)
    nodes, edges = codegraph.code_graph(saved(codegraph.parse(files, largest=None), "parsed"))
    return claims.check(_claim_texts(spark, sf_dir), saved(nodes, "nodes"), saved(edges, "edges"), files)


@query(f"WITH {_REPORT} SELECT * FROM checks")
def claim_checks(spark, sf_dir):
    """Claims of all kinds against the project's graph and listing, with places as evidence."""
    return _claim_checks(spark, sf_dir).drop("explanation")


@query(f"""WITH {_REPORT} SELECT text_id, count(*) AS claims_extracted, count(*) FILTER (WHERE status = 'supported') AS supported, count(*) FILTER (WHERE status = 'contradicted') AS contradicted, count(*) FILTER (WHERE status = 'unverifiable') AS unverifiable, 0::BIGINT AS resembled,
 'no memory given: decisions and constraints aren''t checked' AS degraded_reason FROM checks GROUP BY 1""")
def claim_reports(spark, sf_dir):
    """A row for each text: every claim is accounted for."""
    return claims.reports(_claim_texts(spark, sf_dir), _claim_checks(spark, sf_dir), memory=False)


@query(f"""WITH {S.PROJECT}, wanted AS (SELECT DISTINCT unnest(['run', 'Worker.run', 'elper_1', 'HELPER2', 'p' || s_suppkey || '.py', 'art' || s_suppkey, '__', 'x' || s_suppkey || 'y']) AS wanted FROM supplier),
exact AS (SELECT wanted, id FROM wanted JOIN code_nodes ON name = wanted), whole AS (SELECT wanted, id FROM wanted JOIN code_nodes ON qualname = wanted WHERE wanted NOT IN (SELECT wanted FROM exact)),
loose AS (SELECT wanted, id FROM wanted JOIN code_nodes ON name ILIKE '%' || wanted || '%' OR qualname ILIKE '%' || wanted || '%' WHERE wanted NOT IN (SELECT wanted FROM exact UNION SELECT wanted FROM whole) QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY length(name), name, id) <= 10)
SELECT wanted, id, 0 AS tier FROM exact UNION ALL SELECT wanted, id, 1 FROM whole UNION ALL SELECT wanted, id, 2 FROM loose""")
def code_look_up(spark, sf_dir):
    """What names mean: by name, by full name, else the first ten that hold them."""
    x = F.col("s_suppkey").cast("string")
    names = F.array(F.lit("run"), F.lit("Worker.run"), F.lit("elper_1"), F.lit("HELPER2"), F.concat(F.lit("p"), x, F.lit(".py")), F.concat(F.lit("art"), x), F.lit("__"), F.concat(F.lit("x"), x, F.lit("y")))
    wanted = A.table(spark, sf_dir, "supplier").select(F.explode(names).alias("wanted")).distinct()
    return graph.look_up(saved(codegraph.code_graph(_parsed(spark, sf_dir))[0], "nodes"), wanted).select("wanted", "id", "tier")


@query(f"""WITH {S.PROJECT}, c AS (SELECT target AS id, count(DISTINCT source) AS n FROM code_edges WHERE kind = 'calls' AND resolved GROUP BY 1), u AS (SELECT id FROM code_nodes WHERE kind IN ('class', 'function', 'method') AND NOT starts_with(name, '_') AND id NOT IN (SELECT target FROM code_edges WHERE kind = 'tests')),
f AS (SELECT path, max(coalesce(c.n, 0)) AS callers, count(u.id) AS untested FROM code_nodes n LEFT JOIN c ON c.id = n.id LEFT JOIN u ON u.id = n.id WHERE path <> '' GROUP BY 1), i AS (SELECT target[6:] AS path, count(DISTINCT source) AS fan_in FROM code_edges WHERE kind = 'imports' AND resolved GROUP BY 1),
asked AS (SELECT unnest([['src/p' || k || '.py', 'src/p' || k || '.py', ''], ['./src//api/../p' || k || '.py', 'src/p' || k || '.py', ''], ['/repo/src/p' || k || '.py', 'src/p' || k || '.py', ''], ['/else/auth/p' || k || '.py', '/else/auth/p' || k || '.py', 'outside the root'], ['../p' || k || '.py', '../p' || k || '.py', 'outside the root'], ['docs/Billing' || k || '.md', 'docs/Billing' || k || '.md', 'not in the graph']]) AS a FROM k),
x AS (SELECT a[1] AS unit, a[2] AS path, CASE WHEN a[3] = '' AND f.path IS NULL THEN 'not in the graph' WHEN a[3] = '' THEN NULL ELSE a[3] END AS note, CASE WHEN a[2] LIKE '%auth%' THEN 'auth' WHEN a[2] ILIKE '%billing%' THEN 'billing' END AS marker, callers, coalesce(fan_in, 0) AS fan_in, untested, f.path IS NOT NULL AS there FROM asked LEFT JOIN f ON f.path = a[2] LEFT JOIN i ON i.path = a[2]),
r AS (SELECT unit, marker, list_filter([CASE WHEN marker IS NOT NULL THEN 'path:' || marker END, CASE WHEN there AND callers >= 3 THEN 'callers' END, CASE WHEN there AND fan_in >= 2 THEN 'fan_in' END, CASE WHEN there AND untested > 0 THEN 'untested' END], lambda v: v IS NOT NULL) AS reasons, note FROM x)
SELECT unit, CASE WHEN marker IS NOT NULL THEN 'high' WHEN len(reasons) > 0 THEN 'medium' ELSE 'low' END AS tier, reasons, note FROM r""")
def code_file_risk(spark, sf_dir):
    """Risk of files by paths as they are given: plain, doubled, absolute, from elsewhere, leading out, of no source."""
    nodes, edges = codegraph.code_graph(_parsed(spark, sf_dir))
    k = F.col("p_partkey").cast("string")
    named = lambda before, after=".py": F.concat(F.lit(before), k, F.lit(after))
    paths = F.array(named("src/p"), named("./src//api/../p"), named("/repo/src/p"), named("/else/auth/p"), named("../p"), named("docs/Billing", ".md"))
    return codegraph.file_risk(saved(nodes, "nodes"), saved(edges, "edges"), A.table(spark, sf_dir, "part").select(F.explode(paths).alias("path")), root="/repo")


_UNSAFE = (
    ("k % 2 = 0", "def q(db, x):\n    s = f'select {x}'\n    db.execute(s)\n"),
    ("k % 4 = 1 OR k % 6 = 0", "def p(db, x):\n    db.executemany('insert %s', (x,))\n"),
    ("k % 3 = 0", "def sh(cmd):\n    subprocess.run(cmd, shell=True)\n"),
    ("k % 5 = 0", "def ls(d):\n    subprocess.run(['ls', d])\n"),
    ("k % 7 = 0", "def put(c, k, v):\n    if k in c:\n        return\n    c[k] = v\n"),
    ("k % 11 = 0", "def put2(c, k, v):\n    with lock:\n        if k not in c:\n            c[k] = v\n"),
)
_BROKEN = """broken AS (SELECT k, 'src/u' || k || '.py' AS unit, r.* FROM (SELECT p_partkey AS k FROM part), (VALUES ('sql-injection', 'high'), ('check-then-act-race', 'medium'), ('shell-command-injection', 'high')) r(rule_id, severity)
 WHERE CASE rule_id WHEN 'sql-injection' THEN k % 2 = 0 AND k % 6 <> 0 WHEN 'check-then-act-race' THEN k % 7 = 0 AND k % 11 <> 0 ELSE k % 3 = 0 AND k % 5 <> 0 END),
placed AS (SELECT *, 1 + CASE rule_id WHEN 'sql-injection' THEN 2 WHEN 'check-then-act-race' THEN 1 + CASE WHEN k % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN k % 4 = 1 OR k % 6 = 0 THEN 2 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END
 ELSE 1 + CASE WHEN k % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN k % 4 = 1 OR k % 6 = 0 THEN 2 ELSE 0 END END AS line FROM broken)"""


def _findings(spark, sf_dir):
    """A file for each part with some of six functions, safe and unsafe."""
    k = F.col("p_partkey")
    pieces = [F.when(F.expr(f"{test}".replace("k ", "p_partkey ")), F.lit(code)).otherwise("") for test, code in _UNSAFE]
    files = A.table(spark, sf_dir, "part").select(F.concat(F.lit("src/u"), k.cast("string"), F.lit(".py")).alias("path"), F.concat(*pieces).alias("text"))
    parsed, known = saved(codegraph.parse(files, largest=None), "parsed"), rules.security_rules(spark)
    return known, rules.findings(known, codegraph.facts(parsed), codegraph.fact_places(parsed))


@query(f"WITH {_BROKEN} SELECT rule_id, unit, severity, [line::INT] AS lines FROM placed")
def security_scan(spark, sf_dir):
    """All built-in rules over all files, with the lines that show each finding."""
    return _findings(spark, sf_dir)[1]


@query(f"WITH {_BROKEN} SELECT rule_id, count(*) AS n FROM broken GROUP BY 1")
def security_caveats(spark, sf_dir):
    known, found = _findings(spark, sf_dir)
    return rules.caveats(known, found).select("rule_id", "n")


_CHAIN = (("c1", "PRE: click; POST: seen"), ("c2", "PRE: seen, view; POST: keen"), ("c3", "PRE: view_low; POST: seen"), ("c4", "PRE: keen; POST: buyer"), ("c5", "PRE: buyer; POST: click"), ("c6", "POST: never"), ("c7", "PRE: ; POST: always"))


def _unit_facts(spark, sf_dir):
    kind = F.when(F.col("value") > 50, F.col("event_type")).otherwise(F.concat("event_type", F.lit("_low")))
    return A.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("unit")).agg(F.array_sort(F.collect_set(kind)).alias("facts"))


def _chain(spark):
    return rules.parse_rules(spark.createDataFrame(_CHAIN, "id string, formal_spec string"))


_UNITS = "u AS (SELECT user_id AS unit, list(DISTINCT CASE WHEN value > 50 THEN event_type ELSE event_type || '_low' END) AS f FROM events GROUP BY 1)"


@query(f"""WITH {_UNITS}, r1 AS (SELECT unit, f, list_contains(f, 'click') AS c, list_contains(f, 'view') AS v, list_contains(f, 'view_low') AS l FROM u), s AS (SELECT *, c OR l AS seen FROM r1)
SELECT unit, 1 AS round, 'c1' AS rule_id, 'seen' AS derived, ['click'] AS because FROM s WHERE c UNION ALL SELECT unit, 1, 'c3', 'seen', ['view_low'] FROM s WHERE l UNION ALL SELECT unit, 1, 'c7', 'always', [] FROM s
 UNION ALL SELECT unit, 2, 'c2', 'keen', ['seen', 'view'] FROM s WHERE seen AND v UNION ALL SELECT unit, 3, 'c4', 'buyer', ['keen'] FROM s WHERE seen AND v UNION ALL SELECT unit, 4, 'c5', 'click', ['buyer'] FROM s WHERE seen AND v AND NOT c
 UNION ALL SELECT unit, 5, 'c1', 'seen', ['click'] FROM s WHERE false""")
def rule_trace(spark, sf_dir):
    """Which rule gave which fact, in which round and from what."""
    return rules.infer_traced(_chain(spark), _unit_facts(spark, sf_dir))


@query(f"""WITH {_UNITS}, r AS (SELECT * FROM (VALUES ('c1', ['click'], 'seen'), ('c2', ['seen', 'view'], 'keen'), ('c3', ['view_low'], 'seen'), ('c4', ['keen'], 'buyer'), ('c5', ['buyer'], 'click'), ('c6', NULL, 'never'), ('c7', [], 'always')) v(rule_id, pre, post))
SELECT rule_id, unit, CASE WHEN pre IS NOT NULL AND list_has_all(f, pre) THEN 'pass' ELSE 'unknown' END AS status, CASE WHEN pre IS NOT NULL AND list_has_all(f, pre) THEN post END AS derived FROM u, r""")
def rule_applied(spark, sf_dir):
    """What each rule concludes by itself."""
    return rules.applied(_chain(spark), _unit_facts(spark, sf_dir))


@query("""WITH u AS (SELECT p_partkey AS unit, CASE p_partkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'odd' END AS tier, CASE p_partkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS level FROM part)
SELECT unit, rule_id FROM u JOIN (VALUES ('sql-injection', 2), ('check-then-act-race', 1), ('shell-command-injection', 0)) r(rule_id, of_rule) ON of_rule <= level""")
def rules_for_units(spark, sf_dir):
    """The rules that are worth running on each unit, by its tier."""
    k = F.col("p_partkey")
    tier = F.when(k % 4 == 0, "low").when(k % 4 == 1, "medium").when(k % 4 == 2, "high").otherwise("odd")
    return rules.rules_for_units(rules.security_rules(spark), A.table(spark, sf_dir, "part").select(k.alias("unit"), tier.alias("tier")))


_TREE = """k AS (SELECT p_partkey AS k, p_name AS name FROM part), files AS (SELECT 'd' || k % 7 || '/e' || k % 3 || '/f' || k || '.txt' AS path, name || chr(10) || k AS content FROM k UNION ALL SELECT 'top' || k || '.txt', name FROM k WHERE k % 5 = 0)"""


def _tree(spark, sf_dir):
    k = F.col("p_partkey")
    parts = A.table(spark, sf_dir, "part")
    low = parts.select(F.concat(F.lit("d"), k % 7, F.lit("/e"), k % 3, F.lit("/f"), k, F.lit(".txt")).alias("path"), F.concat("p_name", F.lit("\n"), k).cast("binary").alias("content"))
    return low.unionByName(parts.where("p_partkey % 5 = 0").select(F.concat(F.lit("top"), k, F.lit(".txt")).alias("path"), F.col("p_name").cast("binary").alias("content")))


@query(f"""WITH {_TREE}, steps AS (SELECT path, content, unnest(['', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS folder FROM files WHERE contains(path, '/') UNION ALL SELECT path, content, '' FROM files WHERE NOT contains(path, '/')),
rel AS (SELECT folder, CASE WHEN folder = '' THEN path ELSE substr(path, length(folder) + 2) END AS r, sha256(content) AS sha, octet_length(encode(content)) AS size FROM steps),
groups AS (SELECT folder, sha256(r)[:3] AS g, sha256(string_agg(r || chr(0) || sha || chr(10), '' ORDER BY r)) AS sha, count(*) AS n, sum(size) AS size FROM rel GROUP BY 1, 2)
SELECT folder, sum(n)::BIGINT AS files, sum(size)::BIGINT AS bytes, 'sha256:' || sha256(string_agg(g || ':' || sha || chr(10), '' ORDER BY g)) AS digest FROM groups GROUP BY 1""")
def tree_digest(spark, sf_dir):
    """A digest for every folder of a tree of small files."""
    return trees.tree_digests(_tree(spark, sf_dir))


@query("""WITH k AS (SELECT p_partkey AS k, 'f' || p_partkey || '.txt' AS p FROM part)
SELECT p AS path, 'changed' AS change, concat('diff --git a/', p, ' b/', p, chr(10), '--- a/', p, chr(10), '+++ b/', p, chr(10), '@@ -1,5 +1,6 @@', chr(10), ' a', chr(10), ' b', chr(10), '-c', k, chr(10), '+x', k, chr(10), ' d', chr(10), ' e', chr(10), '+end', chr(10), chr(92), ' No newline at end of file', chr(10)) AS diff FROM k WHERE k % 3 = 0
UNION ALL SELECT p, 'deleted', concat('diff --git a/', p, ' b/', p, chr(10), 'deleted file mode 100644', chr(10), '--- a/', p, chr(10), '+++ /dev/null', chr(10), '@@ -1,5 +0,0 @@', chr(10), '-a', chr(10), '-b', chr(10), '-c', k, chr(10), '-d', chr(10), '-e', chr(10)) FROM k WHERE k % 3 = 1
UNION ALL SELECT 'new/' || p, 'added', concat('diff --git a/new/', p, ' b/new/', p, chr(10), 'new file mode 100644', chr(10), '--- /dev/null', chr(10), '+++ b/new/', p, chr(10), '@@ -0,0 +1 @@', chr(10), '+', k, chr(10)) FROM k WHERE k % 4 = 0""")
def tree_changes(spark, sf_dir):
    """What changed between two versions of a tree: some files change in two places, some go, some come."""
    k, parts = F.col("p_partkey"), A.table(spark, sf_dir, "part")
    path = F.concat(F.lit("f"), k, F.lit(".txt"))
    body = lambda mark, end: F.concat(F.lit("a\nb\n"), F.lit(mark), k, F.lit("\nd\ne\n" + end)).cast("binary").alias("content")
    before = parts.select(path.alias("path"), body("c", ""))
    after = parts.where("p_partkey % 3 = 0").select(path.alias("path"), body("x", "end")).unionByName(parts.where("p_partkey % 3 = 2").select(path.alias("path"), body("c", "")))
    return trees.tree_diff(before, after.unionByName(parts.where("p_partkey % 4 = 0").select(F.concat(F.lit("new/"), path).alias("path"), F.concat(k.cast("string"), F.lit("\n")).cast("binary").alias("content"))))


_LAYERS = (("pkg0", "pkg1"), ("pkg0", "pkg2"), ("pkg1", "pkg2"), ("pkg3", "*"))


@query("""WITH k AS (SELECT p_partkey AS k, 'src/app/pkg' || p_partkey % 5 || '/m' || p_partkey || '.py' AS p FROM part), i AS (SELECT k, p, unnest([k * 3 % 50 + 1, k * 11 % 50 + 1]) AS n FROM k), pairs AS (SELECT DISTINCT i.p AS source, j.p AS target, 'pkg' || i.k % 5 AS a, 'pkg' || j.k % 5 AS b FROM i JOIN k j ON j.k = i.n)
SELECT source, target, a AS from_package, b AS to_package FROM pairs WHERE a <> b AND b <> 'pkg4' AND a <> 'pkg3' AND NOT (a = 'pkg0' AND b IN ('pkg1', 'pkg2')) AND NOT (a = 'pkg1' AND b = 'pkg2')""")
def architecture_findings(spark, sf_dir):
    """Imports between the packages of an application that its policy doesn't allow, from its sources."""
    k = F.col("p_partkey")
    module = lambda n: F.concat(F.lit("app.pkg"), (n % 5).cast("string"), F.lit(".m"), n.cast("string"))
    code = F.concat(F.lit("import "), module(k * 3 % 50 + 1), F.lit("\nfrom "), module(k * 11 % 50 + 1), F.lit(" import f\nimport os\n"))
    files = A.table(spark, sf_dir, "part").select(F.concat(F.lit("src/app/pkg"), (k % 5).cast("string"), F.lit("/m"), k.cast("string"), F.lit(".py")).alias("path"), code.alias("text"))
    parsed = saved(codegraph.parse(files, largest=None), "parsed")
    policy = spark.createDataFrame(_LAYERS, "package string, allowed string")
    return codegraph.policy_findings(*codegraph.code_graph(parsed), policy, "app", "pkg4")
