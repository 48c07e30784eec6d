import random
from collections import deque

import pytest

from quillspark.operators import claims, codegraph, graph, ranking, rules

EDGE, NODE = "source string, target string, kind string", "id string, kind string, name string"


def edges_of(spark, pairs, kind="calls"):
    return spark.createDataFrame([(*p, kind) for p in pairs], EDGE)


def test_reachable_is_breadth_first(spark):
    rng = random.Random(1)
    pairs = sorted({(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(45)})
    starts = ["n0", "n1", "n2"]
    for direction in ("out", "in", "both"):
        hops = {}
        for a, b in pairs:
            if direction != "in":
                hops.setdefault(a, set()).add(b)
            if direction != "out":
                hops.setdefault(b, set()).add(a)
        expected = set()
        for start in starts:
            depth, todo = {start: 0}, deque([start])
            while todo:
                x = todo.popleft()
                for y in hops.get(x, ()) if depth[x] < 3 else ():
                    if y not in depth:
                        depth[y] = depth[x] + 1
                        todo.append(y)
            expected |= {(start, y, d) for y, d in depth.items() if d}
        found = graph.reachable(edges_of(spark, pairs), spark.createDataFrame([(s,) for s in starts], "id string"), 3, direction=direction)
        assert {tuple(r) for r in found.select("start", "id", "depth").collect()} == expected


def test_cycles_come_once(spark):
    found = graph.cycles(edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("d", "d"), ("c", "d")]), 4)
    assert sorted(tuple(r.path) for r in found.collect()) == [("a", "b"), ("a", "b", "c"), ("d",)]


def test_untested_links_and_orphans(spark):
    nodes = spark.createDataFrame([("t", "test", "test_it"), ("f", "function", "run"), ("g", "function", "_hidden"), ("h", "function", "other"), ("x", "external", "os")], NODE)
    edges = edges_of(spark, [("t", "f"), ("f", "h"), ("t", "t")])
    tests = graph.link_tests(nodes, edges)
    assert [tuple(r) for r in tests.collect()] == [("t", "f", "tests")]
    assert [r.id for r in graph.untested(nodes, edges.unionByName(tests), ("function",)).collect()] == ["h"]
    assert [r.id for r in graph.orphans(nodes, edges, "external").collect()] == ["x"]


def test_lookups_by_tier(spark):
    nodes = spark.createDataFrame([("1", "class", "Store"), ("2", "class", "StoreKeeper"), ("3", "class", "Base")], NODE)
    wanted = spark.createDataFrame([("Store",), ("keeper",), ("nope",)], "wanted string")
    assert sorted((r.wanted, r.id, r.tier) for r in graph.define(nodes, wanted).collect()) == [("Store", "1", 0), ("keeper", "2", 1)]
    assert [(r.wanted, r.id) for r in graph.define(nodes, wanted, strict=True).collect()] == [("Store", "1")]


def test_seeds_pass_scores_on_in_rank_order(spark):
    nodes = spark.createDataFrame([("a", "class", "a", "parse json parse json"), ("b", "class", "b", "parse xml other words"), ("c", "class", "c", "unrelated")], NODE + ", text string")
    found = {r.id: (r.score, r.depth) for r in graph.context_for(nodes, edges_of(spark, [("a", "b"), ("b", "c")]), "parse json").collect()}
    second = found["b"][0]
    assert found["a"][1] == 0 and found["c"] == (pytest.approx(1.0 * 0.16 + second * 0.4), 2)  # the first seed reaches it in two
    assert found["a"][0] == pytest.approx(1.0 + second * 0.4)


def test_claims_of_a_text():
    text = "The `Store` class inherits from `Base`. `run` calls `a/b.py` and `helper`, but `run` does not call `kill`. See `x.py`, `some words` and `Thing()`."
    assert claims.claims_in(text) == [
        ("symbol_relation", "run", "calls", "kill", True), ("symbol_relation", "Store", "inherits", "Base", False), ("symbol_relation", "run", "calls", "a/b.py", False),
        ("symbol_relation", "run", "calls", "helper", False), ("file_exists", "x.py", None, None, False), ("symbol_exists", "Thing", None, None, False),
    ]
    assert claims.claims_in("") == []


def test_shapes_and_odd_quotes():
    kinds = lambda text: [(x[0], x[1]) for x in claims.claims_in(text)]
    assert kinds("Set `true` and run `make`, then `run_all`, `f()`, `a.b`, `aB`, `Word`, `1x_y`") == [("symbol_exists", x) for x in ("run_all", "f", "a.b", "aB")]
    assert kinds("`a.rb` `x.ini` `db.sql` `dir/` `B.MD`") == [("file_exists", "a.rb"), ("file_exists", "x.ini"), ("symbol_exists", "db.sql"), ("file_exists", "dir/"), ("file_exists", "B.MD")]
    relations = lambda text: [x[1:] for x in claims.claims_in(text) if x[0] == "symbol_relation"]
    assert relations("it`s `a` calls `b`") == [("a", "calls", "b", False)]
    assert relations("`a` calls `b` calls `c` calls `d`") == [("a", "calls", "b", False), ("c", "calls", "d", False)]
    assert relations("`a` calls `b` and `c` calls `d`") == [("a", "calls", "b", False), ("a", "calls", "c", False), ("c", "calls", "d", False)]
    assert relations("`a` never calls `b` calls `c`") == [("a", "calls", "b", True), ("b", "calls", "c", False)]
    assert relations("`A`class Extends `B`; `a` calls`b`; `a b` calls `c`; `a` calls `b c`") == [("A", "inherits", "B", False)]
    assert kinds("``x_y`` and `` and `z_z") == [("symbol_exists", "x_y")]


def test_verdicts(spark):
    said = "`f` calls `g`. `f` never calls `h`. `f` calls `k`. `q_q` calls `g`. `f` calls `z`. `./b/../a.py`. `../a.py`. `f` calls `b.py`. `f` calls `c.py`. `f` calls `no.py`. `a.py` imports `b.py`. `a.py` never imports `c.py`. `no.py` imports `b.py`. `f` imports `b.py`. `f` calls `nowhere`."
    found = claims.verdicts(
        claims.extract(spark.createDataFrame([(1, said)], "text_id long, text string")),
        spark.createDataFrame([(x, "a.py") for x in "fghkz"], "name string, path string"),
        spark.createDataFrame([("f", "g", "calls", True), ("f", "h", "calls", True), ("f", "mod.k", "calls", False)], EDGE + ", resolved boolean"),
        spark.createDataFrame([("a.py",), ("b.py",), ("c.py",)], "path string"),
        spark.createDataFrame([("a.py", "b.py")], "source string, target string"),
    )
    assert {(r.subject, r.relation, r.target): (r.status, r.confidence) for r in found.collect()} == {
        ("f", "calls", "g"): ("supported", 1.0), ("f", "calls", "h"): ("contradicted", 1.0), ("f", "calls", "k"): ("unverifiable", 0.0), ("q_q", "calls", "g"): ("contradicted", 1.0),
        ("f", "calls", "z"): ("contradicted", 0.9), ("./b/../a.py", None, None): ("supported", 1.0), ("../a.py", None, None): ("contradicted", 1.0), ("f", "calls", "b.py"): ("unverifiable", 0.0),
        ("f", "calls", "c.py"): ("contradicted", 0.9), ("f", "calls", "no.py"): ("contradicted", 1.0), ("a.py", "imports", "b.py"): ("supported", 1.0), ("a.py", "imports", "c.py"): ("supported", 1.0),
        ("no.py", "imports", "b.py"): ("contradicted", 1.0), ("f", "imports", "b.py"): ("unverifiable", 0.0), ("f", "calls", "nowhere"): ("contradicted", 1.0),
    }


def test_sources_to_graph_and_facts(spark):
    code = "import os\nfrom a import b\nclass K(Base):\n    def m(self):\n        helper(1)\n        os.remove('x')\ndef helper(x):\n    return K()\nprint(1)\n"
    unsafe = "def q(db, x):\n    s = 'select ' + x\n    db.execute(s)\n    subprocess.run(x, shell=True)\n"
    files = [("m.py", code), ("tests/test_m.py", "def test_it():\n    helper(2)\n"), ("bad.py", "def ("), ("big.py", "x" * 1_000_001), ("u.py", unsafe), ("none.py", None)]
    parsed = codegraph.parse(spark.createDataFrame(files, "path string, text string"))
    assert {(r.path, r.kind) for r in parsed.where("row = 'skipped'").collect()} == {("bad.py", "syntax"), ("big.py", "too large")}
    assert {r.id for r in codegraph.nodes_of(parsed).collect()} == {"class:m.py:K", "method:m.py:K.m", "function:m.py:helper", "test:tests/test_m.py:test_it", "function:u.py:q"}
    links = {(r.qualname, r.target): r.target_id for r in codegraph.resolve(parsed).collect()}
    assert links["test_it", "helper"] == links["K.m", "helper"] == "function:m.py:helper" and links["K", "Base"] is None and links["helper", "K"] == "class:m.py:K"
    assert {r.unit: r.facts for r in codegraph.facts(parsed).collect()} == {"u.py": ["dynamic_shell", "dynamic_sql"]}


def test_rules(spark):
    parsed = rules.parse_rules(spark.createDataFrame([("a", "PRE: x, y; POST: z"), ("b", "PRE: ; POST: w"), ("c", "PRE: z; POST: v")], "id string, formal_spec string"))
    facts = spark.createDataFrame([("u", ["x", "y"]), ("n", [])], "unit string, facts array<string>")
    assert {(r.rule_id, r.unit): r.status for r in rules.violations(parsed, facts).collect()} == {("a", "u"): "fail", ("a", "n"): "unknown", ("b", "u"): "fail", ("b", "n"): "fail", ("c", "u"): "unknown", ("c", "n"): "unknown"}
    assert {r.unit: r.facts for r in rules.infer(parsed, facts).collect()} == {"u": ["v", "w", "x", "y", "z"], "n": ["w"]}


def test_risk(spark):
    units = spark.createDataFrame([("a", "auth", 0, 0, 0), ("b", None, 3, 1, 0), ("c", None, 2, 1, 0), ("d", None, 0, 0, 2)], "unit string, path_marker string, callers int, fan_in int, untested int")
    assert {r.unit: r.tier for r in rules.risk_tier(units).collect()} == {"a": "high", "b": "medium", "c": "low", "d": "medium"}


def test_updates_with_and_without_a_lock(spark):
    bare = "def f(c, k):\n    if k not in c:\n        c[k] = 1\n"
    locked = "def f(self, c, k):\n    with self._lock:\n        if c.get(k) is None:\n            c[k] = 1\n"
    other = "def f(c, d, k):\n    if k in c:\n        d[k] = 1\n"
    parsed = codegraph.parse(spark.createDataFrame([("a.py", bare), ("b.py", locked), ("c.py", other)], "path string, text string"))
    assert {r.unit: r.facts for r in codegraph.facts(parsed).collect()} == {"a.py": ["check_then_set"], "b.py": ["guarded_check_then_set"]}


def test_imports_name_files(spark):
    files = [("src/a/__init__.py", "from .b import x\nfrom . import c\n"), ("src/a/b.py", "from ..d import y\nimport os, a.c\nfrom .c import z\n"), ("src/a/c.py", "from a import b\n"), ("d.py", "import a\nfrom ... import q\n"), ("notes.txt", "import")]
    df = spark.createDataFrame(files, "path string, text string")
    resolved = codegraph.resolve_imports(codegraph.parse(df), df)
    assert {(r.path, r.target): r.target_path for r in resolved.collect()} == {
        ("src/a/__init__.py", ".b.x"): "src/a/b.py", ("src/a/__init__.py", ".c"): "src/a/c.py", ("src/a/b.py", "..d.y"): "d.py", ("src/a/b.py", "os"): None, ("src/a/b.py", "a.c"): "src/a/c.py",
        ("src/a/b.py", ".c.z"): "src/a/c.py", ("src/a/c.py", "a.b"): "src/a/b.py", ("d.py", "a"): "src/a/__init__.py", ("d.py", "...q"): None,
    }
    assert ("src/a/b.py", "src/a/c.py") in {tuple(r.path) for r in graph.cycles(codegraph.file_edges(resolved), 2).collect()}


PROJECT = [
    ("src/c.py", "def run(self):\n    pass\nclass A:\n    def run(self): pass\nclass B(A):\n    def run(self): pass\ndef use(x):\n    B.run(x)\n    run(x)\n    x.stop()\n    later()\n    both()\n    o.g()\n    made()\n    f()()\n"),
    ("src/d.py", 'import os.path as o\nfrom c import use as f\nfrom . import e\nfrom pkg.gone import made\nclass K:\n    """Doc."""\n    class Inner(list, meta.Base): pass\n    async def stop(self, a, /, b: int = 3, *c, d: "str" = 1, **e) -> None:\n        """Stops."""\n        def deep(): f(1)\n        return deep\ndef both(): f(2)\n'),
    ("tests/test_d.py", "from d import both\ndef test_one():\n    both(); both()\n    test_two()\ndef test_two(): helper()\ndef helper(): pass\ndef both_(): both()\n"),
    ("pkg/__init__.py", "def both(): pass\n"),
    ("src/e.py", "def twice(): pass\ndef twice(a): pass\n"),
    ("bad.py", "def ("),
]


def test_the_narrowest_scope_decides(spark):
    parsed = codegraph.parse(spark.createDataFrame(PROJECT, "path string, text string"))
    found = {(r.source.partition(":")[2], r.kind, r.target, r.line): (r.target_id, r.step) for r in codegraph.references(parsed).collect()}
    use = "src/c.py:use"
    assert found[use, "calls", "B.run", 8] == ("method:src/c.py:B.run", 1)
    assert found[use, "calls", "run", 9] == ("function:src/c.py:run", 1)  # a full name, though A.run is also called run
    assert found[use, "calls", "x.stop", 10] == ("method:src/d.py:K.stop", 4)
    assert found[use, "calls", "later", 11] == found[use, "calls", "both", 12] == found[use, "calls", "o.g", 13] == (None, None)
    assert found[use, "calls", "f", 15] == (None, None)  # bound in another file
    assert found["src/c.py:B", "inherits", "A", 5] == ("class:src/c.py:A", 1)
    assert found["src/d.py:K.stop.deep", "calls", "f", 10] == found["src/d.py:both", "calls", "f", 12] == ("function:src/c.py:use", 3)
    assert found["src/d.py:K.Inner", "inherits", "meta.Base", 7] == (None, None)
    assert found["tests/test_d.py:test_one", "calls", "both", 3] == (None, None)  # two files define it


def test_the_whole_graph_of_a_project(spark):
    nodes, edges = codegraph.code_graph(codegraph.parse(spark.createDataFrame(PROJECT, "path string, text string")).cache())
    found = {r.id: r for r in nodes.collect()}
    assert len(found) == nodes.count()
    stop = found["method:src/d.py:K.stop"]
    assert (stop.signature, stop.docstring, stop.is_async, stop.line, stop.end_line) == ("stop(self, a, b: int, *c, d: 'str', **e) -> None", "Stops.", True, 8, 11)
    assert found["class:src/d.py:K.Inner"].signature == "class Inner(list, meta.Base)" and found["class:src/d.py:K"].docstring == "Doc."
    assert (found["function:src/e.py:twice"].signature, found["function:src/e.py:twice"].line) == ("twice(a)", 2)
    assert {i for i in found if i.startswith("external:")} == {"external:os.path"}
    assert found["file:pkg/__init__.py"].qualname == "pkg" and "file:bad.py" not in found
    links = {(r.source, r.target, r.kind): (r.resolved, r.line) for r in edges.collect()}
    assert links["file:src/d.py", "file:src/c.py", "imports"] == (True, 2) and links["file:src/d.py", "file:src/e.py", "imports"] == (True, 3)
    assert links["file:src/d.py", "file:pkg/__init__.py", "imports"] == (True, 4) and links["file:src/d.py", "external:os.path", "imports"] == (False, 1)
    assert links["file:src/d.py", "class:src/d.py:K.Inner", "contains"] == (True, None) == links["class:src/d.py:K", "method:src/d.py:K.stop", "contains"]
    assert ("class:src/d.py:K.stop", "method:src/d.py:K.stop.deep", "contains") in links
    assert links["function:src/c.py:use", "later", "calls"] == (False, 11)
    assert {k[:2] for k in links if k[2] == "tests"} == {("test:tests/test_d.py:test_two", "function:tests/test_d.py:helper")}


def test_depth_of_a_tree_and_size_in_bytes(spark):
    deep = "x = " + "(" * 90 + "1" + ")" * 90 + "\n" + "\n".join("    " * i + f"def f{i}():" for i in range(30)) + "\n" + "    " * 30 + "f0()"
    files = [("deep.py", deep), ("sum.py", "x = " + "+".join(["1"] * 5000)), ("bytes.py", "#" + "ü" * 600_000), ("odd.py", "def f(:\n")]
    parsed = codegraph.parse(spark.createDataFrame(files, "path string, text string")).cache()
    assert {(r.path, r.kind) for r in parsed.where("row = 'skipped'").collect()} - {("sum.py", "syntax")} == {("bytes.py", "too large"), ("odd.py", "syntax")}
    assert parsed.where("row = 'edge' AND kind = 'calls' AND path = 'deep.py'").first().qualname == ".".join(f"f{i}" for i in range(30))


def test_contexts_against_a_plain_fold(spark):
    rng = random.Random(3)
    words = "parse json store graph node edge walk".split()
    nodes = [(f"n{i:02}", f"name{i}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 5))), i % 7 != 3) for i in range(40)]
    pairs = sorted({(f"n{rng.randrange(40):02}", f"n{rng.randrange(44):02}", rng.choice(["calls", "contains", "tests", "inherits"])) for _ in range(60)})
    tasks = [(1, "parse json"), (2, "walk the graph walk"), (3, "nothing of this"), (4, "")]
    frame = spark.createDataFrame(nodes, "id string, name string, text string, wanted boolean")
    asked = spark.createDataFrame(tasks, "task_id int, task string")
    found = {}
    for r in graph.contexts_for(frame, spark.createDataFrame(pairs, EDGE), asked, 12, 2).collect():
        found.setdefault(r.task_id, {})[r.id] = (round(r.score, 9), r.depth, list(r.reasons))
    name, hops = {n[0]: n[1] for n in nodes}, {}
    for a, b, _ in pairs:
        if a in name and b in name:
            hops.setdefault(a, set()).add(b)
            hops.setdefault(b, set()).add(a)
    verbs = {"contains": ("contains", "contained in"), "inherits": ("inherits from", "base of"), "calls": ("calls", "called by"), "tests": ("tests", "tested by")}

    def reason(seed, other):
        for k, way in ((0, (other, seed)), (1, (seed, other))):
            for kind, said in verbs.items():
                if (*way, kind) in pairs:
                    return f"{said[k]} {name[seed]}"
        return f"reachable from {name[seed]}"

    ranked = ranking.bm25(asked.selectExpr("task_id AS query_id", "task AS query"), frame.where("wanted").selectExpr("id AS doc_id", "text")).collect()
    expected = {}
    for task, text in tasks:
        seeds = sorted((r.rank, r.doc_id, r.score) for r in ranked if r.query_id == task)[:6]
        state = {i: [s / max(x[2] for x in seeds), 0, [f"matches '{text}' (rank {rank})"]] for rank, i, s in seeds}
        for _, seed, _ in seeds:
            depth, todo = {seed: 0}, deque([seed])
            while todo:
                x = todo.popleft()
                for y in sorted(hops.get(x, ())) if depth[x] < 2 else ():
                    if y not in depth:
                        depth[y] = depth[x] + 1
                        todo.append(y)
            given = state[seed][0]
            for i, d in depth.items():
                if d and nodes[int(i[1:])][3]:
                    mine = state.setdefault(i, [0.0, d, []])
                    mine[0] += given * 0.4**d
                    if reason(seed, i) not in mine[2]:
                        mine[2].append(reason(seed, i))
        best = sorted(state.items(), key=lambda x: (-round(x[1][0], 9), x[0]))[:12]
        if best:
            expected[task] = {i: (round(s, 9), d, why) for i, (s, d, why) in best}
    assert found == expected and set(found) == {1, 2}


def test_rules_without_a_trigger_and_traces(spark):
    parsed = rules.parse_rules(spark.createDataFrame([("a", "POST: z"), ("b", "PRE: x; POST: y"), ("c", "PRE: y; POST: z"), ("d", "PRE: x; POST: "), ("e", None), ("f", "PRE: x, w; POST: y")], "id string, formal_spec string"))
    facts = spark.createDataFrame([("u", ["x", "w"]), ("n", [])], "unit string, facts array<string>")
    assert {r.rule_id for r in rules.applied(parsed, facts).where("status = 'pass'").collect()} == {"b", "f"}
    trace = sorted((r.unit, r.round, r.rule_id, r.derived, list(r.because)) for r in rules.infer_traced(parsed, facts).collect())
    assert trace == [("u", 1, "b", "y", ["x"]), ("u", 1, "f", "y", ["x", "w"]), ("u", 2, "c", "z", ["y"])]
    assert rules.infer_traced(parsed, facts, rounds=1).count() == 2 and {r.unit: r.facts for r in rules.infer(parsed, facts).collect()} == {"u": ["w", "x", "y", "z"], "n": []}
    assert {r.status for r in rules.violations(parsed, facts).where("rule_id = 'a'").collect()} == {"unknown"}


def facts_in(code):
    import ast

    out = []
    codegraph._facts("f.py", ast.parse(code), out)
    return [(r["kind"], r["name"], r["line"]) for r in out]


def test_facts_show_where(spark):
    head = "def f(c, d, k, db):\n"
    assert facts_in(head + "    if k in c: return\n    c[k] = 1\n") == [("check_then_set", "", 2)]
    assert facts_in(head + "    with self.lock_all():\n        if c.get(k): pass\n    for x in d:\n        c[k] = 1\n") == [("guarded_check_then_set", "", 3)]
    assert facts_in(head + "    if k in c: d[k] = 1\n    if k in self.c: self.c[k] = 2\n") == [] == facts_in("if k in c: c[k] = 1")
    assert facts_in(head + "    try:\n        if k not in c: pass\n    except E:\n        c[k] = 1\n    finally:\n        d[k] = 2\n") == [("check_then_set", "", 3)]
    assert facts_in(head + "    s = 'a' + k\n    s = 'b'\n    db.execute(s)\n    db.execute('a %s' % k)\n    execute(f'{k}')\n    db.executed(f'{k}')\n") == [("dynamic_sql", "percent", 5)]
    assert facts_in(head + "    db.executescript('{}'.format(k))\n    db.execute('x ?', (k,))\n    db.execute('x ?')\n") == [("dynamic_sql", "format", 2), ("parameterised_sql", "", 3)]
    assert facts_in(head + "    p.run(k, shell=True)\n    p.call(args=f'{k}', shell=True)\n    p.run('ls', shell=True)\n    p.Popen([k])\n    p.run(self.c, shell=True)\n") == [("dynamic_shell", "f-string", 3), ("dynamic_shell", "variable", 2), ("listed_command", "", 5)]
