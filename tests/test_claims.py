import random
import re

import pytest

from quillspark.functions.paths import ABSOLUTE, OUTSIDE, normal_path
from quillspark.operators import claims, codegraph, graph
from quillspark.sources.keyed import KeyedTable

FILES = {
    "a.py": "import b\nimport lib.c\nclass Store:\n    def save(self):\n        self.load()\n        helper()\n        os.write_all()\n    def load(self): pass\n",
    "b.py": "def helper(): pass\nclass Cache(Store): pass\n",
    "lib/c.py": "from a import Store\ndef other():\n    Store()\n",
}


@pytest.fixture(scope="module")
def project(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, text string")
    return (*[x.cache() for x in codegraph.code_graph(codegraph.parse(files).cache())], files)


def checked(spark, text, *given, **more):
    return {(r.kind[0], r.subject, r.relation, r.target): r for r in claims.check(spark.createDataFrame([(1, text)], "text_id long, text string"), *given, **more).collect()}


def test_every_kind_of_claim(spark, project):
    text = (
        "`Store.save` calls `helper` and `Cache`. `save` never calls `Store.load`. `Cache` inherits from `Store`; `Store` inherits from `Nowhere`. `save` calls `write_all`, `other` calls `write_all`. "
        "`other` calls `a.py` and `b.py` and `no.py`. `a.py` imports `b.py`. `b.py` imports `a.py`. `b.py` never imports `a.py`. `x.py` imports `a.py`. `a.py` imports `x.py`. `save` imports `b.py`. `gone_now` calls `save`. "
        "See `Store.load`, `lo_d`, `Missing()`, `not_there`, `notThere`, `lib/`, `/lib/./c.py`, `lib/x.py` and `../a.py`."
    )
    found = checked(spark, text, *project)
    say = lambda *key: (found[key].status, found[key].confidence, list(found[key].evidence))
    assert say("s", "Store.save", "calls", "helper") == ("supported", 1.0, ["a.py:4"]) and say("s", "Store.save", "calls", "Cache") == ("contradicted", 0.9, [])
    assert say("s", "save", "calls", "Store.load") == ("contradicted", 1.0, ["a.py:4"]) and "denial is false" in found["s", "save", "calls", "Store.load"].explanation
    assert say("s", "Cache", "inherits", "Store") == ("supported", 1.0, ["b.py:2"]) and say("s", "Store", "inherits", "Nowhere")[:2] == ("contradicted", 1.0)
    assert say("s", "save", "calls", "write_all")[:2] == ("contradicted", 1.0)  # nothing of that name is defined
    assert say("s", "other", "calls", "a.py") == ("unverifiable", 0.0, []) and say("s", "other", "calls", "b.py")[:2] == ("contradicted", 0.9) and say("s", "other", "calls", "no.py")[:2] == ("contradicted", 1.0)
    assert say("s", "a.py", "imports", "b.py") == ("supported", 1.0, ["a.py"]) and say("s", "x.py", "imports", "a.py")[0] == say("s", "a.py", "imports", "x.py")[0] == "contradicted"
    assert say("s", "save", "imports", "b.py")[:2] == ("unverifiable", 0.0) and say("s", "gone_now", "calls", "save")[:2] == ("contradicted", 1.0)
    assert say("s", "Store.load", None, None) == ("supported", 1.0, ["a.py:8"]) and say("s", "lo_d", None, None) == ("supported", 1.0, ["a.py:8"])
    assert "local variable" in found["s", "not_there", None, None].explanation
    assert not any("local variable" in found["s", x, None, None].explanation for x in ("Missing", "notThere"))
    assert [say("f", x, None, None)[0] for x in ("lib/", "/lib/./c.py", "lib/x.py", "../a.py")] == ["supported", "supported", "contradicted", "contradicted"]


def test_what_is_not_given_is_unverifiable(spark, project):
    texts = spark.createDataFrame([(1, "`x_y` calls `z`, `a.py`, `b_c()`, `b_c()`"), (2, "nothing"), (3, None)], "text_id long, text string")
    rows = claims.check(texts).collect()
    assert len(rows) == 4 and {(r.status, r.confidence) for r in rows} == {("unverifiable", 0.0)}
    report = {r.text_id: r for r in claims.reports(texts, claims.check(texts), graph=False, memory=False).collect()}
    assert [report[i].claims_extracted for i in (1, 2, 3)] == [4, 0, 0] and report[2].degraded_reason.count(";") == 1
    assert claims.reports(texts, claims.check(texts, *project)).first().degraded_reason is None
    assert claims.check(texts.where("false"), *project).collect() == []


def test_memory_in_a_report_and_records_that_repeat(spark, project, tmp_path):
    texts = spark.createDataFrame([(1, "we cache the whole session table in memory"), (2, "`helper` is fine")], "text_id long, text string")
    decisions = spark.createDataFrame([(7, "cache the session table in memory", "it grew", "rejected"), (8, "cache the session table in memory", None, "active"), (9, "helper", "", "superseded")], "id long, statement string, detail string, status string")
    constraints = spark.createDataFrame([(5, "never cache the session table", True), (6, "never cache the session table", False)], "id long, statement string, hard boolean")
    checks = claims.check(texts, *project, decisions=decisions, constraints=constraints).cache()
    near = {(r.text_id, r.evidence[0]): r for r in checks.where("kind = 'decision_alignment'").collect()}
    assert set(near) >= {(1, "7"), (1, "5")} and (1, "8") not in near and (1, "6") not in near
    assert near[1, "7"].status == "contradicted" and near[1, "7"].confidence <= 0.85 and near[1, "7"].explanation == "resembles a rejected decision: 'cache the session table in memory' (it grew)"
    assert {r.text_id: (r.claims_extracted, r.resembled) for r in claims.reports(texts, checks).collect()}[1] == (0, 2)
    table = KeyedTable(str(tmp_path / "log"), "id", "id string, record_type string, surfaced_via string, record_ids array<bigint>, used boolean", 2)
    for _ in range(2):
        table.upsert(claims.resurfacings(checks))
    assert {tuple(r.record_ids) for r in table.read(spark).collect()} >= {(7,)} and table.read(spark).count() == claims.resurfacings(checks).count()


def test_look_ups_against_all_nodes(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abA_.%") for _ in range(rng.randint(1, 6)))
    nodes = sorted({(f"n{i:03}", name, rng.choice([name, f"{word()}.{name}"])) for i, name in enumerate(word().replace("%", "") or "x" for _ in range(200))})
    names = sorted({word() for _ in range(150)} | {"", "%", "\\", "zz"})

    def like(pattern, text):
        return re.fullmatch(".*" + "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern.lower()) + ".*", text.lower()) is not None

    expected = set()
    for w in names:
        hits = [(i, 0) for i, n, _ in nodes if n == w] or [(i, 1) for i, n, q in nodes if q == w]
        hits = hits or [(i, 2) for _, _, i in sorted((len(n), n, i) for i, n, q in nodes if like(w, n) or like(w, q))[:10]]
        expected |= {(w, i, t) for i, t in hits}
    frame = spark.createDataFrame(nodes, "id string, name string, qualname string")
    wanted = spark.createDataFrame([(w,) for w in names] + [(None,)], "wanted string")
    assert {(r.wanted, r.id, r.tier) for r in graph.look_up(frame, wanted).collect()} == expected
    found = {r.wanted: r.found for r in graph.known(frame, wanted.where("wanted IS NOT NULL")).collect()}
    for w in names:
        first = sorted((len(n), n, i, q) for i, n, q in nodes if like(w, n) or like(w, q))[:5]
        assert found[w] == (any(n == w for _, n, _ in nodes) or any(q.endswith(w) for *_, q in ([(0, 0, 0, q) for i, n, q in nodes if q == w][:5] or first)))


def test_paths_in_normal_form(spark):
    cases = {"a/b.py": ("a/b.py", None), "./a//b.py": ("a/b.py", None), "a/../b": ("b", None), "..": ("..", OUTSIDE), "a/../../b": ("a/../../b", OUTSIDE), "": ("", None), ".": ("", None), "/r/x/a.py": ("/r/x/a.py", ABSOLUTE), None: (None, None)}
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    assert {r.p: (r.n and r.n.path, r.n and r.n.note) for r in df.select("p", normal_path(df.p).alias("n")).collect()} == cases
    rooted = {"/r/x/a.py": ("a.py", None), "/r/x/../y/a.py": ("/r/x/../y/a.py", OUTSIDE), "/r//x/./b/../c.py": ("c.py", None), "/r/xy/a.py": ("/r/xy/a.py", OUTSIDE), "/../r/x/a": ("a", None), "/r/x": ("", None), "b": ("b", None), "/r": ("/r", OUTSIDE)}
    df = spark.createDataFrame([(c,) for c in rooted], "p string")
    assert {r.p: tuple(r.n) for r in df.select("p", normal_path(df.p, "/r/x/").alias("n")).collect()} == rooted
    assert tuple(df.select(normal_path(df.p, "/").alias("n")).first().n) == ("r/x/a.py", None)


def test_risk_says_why_it_knows_nothing(spark, project):
    nodes, edges, _ = project
    paths = spark.createDataFrame([("a.py",), ("./a.py",), ("/repo/a.py",), ("auth/x.py",), (None,), ("lib/c.py",)], "path string")
    found = {r.unit: (r.tier, list(r.reasons), r.note) for r in codegraph.file_risk(nodes, edges, paths).collect()}
    assert found == {"a.py": ("medium", ["untested"], None), "./a.py": ("medium", ["untested"], None), "/repo/a.py": ("low", [], ABSOLUTE), "auth/x.py": ("high", ["path:auth"], "not in the graph"), "lib/c.py": ("medium", ["untested"], None)}
