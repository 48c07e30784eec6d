"""Steps whose memory or shuffles must not grow faster than their input: no table that grows goes whole through the driver."""

import pytest
from pyspark.sql import functions as F

from quillspark import storage
from quillspark.operators import codegraph, graph
from quillspark.plans import registry
from quillspark.sources import adapters, repository

EDGE = "source string, target string, kind string"
FILES = [("a.py", "from b import g as h\ndef f():\n    h.g()\n    k()\n"), ("b.py", "def g():\n    return g()\n"), ("c.py", "class K:\n    def k(self):\n        self.k()\n        x.strip()\n")]


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


@pytest.fixture(scope="module")
def parsed(spark):
    return codegraph.parse(spark.createDataFrame(FILES, "path string, text string")).cache()


def test_references_are_resolved_without_broadcasts(parsed):
    found = codegraph.resolve(parsed)
    assert not broadcasts(found)
    assert {(r.qualname, r.target): r.target_id for r in found.collect()} == {("f", "h.g"): "function:b.py:g", ("f", "k"): "method:c.py:K.k", ("g", "g"): "function:b.py:g", ("K.k", "self.k"): "method:c.py:K.k", ("K.k", "x.strip"): None}


def test_names_that_very_many_ask_for_are_dealt_over_tasks(spark):
    one = "from b import g as h\ndef f{k}(x):\n    x.strip()\n    h.g()\n    only{k}()\n    other{k}()\n"
    files = [(f"a{k}.py", one.format(k=k)) for k in range(40)] + [("b.py", "def g():\n    pass\n"), ("c.py", "def strip():\n    pass\n")]
    files += [(f"d{k}.py", f"def only{k}():\n    pass\n") for k in range(40)]
    parsed = storage.saved(codegraph.parse(spark.createDataFrame(files, "path string, text string")), "parsed")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = codegraph.references(parsed).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    own = lambda target: [r for r in rows if r.target == target]
    for target, id in (("h.g", "function:b.py:g"), ("x.strip", "function:c.py:strip")):
        assert {r.target_id for r in own(target)} == {id} and len(own(target)) == 40 and len({r.part for r in own(target)}) > 1
    assert all(own(f"only{k}")[0].target_id == f"function:d{k}.py:only{k}" and own(f"other{k}")[0].target_id is None for k in range(40))


def test_frequent_rare_and_missing_keys(spark, monkeypatch):
    monkeypatch.setattr(storage, "FREQUENT_KEYS", 2)
    known = spark.createDataFrame([("hot", "H"), ("cold", "C"), ("rare", "R")], "key string, value string")
    rows = [("hot", None, "H", 0), (None, "hot", "H", 1), ("gone", "hot", "H", 1), ("gone", "cold", "C", 1), ("cold", "hot", "C", 0), ("lost", "rare", "R", 1), ("lost", None, None, None), (None, None, None, None), ("lost", "lost2", None, None), (None, "rare", "R", 1)]
    many = [(k, *r) for k in range(5) for r in rows[:4]] + [(9, *r) for r in rows]
    asked = spark.createDataFrame(many, "k int, a string, b string, found string, nth int")
    found = storage.first_known(asked.select("k", "a", "b"), known, ["a", "b"])
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, many))


def test_files_are_forgotten_without_broadcasts(spark, parsed):
    edges = codegraph.code_graph(parsed)[1].select("source", "target")
    nodes, left = repository.forget(codegraph.nodes_of(parsed), edges, spark.createDataFrame([("b.py",)], "path string"))
    assert not broadcasts(nodes) and not broadcasts(left)
    assert {r.path for r in nodes.collect()} == {"a.py", "c.py"} and not [r for r in left.collect() if r.target == "function:b.py:g" or r.source == "function:b.py:g"]


def test_cycles_and_walks_without_broadcasts(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls")], EDGE)
    rings = graph.cycles(edges, 3)
    assert not broadcasts(rings) and "Join" not in rings._jdf.queryExecution().executedPlan().toString()  # each length reads what the one before wrote
    assert [list(r.path) for r in rings.collect()] == [["a", "b", "c"]]
    assert not broadcasts(graph.reachable(edges, spark.createDataFrame([("a",)], "id string"), 2))


def test_impact_shuffles_only_what_touches_the_names(spark):
    nodes = spark.createDataFrame([("1", "part", "x"), ("2", "part", "y")], "id string, kind string, name string")
    edges = spark.createDataFrame([("s", "1", "calls"), ("s", "1", "calls"), ("t", "2", "tests"), ("u", "1", "contains")], EDGE)
    found = graph.impact(nodes, edges, spark.createDataFrame([("x",)], "wanted string"))
    assert [tuple(r) for r in found.collect()] == [("x", "s", "calls")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join")  # the join first, then the few pairs once


def test_orders_meet_their_lines_without_broadcasts(spark):
    assert not broadcasts(adapters.star_graph(spark, "/root/testdata/sf0.001")[1])


def test_resemblances_sort_nothing(spark):
    from quillspark.operators import ranking

    texts = spark.createDataFrame([(1, "a b"), (2, "c")], "query_id long, query string")
    records = spark.createDataFrame([(7, "a b"), (8, "b c d"), (9, "x")], "doc_id long, text string")
    found, ranked = ranking.resemblances(texts, records, threshold=0.0), ranking.bm25(texts, records)
    assert "_part" not in found._jdf.queryExecution().optimizedPlan().toString()  # no ranks
    assert {(r.query_id, r.doc_id) for r in found.collect()} == {(r.query_id, r.doc_id) for r in ranked.collect()} == {(1, 7), (1, 8), (2, 8)}
    assert "exchange hashpartitioning(query_id" not in ranking.bm25_scores(texts, records)._jdf.queryExecution().executedPlan().toString().lower()  # summed where a document's terms are


def test_look_ups_take_the_rarest_part_and_broadcast_no_nodes(spark):
    nodes = spark.createDataFrame([(f"id{k}", f"helper{k}", f"M.helper{k}") for k in range(1, 300)] + [("é", "Größe_1", None)], "id string, name string, qualname string")
    wanted = spark.createDataFrame([("elpe_123",), ("LPER77",), ("röß",), ("_",), ("M.helper5",), ("absent_123",)], "wanted string")
    found = graph.look_up(nodes, wanted, loose=3)
    assert not broadcasts(found)
    told = {}
    for r in found.collect():
        told.setdefault(r.wanted, []).append((r.place, r.id, r.tier))
    assert {k: sorted(v) for k, v in told.items()} == {
        "elpe_123": [(1, "id123", 2)], "LPER77": [(1, "id77", 2)], "röß": [(1, "é", 2)], "_": [(1, "é", 2), (2, "id1", 2), (3, "id2", 2)], "M.helper5": [(1, "id5", 1)],
    }


def test_a_name_of_very_many_nodes_is_numbered_in_several_tasks(spark):
    nodes = spark.createDataFrame([(f"id{k:03}", "Worker", f"M{k}.Worker") for k in range(400)] + [("z", "other", "Worker")], "id string, name string, qualname string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = graph.look_up(nodes, spark.createDataFrame([("Worker",), ("M7.Worker",)], "wanted string")).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    own = [r for r in found if r.wanted == "Worker"]
    assert sorted((r.place, r.id, r.tier) for r in own) == [(k + 1, f"id{k:03}", 0) for k in range(400)] and len({r.part for r in own}) > 1
    assert [(r.id, r.tier, r.place) for r in found if r.wanted != "Worker"] == [("id007", 1, 1)]


def test_a_task_sends_only_the_first_nodes_of_a_name(spark, monkeypatch):
    nodes = spark.createDataFrame([(f"id{k}", f"Helper{k}", f"M.Helper{k}") for k in range(2000)] + [("n", None, "M.Helper1"), ("q", "Helper10", None)], "id string, name string, qualname string").repartition(4)
    patterns = spark.createDataFrame([("elper_", "xxxxx_"), ("helper1", "xxxxxxx"), ("r_9", "x_x"), ("absent", "xxxxxx")], "pattern string, shape string")
    sent = graph._first_with(spark, patterns, ["xxxxx_", "xxxxxxx", "x_x"], 3)(nodes.select("id", "name", "qualname"))
    assert {r.pattern: r["count"] for r in sent.groupBy("pattern").count().collect()} == {"elper_": 12, "helper1": 12, "r_9": 12}
    monkeypatch.setattr(graph, "HELD", 2)  # handed on after each batch
    monkeypatch.setattr(graph, "SHAPES", 2)  # and most shapes are rare
    wanted = ["elper_", "ELPER1", "r_9", "_", "r1%9", "per_0"]
    found = {}
    for r in graph.look_up(nodes, spark.createDataFrame([(w,) for w in wanted], "wanted string"), loose=4).collect():
        found.setdefault(r.wanted, []).append((r.place, r.id, r.tier))
    first = lambda *ids: [(k + 1, i, 2) for k, i in enumerate(ids)]
    assert {w: sorted(x) for w, x in found.items()} == {
        "elper_": first("n", "id0", "id1", "id2"), "ELPER1": first("n", "id1", "id10", "q"), "r_9": first("id19", "id29", "id39", "id49"),
        "_": first("n", "id0", "id1", "id2"), "r1%9": first("id19", "id109", "id119", "id129"), "per_0": first("id10", "q", "id20", "id30"),
    }


def test_documents_of_one_source_are_dealt_over_tasks(spark, tmp_path):
    rows = [(k, f"text {k} " + "word " * (k % 7 * 100), None if k % 50 == 49 else "one") for k in range(200)]
    spark.createDataFrame(rows + [(1000, rows[3][1], "one")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = registry.queries()["compress_long_items"](spark, str(tmp_path)).withColumn("part", F.spark_partition_id()).collect()
        numbered = adapters.documents_context(spark, str(tmp_path)).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for source, ids in (("one", [*(k for k in range(200) if k % 50 != 49), 1000]), (None, [49, 99, 149, 199])):
        texts = {k: t for k, t, _ in rows} | {1000: rows[3][1]}
        assert sorted((r.pos, r.content) for r in numbered if r.context_id == source) == list(enumerate(texts[k] for k in ids))
        assert sorted(r.pos for r in found if r.context_id == source) == [i for i, k in enumerate(ids) if k != 1000]
    for dealt in (found, numbered):
        assert len({r.part for r in dealt if r.context_id == "one"}) > 1


@pytest.mark.parametrize("sent", [7, 6, 0], ids=["few queries", "few documents", "many of both"])
def test_pairs_are_summed_where_they_arise(spark, monkeypatch, sent):
    """Also where files look too large to be sent, as those of very many tasks do; and a task's sums are bounded."""
    from quillspark.operators import ranking

    texts = spark.createDataFrame([(1, "a b b"), (2, "c d e"), (3, "z")], "query_id long, query string")
    records = spark.createDataFrame([(7, "a b"), (8, "b c"), (9, "b e"), (10, None)], "doc_id long, text string")

    def rows(found):
        return {(r.query_id, r.doc_id): (round(r.similarity, 9), r.confidence) for r in found.collect()}

    expected = rows(ranking.resemblances(texts, records, threshold=0.0))
    assert set(expected) == {(1, 7), (1, 8), (1, 9), (2, 8), (2, 9)}
    monkeypatch.setattr(ranking, "TERMS_SENT", sent, raising=False)
    monkeypatch.setattr(ranking, "SUMS_A_TASK", 1, raising=False)
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ranking.resemblances(texts, records, threshold=0.0)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert rows(found) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    pairs = [line for line in plan.splitlines() if "Exchange hashpartitioning(query_id" in line and "doc_id" in line]
    dealt = [line for line in plan.splitlines() if "6), REPARTITION_BY_NUM" in line]  # six products, one for each task
    assert (len(pairs), len(dealt)) == ((0, 1) if sent else (1, 0))
