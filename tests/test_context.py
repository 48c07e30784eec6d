import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import context, health

SCHEMA = "context_id int, pos long, kind string, content string"
PLANNED = "context_id int, pos long, original_index long, relevance string, rank_score double, token_count long"


def kept(df):
    return sorted((r.context_id, r.pos) for r in df.collect())


def classified(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.pos: (r.relevance, r.relevance_reason) for r in context.classify(context.measure(df)).collect()}


def test_the_cascade_in_its_order(spark):
    rows = [
        (1, 0, "system", "be nice"), (1, 1, "user_message", "Decision: keep"), (1, 2, "agent_message", "costs $5"), (1, 3, "memory", "note"),
        (1, 4, "agent_message", "this was reverted"), (1, 5, "agent_message", "hello there"), (1, 6, "agent_message", "hello  there"), (1, 7, "tool_output", "ok"),
        (1, 8, "user_message", "Decision:  keep"),
    ]
    assert [x[0] for _, x in sorted(classified(spark, rows).items())] == ["critical"] * 4 + ["obsolete", "relevant", "redundant", "irrelevant", "critical"]


def test_recency_needs_more_than_ten_items(spark):
    rows = lambda n: [(1, i, "user_message", f"text number {i}") for i in range(n)]
    assert all(r == "relevant" for r, _ in classified(spark, rows(10)).values())
    found = classified(spark, rows(40))
    assert [i for i in range(40) if found[i][0] == "critical"] == [36, 37, 38, 39]


def greedy(items, budget):
    """The plan as a loop: drop the first candidate until the rest fits."""
    order = {"irrelevant": 0, "obsolete": 1, "redundant": 2, "relevant": 3}
    left, total = dict((i["pos"], i) for i in items), sum(i["token_count"] for i in items)
    for i in sorted((i for i in items if i["relevance"] in order), key=lambda i: (order[i["relevance"]], i["rank_score"], -i["original_index"])):
        if total <= budget:
            break
        total -= i["token_count"]
        del left[i["pos"]]
    return set(left)


def test_budget_is_the_greedy_loop(spark):
    rng = random.Random(4)
    contexts = {c: [dict(context_id=c, pos=p, original_index=p, relevance=rng.choice(context.BUCKETS), rank_score=float(rng.randint(0, 3)), token_count=rng.randint(0, 30)) for p in range(rng.randint(1, 25))] for c in range(60)}
    df = spark.createDataFrame([i for items in contexts.values() for i in items], PLANNED)
    for budget in (0, 60, 200):
        expected = sorted((c, p) for c, items in contexts.items() for p in greedy(items, budget))
        found = context.enforce_budget(df, budget)
        assert kept(found) == expected
        assert found.where("relevance = 'critical'").count() == df.where("relevance = 'critical'").count()


def test_placement_is_the_split_of_the_critical(spark):
    rng = random.Random(5)
    contexts = {c: [(c, p, p, rng.choice(["critical", "relevant"]), 0.0, 1) for p in range(rng.randint(1, 12))] for c in range(50)}
    df = spark.createDataFrame([r for rows in contexts.values() for r in rows], PLANNED)
    found = {}
    for r in context.place(df).orderBy("context_id", "placed").collect():
        found.setdefault(r.context_id, []).append(r.pos)
    for c, rows in contexts.items():
        critical, rest = [r[1] for r in rows if r[3] == "critical"], [r[1] for r in rows if r[3] != "critical"]
        half = (len(critical) + 1) // 2
        assert found[c] == critical[:half] + rest + critical[half:]


def conversation():
    rows = [(1, i, random.Random(i).choice(["tool_output", "user_message", "agent_message"]), f"item {i % 9} " + "word " * (i * 40 % 700)) for i in range(30)]
    return rows + [(2, 0, "tool_output", "x" * 5000), (2, 1, "user_message", "costs $9")]


@pytest.mark.parametrize("budget", [None, 500])
def test_ledger_chains_and_ends_where_the_pipeline_does(spark, budget):
    items = spark.createDataFrame(conversation(), SCHEMA)
    rows = sorted(context.ledger(items, budget=budget).collect(), key=lambda r: (r.context_id, r.stage_no))
    assert len([r for r in rows if r.context_id == 1]) == (6 if budget else 5)
    for a, b in zip(rows, rows[1:]):
        if a.context_id == b.context_id:
            assert (a.items_after, a.tokens_after) == (b.items_before, b.tokens_before)
    end = {r.context_id: (r.n, r.t) for r in context.run(items, budget=budget).groupBy("context_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("t")).collect()}
    assert {r.context_id: (r.items_after, r.tokens_after) for r in rows if r.stage == "place"} == end


def test_compression_keeps_head_and_tail(spark):
    items = context.classify(context.measure(spark.createDataFrame([(1, 0, "tool_output", "a" * 1200 + "b" * 1000 + "c" * 600)], SCHEMA)))
    (row,) = context.compress(items).collect()
    assert row.content == "a" * 1200 + "\n\n[... 1,000 characters elided by quillspark ...]\n\n" + "c" * 600


def test_retention(spark):
    items = context.classify(context.dedup(context.measure(spark.createDataFrame(conversation(), SCHEMA))))
    after = context.run(spark.createDataFrame(conversation(), SCHEMA), budget=0)
    assert {r.critical_retention for r in health.critical_retention(items, after).collect()} == {1.0}
    none = health.critical_retention(items, after.limit(0)).orderBy("context_id").collect()
    assert [r.critical_retention for r in none] == [0.0, 0.0]
    assert {r.digit_retention for r in health.digit_retention(items, after).collect()} == {1.0}


def test_tail_truncation_keeps_the_newest(spark):
    df = spark.createDataFrame([(1, p, p, "relevant", 0.0, t) for p, t in enumerate([5, 5, 50, 5])], PLANNED)
    assert kept(context.tail_truncate(df, 10)) == [(1, 3)] and kept(context.tail_truncate(df, 1)) == [(1, 3)] and kept(context.tail_truncate(df, 60)) == [(1, 1), (1, 2), (1, 3)]


def test_breakdown_has_all_buckets(spark):
    items = context.classify(context.measure(spark.createDataFrame([(1, 0, "user_message", "plain words")], SCHEMA)))
    assert context.breakdown(items).collect()[0].asDict() == {"context_id": 1, "critical": 0, "relevant": 3, "redundant": 0, "obsolete": 0, "irrelevant": 0}


def test_ranked_items_survive_and_the_ledger_has_a_rank_stage(spark):
    from quillspark.operators import ranking

    rows = [(1, i, "agent_message", f"plain item number{i}" + (" about parsers" if i == 2 else "")) for i in range(8)]
    items = spark.createDataFrame(rows, SCHEMA)
    scores = ranking.score_items(items, "parsers")
    assert [(r.context_id, r.pos) for r in scores.collect()] == [(1, 2)]
    assert 2 in {r.pos for r in context.run(items, scores, 8).collect()} and 2 not in {r.pos for r in context.run(items, None, 8).collect()}
    stages = [r.stage for r in context.ledger(items, scores, 8).orderBy("stage_no").collect()]
    assert stages == ["dedup", "classify", "rank", "filter_tool_output", "compress", "budget", "place"]
    assert ranking.score_items(items, "").collect() == []
