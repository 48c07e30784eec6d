import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillspark.operators import ranking


def model(query, docs):
    """BM25 as a loop."""
    split = {i: re.findall("[a-z0-9]+", t.lower()) for i, t in docs}
    mean = sum(map(len, split.values())) / len(split)
    out = {}
    for i, words in split.items():
        tf, s = Counter(words), 0.0
        for q in re.findall("[a-z0-9]+", query.lower()):
            df = sum(q in w for w in split.values())
            if tf[q]:
                s += math.log(1 + (len(split) - df + 0.5) / (df + 0.5)) * tf[q] * 2.5 / (tf[q] + 1.5 * (0.25 + 0.75 * len(words) / mean))
        if s > 0:
            out[i] = s
    return out


def test_bm25_against_a_loop(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(rng.randint(0, 20)))) for i in range(60)]
    queries = [(0, "alpha alpha zeta"), (1, "nothing"), (2, "Beta, delta!")]
    found = ranking.bm25(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(docs, "doc_id int, text string")).collect()
    for q, text in queries:
        expected = model(text, docs)
        mine = {r.doc_id: r.score for r in found if r.query_id == q}
        assert mine == pytest.approx(expected)
        order = sorted(mine, key=lambda i: (-round(mine[i], 9), i))
        ranks = {r.doc_id: r["rank"] for r in found if r.query_id == q}
        assert sorted(ranks.values()) == list(range(1, len(ranks) + 1))
        assert all(mine[a] >= mine[b] - 1e-9 for a, b in zip(sorted(ranks, key=ranks.get), sorted(ranks, key=ranks.get)[1:])) and set(order) == set(ranks)


def test_numbering_with_ties_and_groups(spark):
    rng = random.Random(3)
    rows = [(g, i, float(rng.randint(0, 5))) for g in (1, 2) for i in range(200)]
    found = ranking.numbered(spark.createDataFrame(rows, "g int, doc_id int, score double"), by=("g",)).collect()
    for g in (1, 2):
        expected = [i for _, i, s in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))]
        assert [r.doc_id for r in sorted((r for r in found if r.g == g), key=lambda r: r["rank"])] == expected


def test_fusion(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id int, score double, rank long")
    found = {r.doc_id: (round(r.fused, 6), r.method, r["rank"]) for r in ranking.fuse(frame([(1, 3.0, 1), (2, 1.0, 2)]), frame([(2, 0.9, 1), (3, -0.1, 2)])).collect()}
    assert found == {2: (round(1 / 61 + 1 / 62, 6), "hybrid", 1), 1: (round(1 / 61, 6), "lexical", 2), 3: (round(1 / 62, 6), "semantic", 3)}


def test_a_text_resembles_itself_fully(spark):
    queries = spark.createDataFrame([(0, "use a queue for retries")], "query_id int, query string")
    own = ranking.self_scores(queries).collect()[0].self_score
    alone = ranking.bm25(queries, spark.createDataFrame([(0, "use a queue for retries")], "doc_id int, text string")).collect()[0].score
    assert own == pytest.approx(alone)


def test_equal_scores_spread_over_tasks(spark):
    rows = spark.range(30_000).selectExpr("id AS doc_id", "0.0 AS score")
    found = ranking.numbered(rows)
    assert found.where("rank = doc_id + 1").count() == 30_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_vector_search_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ranking, "CELL_ROWS", 40)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    vectors = [(centres[rng.integers(6)] + rng.normal(size=8) * [0.05, 0.5, 3][seed]).tolist() for _ in range(300)]
    vectors[:100] = [vectors[0]] * 100  # a third are equal
    vectors[150:155] = [[0.0] * 8] * 5
    docs = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (901, [1.0]), (902, [])]
    queries = [(i, v) for i, v in enumerate(vectors) if i % 7 == 0 or i == 151] + [(950, None), (951, [2.0, 1.0])]
    kinds = "long, vector array<double>"
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1)
    for k in (1, 10, 400):
        expected = set()
        for q, v in queries:
            if v and len(v) == 8:
                scored = sorted((-round(float(unit(v) @ unit(d)), 9), i) for i, d in docs if d and len(d) == 8)[:k]
                expected |= {(q, i, rank) for rank, (_, i) in enumerate(scored, 1)}
        found = ranking.vector_search(spark.createDataFrame(queries, f"query_id {kinds}"), spark.createDataFrame(docs, f"doc_id {kinds}"), k)
        assert {(r.query_id, r.doc_id, r["rank"]) for r in found.collect()} == expected
    none = spark.createDataFrame([], f"query_id {kinds}")
    assert ranking.vector_search(none, spark.createDataFrame(docs, f"doc_id {kinds}"), 3).collect() == []
    assert ranking.vector_search(spark.createDataFrame(queries, f"query_id {kinds}"), spark.createDataFrame([], f"doc_id {kinds}"), 3).collect() == []
