from collections import Counter

import numpy as np
import pyarrow as pa
from conftest import ODD, documents, sentence

from quillspark.llm.toxicity import features, fit, remainder, risk, score_toxicity, train
from quillspark.llm.words import text_chunks


def corpus(rng, n=500):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = sentence(rng, rng.randint(20, 80)).split()
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(["vilething", "nastyword", "rudename"]))
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows(spark, rng):
    rows, labels = corpus(rng)
    df = documents(spark, rows + [x for x in ODD if x[0]] + ODD[:2], "_text score positive slot")
    result = score_toxicity(df, frame(spark, labels), lambda x: remainder(x, 4) != 2).collect()
    assert len(result) == len(rows) + len(ODD) - 1 + 2
    score = {r.doc_id: r.score for r in result}
    assert all(0 <= x <= 1 for x in score.values()) and score[900] == score[901]
    wrong = sum((score[i] >= 0.3) != (i % 5 == 0) for i, _ in rows)
    assert wrong <= 5


def test_labels_of_other_rows_are_never_learnt(spark, rng):
    rows, labels = corpus(rng, 200)
    kept = lambda x: x % 4 != 2
    turned = [(i, q, 1 - t if i % 4 == 2 else t) for i, q, t in labels]
    one, two = ({r.doc_id: r.score for r in score_toxicity(documents(spark, rows), frame(spark, x), kept).collect()} for x in (labels, turned))
    assert one == two


def test_without_labels_and_without_rows(spark):
    rows = [(1, "some text"), (2, None)]
    for labels in ([], [(1, 1, 1)], [(2, 0, 0)], [(1, 1, None)]):
        assert [r.score for r in score_toxicity(documents(spark, rows), frame(spark, labels), lambda x: x >= 0).collect()] == [0, 0]
    assert score_toxicity(documents(spark, []), frame(spark, [(1, 1, 1), (2, 1, 0)]), lambda x: x >= 0).collect() == []


def test_risk_estimator_finds_a_feature():
    rng = np.random.default_rng(1)
    positive = np.arange(2200) < 200
    x = (rng.random((2200, 6)) < 0.1).astype(np.float32)
    hidden = rng.random(2200) < 0.1
    x[positive | hidden, 0] = 1
    w, b = fit(x, positive, 0.1, seed=0)
    assert w[0] + b > 0 > b + w[1:].max()


def test_a_repeated_id_is_one_row_of_the_sample(spark, rng):
    rows, labels = corpus(rng, 200)
    learn = lambda x: x % 4 != 2
    one = score_toxicity(documents(spark, rows), frame(spark, labels), learn).collect()
    two = score_toxicity(documents(spark, rows + [rows[0]] * 1000 + [rows[4]] * 300), frame(spark, labels * 3), learn).collect()
    assert {r.doc_id: r.score for r in one} == {r.doc_id: r.score for r in two} and len(two) == len(rows) + 1300


def plain_risk(x, positive, prior, w, b):
    """The non-negative risk with the sigmoid loss, row by row."""
    loss = lambda z: 1 / (1 + np.exp(z))
    z = [float(row @ w + b) for row in x]
    of_p, of_u = [v for v, p in zip(z, positive) if p], [v for v, p in zip(z, positive) if not p]
    plus = prior * sum(map(loss, of_p)) / len(of_p)
    minus = sum(loss(-v) for v in of_u) / len(of_u) - prior * sum(loss(-v) for v in of_p) / len(of_p)
    return plus, minus


def test_the_risk_and_its_gradient_against_a_plain_version():
    rng = np.random.default_rng(3)
    for prior in (0.1, 0.6):
        x, positive = (rng.random((40, 5)) < 0.4).astype(float), np.arange(40) < 12
        w, b = rng.normal(size=5), 0.2
        plus, minus, dp, du = risk(x, positive, prior, w, b)
        assert np.allclose((plus, minus), plain_risk(x, positive, prior, w, b))
        total = lambda w, b: sum(plain_risk(x, positive, prior, w, b)) if minus >= 0 else -plain_risk(x, positive, prior, w, b)[1]
        gradient = np.append(x[positive].T @ dp + x[~positive].T @ du, dp.sum() + du.sum())
        for k in range(6):
            e = np.eye(6)[k] * 1e-6
            assert abs((total(w + e[:5], b + e[5]) - total(w - e[:5], b - e[5])) / 2e-6 - gradient[k]) < 1e-6


def test_scores_are_those_of_the_classifiers(spark, rng):
    rows, labels = corpus(rng, 150)
    df = documents(spark, rows)
    model = train(df, frame(spark, labels), lambda x: x >= 0)
    slot_of = {int(b): int(s) for b, s in enumerate(model.slot) if s >= 0}
    score = {r.doc_id: r.score for r in score_toxicity(df, frame(spark, labels), lambda x: x >= 0).collect()}
    for i, text in rows[:20]:
        (chunk,) = text_chunks(pa.array([text]))
        counts = Counter(slot_of[int(b)] for b in features(chunk)[1] if int(b) in slot_of)
        z = np.mean([b + sum(w[s] * np.log1p(n) for s, n in counts.items()) for w, b in zip(model.weights, model.bias)])
        assert abs(score[i] - 1 / (1 + np.exp(-z))) < 1e-6
