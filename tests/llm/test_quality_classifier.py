import os

import numpy as np
import pyarrow as pa
import pytest
from conftest import ODD, documents, sentence
from oracle import SF

from quillspark.llm import quality_classifier as qc
from quillspark.llm.queries import QUERIES
from quillspark.llm.words import text_chunks


def corpus(rng, n=400):
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        words = sentence(rng, rng.randint(20, 60)).split()
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 8 else words[:1] * 30
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), 0))
    return rows, labels


def frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(i):
    return i % 3 == 1


LEARN = lambda x: x % 3 != 1


def test_held_out_rows(spark, rng):
    rows, labels = corpus(rng)
    df = documents(spark, rows + ODD + ODD[:2], "score quality x bucket")
    result = qc.score_quality(df, frame(spark, labels), LEARN).collect()
    assert len(result) == len(rows) + len(ODD) + 2 and all(0 <= r.score <= 1 for r in result)
    score = {r.doc_id: r.score for r in result}
    assert score[900] == score[901] == score[902]
    wrong = sum((score[i] >= 0.5) != (q == 1) for i, q, _ in labels if held(i))
    assert wrong <= 4


def test_labels_of_other_rows_are_never_learnt(spark, rng):
    rows, labels = corpus(rng, 120)
    turned = [(i, 1 - q if held(i) else q, t) for i, q, t in labels]
    one, two = ({r.doc_id: r.score for r in qc.score_quality(documents(spark, rows), frame(spark, x), LEARN).collect()} for x in (labels, turned))
    assert one == two


def test_one_kind_of_label_and_no_rows(spark):
    rows = [(1, "some text"), (2, None)]
    for labels, expected in (([], 0.5), ([(1, 1, 1)], 1), ([(2, 0, 0)], 0), ([(1, None, 1)], 0.5)):
        assert [r.score for r in qc.score_quality(documents(spark, rows), frame(spark, labels), lambda x: x >= 0).collect()] == [expected] * 2
    assert qc.score_quality(documents(spark, []), frame(spark, [(1, 1, 1), (2, 0, 0)]), lambda x: x >= 0).collect() == []


def test_repeated_ids_are_one_row_of_the_sample(spark, rng):
    rows, labels = corpus(rng, 80)
    table = spark.sparkContext.broadcast(np.random.default_rng(1).normal(size=(qc.BUCKETS, qc.WIDTH)).astype(np.float32))
    one = qc.train(documents(spark, rows), frame(spark, labels), LEARN, table)
    two = qc.train(documents(spark, rows + [rows[0]] * 1000), frame(spark, labels * 2), LEARN, table)
    assert all(np.array_equal(a, b) for a, b in zip(one, two))


def plain_index(word_hash):
    places, signs = qc.index_vectors(np.array([word_hash], dtype=np.uint64))
    v = np.zeros(qc.WIDTH)
    for p, s in zip(places[0], signs[0]):
        v[p] += s
    return v


def test_word_vectors_and_pooling_against_brute_force(spark, rng, monkeypatch):
    monkeypatch.setattr(qc, "BLOCK", 16)
    texts = [sentence(rng, rng.randint(0, 30)) for _ in range(40)] + ["", None, "one", " ".join(["again"] * 50)]
    expected, hashes_of = np.zeros((qc.BUCKETS, qc.WIDTH)), []
    for t in texts:
        h = [int(x) for c in text_chunks(pa.array([t])) for x in qc.hashed(c)[0]]
        hashes_of.append(h)
        for i, x in enumerate(h):
            for j in range(max(0, i - qc.REACH), min(len(h), i + qc.REACH + 1)):
                if i != j:
                    expected[x % qc.BUCKETS] += plain_index(h[j])
    table = np.zeros((qc.BUCKETS, qc.WIDTH), dtype=np.int32)
    (chunk,) = text_chunks(pa.array(texts))
    qc.add_neighbours(table, *qc.hashed(chunk))
    assert np.array_equal(table, expected)
    expected = np.sign(expected) * np.sqrt(np.abs(expected))
    expected /= np.maximum(np.linalg.norm(expected, axis=1, keepdims=True), 1e-9)
    unit = qc.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert np.allclose(unit, expected, atol=1e-6)
    x = qc.pooled(unit, *qc.hashed(chunk))
    for k, h in enumerate(hashes_of):
        own = unit[[v % qc.BUCKETS for v in h]] if h else np.zeros((1, qc.WIDTH))
        alike = np.array([a @ b for a, b in zip(own[:-1], own[1:])] or [0.0])
        assert np.allclose(x[k], np.concatenate((own.mean(axis=0), own.std(axis=0), [alike.mean(), alike.std(), np.log1p(len(h))])), atol=1e-3)


def test_gradient_against_differences():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(30, 4)), (rng.random(30) < 0.5).astype(float)
    weights = [rng.normal(size=(4, 3)), rng.normal(size=3), rng.normal(size=3), np.array(0.3)]
    _, slopes = qc.gradient(x, y, weights, 0.01)
    for k, w in enumerate(weights):
        for at in np.ndindex(w.shape):
            up, down = [v.copy() for v in weights], [v.copy() for v in weights]
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs((qc.gradient(x, y, up, 0.01)[0] - qc.gradient(x, y, down, 0.01)[0]) / 2e-5 - slopes[k][at]) < 1e-6


def test_temperature_makes_scores_as_likely_as_they_say():
    rng = np.random.default_rng(2)
    z = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(qc.calibrated(3 * z, y) - 3) < 0.2 and qc.calibrated(z[:0], y[:0]) == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_held_out_accuracy_on_the_given_tables(spark):
    found = QUERIES["op11_quality_classifier"](spark, SF.replace("0.001", "0.01"))
    both = found.join(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet"), "doc_id").where("held_out AND quality IS NOT NULL").collect()
    assert len(both) > 50 and sum(r.predicted == r.quality for r in both) >= 0.97 * len(both)
