import re
from collections import Counter

import numpy as np
import pytest
from conftest import ODD, documents, sentence

from pyspark.sql import functions as F

from quillspark.llm import lm_scoring
from quillspark.llm.lm_scoring import Bounds, exchange, score_texts
from quillspark.llm.words import span_hashes

SMALL = Bounds(head_words=30, unit_words=10, suffixes=8, classes=6, sweeps=2)


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def base_scores(rows, learnable):
    counts = Counter(t for i, text in rows if learnable(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return n, {(i, text): (len(tokens(text)), sum(counts[t] > 0 for t in tokens(text)), sum(np.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(text))) for i, text in rows}


@pytest.mark.parametrize("bounds", [Bounds(), SMALL])
def test_base_scores_and_counts(spark, rng, bounds):
    rows = [(i, sentence(rng, rng.randint(0, 60)) + f" rare{i}") for i in range(80)] + [x for x in ODD if x[0]] + ODD[3:4]
    n, expected = base_scores(rows, lambda i: i % 5 != 1)
    result = score_texts(documents(spark, rows, "uid words n score"), lambda x: x % 5 != 1, bounds=bounds).collect()
    assert len(result) == len(rows)
    by_id = {i: expected[i, t] for i, t in rows}
    for r in result:
        length, known, base = by_id[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (length, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_the_model_learns_what_follows(spark, rng):
    def text(k):
        return " ".join(w for _ in range(30) for w in ((rng.choice("ab") + "x", rng.choice("cd") + "y") if k % 2 else (rng.choice("ef") + "z", rng.choice("gh") + "w")))

    rows = [(i, text(i)) for i in range(200)]
    result = score_texts(documents(spark, rows), lambda x: x % 5 != 1, bounds=SMALL).where("doc_id % 5 = 1").collect()
    assert all(r.score > r.base_score for r in result)


def test_probabilities_of_a_small_vocabulary_sum_to_one(spark):
    words = "aa bb cc dd".split()
    train = [(0, "aa bb aa bb cc"), (5, "bb aa dd")]
    probe = [(1 + 5 * k, w) for k, w in enumerate([*words, "unseen"])]
    result = {r.doc_id: r for r in score_texts(documents(spark, train + probe), lambda x: x % 5 != 1, bounds=SMALL).collect()}
    assert all(result[i].score < 0 for i, _ in probe)
    # the first token alone: each text's score without its end can't exceed one in sum
    assert sum(10 ** result[i].score for i, _ in probe) <= 1.0


def test_scores_against_brute_force(spark, rng):
    """Only the classes are taken from the model; counts, transitions and emissions are made here, word by word."""
    bounds = Bounds(head_words=40, unit_words=6, least=5, suffixes=4, classes=5, sweeps=2)
    rows = [(i, " ".join(rng.choice(["the", "a", "of", *(x + y for x in "kmnp" for y in ("ing", "ed", "s", "er", "un"))])[: rng.choice([9, 9, 9, 3])] for _ in range(rng.randint(0, 30))) + f" z{i % 40}q") for i in range(150)]
    df = documents(spark, rows)
    learnt = df.where("doc_id % 5 <> 1").select("text")
    vocabulary = learnt.mapInArrow(lm_scoring._count_words, "word long, suffix long, n long").groupBy("word").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"))
    model = lm_scoring.train(learnt, vocabulary, bounds)

    def number(word):
        if word is None:
            return 1
        data = np.frombuffer(word.encode(), dtype=np.uint8)
        return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])

    head = {int(w): int(c) for w, c in zip(model.head, model.head_class)}
    suffix = lambda w: int.from_bytes(w.encode()[::-1][:3].ljust(3, b"\0"), "big")

    def unit(word):
        return int(model.units.of(np.array([number(word)], dtype=np.uint64), np.array([-1 if word is None else suffix(word)]))[0])

    def class_of(word):
        own = head.get(number(word), -1)
        return own if own >= 0 else int(model.class_of_unit[unit(word)])

    named = lambda word: word is not None and head.get(number(word), -1) >= 0
    texts = [tokens(t) for i, t in rows if i % 5 != 1]
    counts = Counter(w for t in texts for w in t)
    follow = Counter((class_of(a), class_of(b)) for t in texts for a, b in zip([None, *t], t))
    k = len(model.after)
    into = [sum(follow[a, b] for a in range(k)) for b in range(k)]
    share = [(x + 0.5) / (sum(into) + 0.5 * k) for x in into]
    in_unit = {u: [w for w in counts if w is not None and not named(w) and unit(w) == u] for u in range(model.units.n)}
    rare = [u for u in range(1 + model.units.n_words, model.units.n)]
    size = [0.0] * k
    for w in counts:
        if named(w):
            size[class_of(w)] += counts[w] + 0.5
    size[int(model.class_of_unit[0])] += counts[None] + 0.5
    for u in rare:
        size[int(model.class_of_unit[u])] += sum(counts[w] for w in in_unit[u]) + 0.5

    def log10(before, word):
        a, b = class_of(before), class_of(word)
        after = (follow[a, b] + 5 * share[b]) / (sum(follow[a, x] for x in range(k)) + 5)
        if word is None or named(word):
            return np.log10(after * (counts[word] + 0.5) / size[b])
        mine = in_unit[unit(word)]
        total = sum(counts[w] for w in mine)
        return np.log10(after * (total + 0.5) / size[b] * (counts[word] + 0.5) / (total + 0.5 * (len(mine) + 1)))

    assert sum(named(w) for w in counts) > 6 and any(not named(w) for w in counts if w)
    found = {r.doc_id: r.score for r in score_texts(df, lambda x: x % 5 != 1, bounds=bounds).collect()}
    for i, text in rows:
        t = tokens(text)
        assert found[i] == pytest.approx(sum(log10(a, b) for a, b in zip([None, *t], t)), rel=1e-9)


def test_nothing_to_learn_from(spark):
    result = score_texts(documents(spark, [(1, "a b"), (6, None)]), lambda x: x % 5 != 1, bounds=SMALL).collect()
    assert [r.n_known for r in result] == [0, 0] and all(np.isfinite(r.score) and r.train_tokens == 0 for r in result)
    assert score_texts(documents(spark, []), lambda x: x % 5 != 1, bounds=SMALL).collect() == []


def test_exchange_never_lowers_information(rng):
    pairs = np.zeros((12, 12))
    for _ in range(3000):
        u = rng.randrange(12)
        pairs[u, (u + (6 if u % 2 else 3)) % 12] += 1

    def information(member):
        onehot = np.eye(member.max() + 1)[member]
        t = onehot.T @ pairs @ onehot
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(t) - f(t.sum(axis=0)) - f(t.sum(axis=1))

    values = [information(exchange(pairs, 5, sweeps)) for sweeps in (0, 1, 2, 4)]
    assert all(a <= b + 1e-6 for a, b in zip(values, values[1:])) and values[-1] > values[0]
