import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import ODD, WORDS

from quillspark.llm import collocations as mining

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute_force(rows, least=100, longest=5, best=2000):
    out = []
    for lang in {r[2] or "und" for r in rows}:
        grams, n = Counter(), 0
        for _, text, other in rows:
            if (other or "und") != lang:
                continue
            lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
                words = re.findall(r"[^\x20\x09]+", piece)
                n += len(words)
                grams.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
        candidates = {g: a for g, a in grams.items() if len(g) > 1 and a >= least}
        gone = {g[i:j] for g, a in candidates.items() for i in range(len(g)) for j in range(i + 2, len(g) + 1) if j - i < len(g) and candidates[g[i:j]] <= a}
        found = []
        for g, a in candidates.items():
            if g not in gone:
                score, k = min((1000 * a * n // (grams[g[:k]] * grams[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), grams[g[:k]], grams[g[k:]]))
        for rank, (score, a, phrase, le, ri) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, le, ri, n, -score))
    return sorted(out)


def frame(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in extra.split():
        df = df.selectExpr("*", f"doc_id AS `{name}`")
    return df


def found(spark, rows, extra="", **bounds):
    df = mining.collocations(frame(spark, rows, extra), **bounds)
    assert df.columns == COLUMNS and {k for c, k in df.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    return sorted(tuple(r) for r in df.collect())


def texts(rng, n):
    common = [" ".join(rng.choice(WORDS) for _ in range(k)) for k in (2, 2, 3, 3, 4, 5, 5, 6, 7)] + ["La la la la la", "x\ty  z"]
    rows = []
    for i in range(n):
        parts = [rng.choice(common) if rng.random() < 0.4 else rng.choice(WORDS[:12]) for _ in range(rng.randint(1, 40))]
        rows.append((i, "".join(p + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", " \r", "!"]) for p in parts), rng.choice(["en", "en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("least,longest,best", [(100, 5, 2000), (20, 5, 2000), (5, 3, 7), (3, 2, 50)])
def test_against_brute_force(spark, rng, least, longest, best):
    rows = texts(rng, 400) + [(i, t, "en") for i, t in ODD] + [(7, "Tie one", "en"), (7, "Tie one", "en"), (8, None, None)]
    rows = rows * 2 if least == 100 else rows
    result = found(spark, rows, "phrase n rank score", least=least, longest=longest, best=best)
    assert result == brute_force(rows, least, longest, best) and len(result) > 5


def test_empty_tables_and_texts(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, None), (2, "", "en"), (3, " . ", "de")], least=1) == []
    assert found(spark, [(1, "a b", "de")], least=1) == [("de", 1, "a b", 1, 1, 1, 2, 2000)]


def test_a_full_filter_changes_nothing(spark, rng, monkeypatch):
    rows = texts(rng, 200)
    monkeypatch.setattr(mining, "MOST_WORDS", 2)
    assert found(spark, rows, least=10) == brute_force(rows, least=10)


def test_long_texts_and_copies(spark, rng):
    long = " ".join(rng.choice(WORDS[:9]) for _ in range(60_000))
    rows = [(0, long, "en")] + [(i, "one copied phrase of many words here", "en") for i in range(1, 500)]
    assert found(spark, rows) == brute_force(rows)


def test_products_beyond_64_bits(spark, monkeypatch):
    big = 10**13
    levels = iter([[("en", "a", 2 * big), ("en", "b", 3 * big), ("en", "", 10 * big)], [("en", "a b", big - 1)]])
    monkeypatch.setattr(mining, "_filter", lambda _: np.zeros(1, dtype=np.uint64))
    monkeypatch.setattr(mining, "saved", lambda df, name: spark.createDataFrame(next(levels), "lang string, phrase string, n long") if name.startswith("grams") else df)
    assert found(spark, [(1, "", "en")], longest=2) == [("en", 1, "a b", big - 1, 2 * big, 3 * big, 10 * big, 1000 * (big - 1) * 10 * big // (6 * big * big))]
