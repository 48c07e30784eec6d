import random

import pytest

from quillspark.llm import queries

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=""):
    """Rows (doc_id, text) or (doc_id, text, source) as documents; ``extra``: further columns with clashing names."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, FIELDS)
    for name in extra.split():
        df = df.selectExpr("*", f"doc_id AS `{name}`")
    return df


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "rt lm nk st pp x".split()]
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "ünï çødé 漢字 " * 3), (None, "no id here at all"), (905, "x" * 50_000)]


@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture
def tables(spark, monkeypatch):
    """Lets a query read the given tables in place of files."""

    def use(**frames):
        monkeypatch.setattr(queries, "table", lambda _spark, _dir, name: frames[name])

    return use
