import hashlib
import re

from pyspark.sql import functions as F

from quillspark.functions import text as T


def column(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", expression(F.col("t")).alias("x"))
    return [r.x for r in df.orderBy("i").collect()]


TEXTS = ["", "  \t\n", "abc", "a b  c d e", "x" * 6, "x" * 10, "é" * 1000, "\x1c\x1fend\x85"]


def test_tokens_round_half_to_even_and_count_blank_as_none(spark):
    norm = [" ".join(re.split(r"[\s\x1c-\x1f]+", t)).strip() for t in TEXTS]
    assert column(spark, TEXTS, T.estimate_tokens) == [max(1, round(len(n) / 4)) if n else 0 for n in norm]
    assert column(spark, [None], T.estimate_tokens) == [0]


def test_hashes_ignore_the_shape_of_white_space(spark):
    a, b = column(spark, ["one  two\n", " one\ttwo"], T.content_hash)
    assert a == b == hashlib.sha256(b"one two").hexdigest()[:16]
    a, b = column(spark, ["one  two\n", " one\ttwo"], T.raw_hash)
    assert a != b


def test_markers_go_by_their_own_order(spark):
    values = ["NEVER do this. Decision: yes", "you must not", "nothing here", None]
    assert column(spark, values, lambda c: T.first_marker(c, T.CRITICAL_MARKERS)) == ["decision:", "must not", None, None]


def test_figures(spark):
    values = ["paid $1,200.50 and $1,200.50 or EUR 30", "DE44500105175407324931", "blob+CH78K2XZ12345678901234+x", "100 tests, 92.4%"]
    assert [sorted(x) for x in column(spark, values, T.financial_figures)] == [["$1,200.50", "EUR 30"], ["DE44500105175407324931"], [], []]


def test_noise(spark):
    values = ["ok", "exit code 1", "   ", "3 files changed, 20 insertions(+), 4 deletions(-) in all", "npm WARN deprecated something very old here", "a longer output that says something useful", "[ 45%]"]
    assert column(spark, values, T.is_noise) == [True, False, True, True, True, False, True]


def test_names_and_paths(spark):
    assert column(spark, ["src/a/b/__init__.py", "a/b.py", "src/__init__.py"], T.module_qualname) == ["a.b", "a.b", ""]
    assert column(spark, ["tests/x.py", "a/test_x.py", "a/x_test.py", "a/contest.py"], T.is_test_path) == [True, True, True, False]
    assert column(spark, ["app.core.models", "other.core", "app"], lambda c: T.top_package(c, "app")) == ["core", None, None]
    assert column(spark, ["User", " TOOL ", "robot", "system"], T.kind_for_role) == ["user_message", "tool_output", "agent_message", "system"]


def test_ratio_and_cosine(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0], [0.0, 0.0]), (5, 4, [1.0, 0.0], [2.0, 0.0]), (1, 3, [1.0], [1.0, 2.0])], "p int, w int, a array<double>, b array<double>")
    found = df.select(T.ratio(F.col("p"), F.col("w")).alias("r"), T.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert [(r.r, r.c) for r in found] == [(0.0, 0.0), (1.0, 1.0), (0.3333, 0.0)]
