"""What results say about themselves: degraded rankings, exact counts, verified runs, whole snapshots."""

import json

import pytest

from quillspark.functions.text import estimate_tokens
from quillspark.functions.tokens import is_exact, known_models, with_tokens
from quillspark.operators import context, memory, ranking, surfacing, trials

LOG = "id long, record_type string, status string, supersedes long"


def test_a_ranking_says_why_it_has_no_vectors(spark):
    docs = spark.createDataFrame([(1, "plan the walk", [1.0, 0.0]), (2, "walk", None), (3, "other", [0.0, 1.0]), (4, "plan", [1.0])], "doc_id long, text string, vector array<double>")
    ask = lambda q, v: spark.createDataFrame([(q, v)], "query string, vector array<double>")
    told = lambda *a: {(r.mode, r.degraded_reason) for r in ranking.hybrid(*a).collect()}
    assert told(ask("walk", [1.0, 0.0]), docs) == {("hybrid", None)}
    assert {r.doc_id: r.method for r in ranking.hybrid(ask("walk", [1.0, 0.0]), docs).collect()} == {1: "hybrid", 2: "lexical", 3: "semantic"}
    assert told(ask("walk", None), docs) == told(ask("walk", []), docs) == {("lexical_only", "the query has no vector")}
    assert told(ask("walk", [1.0] * 3), docs) == {("lexical_only", "no document has a usable vector")}
    assert told(ask("walk", [1.0]).drop("vector"), docs) == told(ask("walk", [1.0]), docs.drop("vector")) == {("lexical_only", "no vectors given")}
    assert ranking.hybrid(ask("nothing", None), docs).collect() == [] == ranking.hybrid(ask("walk", None), docs.limit(0)).collect()


def test_exact_counts_by_a_vocabulary(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    texts = ["", None, "a plain text", "ünï 漢字", "x" * 3000, "two\n\nlines"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, token_method long").drop("token_method")
    coder = Tokenizer.from_file(path)
    exact = with_tokens(df, "text", path)
    assert {r.doc_id: r.token_count for r in exact.collect()} == {i: len(coder.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r.m for r in exact.select(is_exact(exact.token_method).alias("m")).collect()} == {True}
    for bad in (None, "/nowhere/x.json"):
        rough = with_tokens(df, "text", bad)
        assert {(r.a, r.b, r.m) for r in rough.select((rough.token_count == estimate_tokens(rough.text)).alias("a"), is_exact(rough.token_method).alias("m"), rough.token_method.alias("b")).collect()} == {(True, "heuristic:chars/4", False)}
    assert len(known_models()) > 3


def test_the_last_run_is_derived_again(spark):
    manifest = [("a", 1, 1, {"x": 1.0}, 0, "f"), ("b", 2, 1, {"x": 1.0, "y": 2.0}, 0, "f"), ("b", 3, 2, {"x": 1.0}, 0, "g"), ("b", 4, 3, {"x": 1.0}, 0, "f"), ("b", 5, 4, {"x": 1.0}, 0, "f"), ("b", 6, 5, {"x": 1.0, "y": 2.0}, 1, "f"), ("b", 7, 6, {"x": 1.0}, 0, "f")]
    rows = spark.createDataFrame(manifest, "run_id string, line long, trial_id long, metrics map<string,double>, exit_code int, fixture_hash string")
    derived = spark.createDataFrame([(1, {"x": 2.0, "y": 3.0}, 0), (2, {"x": 1.0}, 0), (4, {"x": 1.0}, 3), (5, {"x": 1.0}, 1), (6, {"x": 1.0, "z": 0.0}, 0)], "trial_id long, metrics map<string,double>, exit_code int")
    found = {r.trial_id: (r.ok, r.reason) for r in trials.verify_latest(rows, derived, "f").collect()}
    assert found == {1: (False, "differs: x, y"), 2: (False, "the fixture has changed"), 3: (False, "nothing was derived"), 4: (False, "exit code 3 instead of 0"), 5: (False, "no longer reported: y"), 6: (True, "")}
    assert {r.reason for r in trials.verify_latest(rows, derived, None).collect()} == {"the fixture is gone"}
    assert trials.verify_latest(rows.limit(0), derived, "f").collect() == []


def test_reports_without_evidence_are_not_publishable(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], {"x": float(i)}, "h") for i in range(12)], "trial_id long, condition string, metrics map<string,double>, artifact_hash string")
    run = lambda files: {r.section: json.loads(r.report) for r in trials.eval_report(rows, ("x",), "a", files).where("section = 'run'").collect()}["run"]
    none = spark.createDataFrame([], "trial_id long, path string")
    assert run(None) == {"baseline": "a", "warnings": 1, "publishable": False} and run(none) == {"baseline": "a", "warnings": 0, "publishable": True}
    report = trials.eval_report(rows, ("x",), "a", none.union(spark.createDataFrame([(1, "p"), (2, "p")], none.schema))).collect()
    assert [r.key for r in report if r.section == "warning"] == ["unreadable_file:p"] and sum(r.section == "trial" for r in report) == 12
    (comparison,) = [json.loads(r.report) for r in report if r.section == "comparison"]
    assert comparison["condition"] == "b" and comparison["verdict"] == "indistinguishable_from_noise"


def test_a_snapshot_has_its_task_and_commit(spark, tmp_path):
    root, log_path, task_path = (str(tmp_path / x) for x in ("snapshots", "log", "task"))
    log = spark.createDataFrame([(1, "decision", "active", None), (2, "decision", "rejected", None), (3, "failure", "resolved", None), (5, "surfacing", None, None)], LOG)
    assert memory.take_snapshot(log, root, LOG, "first", spark.createDataFrame([("t", 3)], "title string, n long"), "abc") == 1
    assert memory.take_snapshot(log.limit(0), root, LOG, "empty") == 2
    found = memory.taken_snapshots(spark, root).collect()
    assert [(r.snapshot, r.label, r.commit, r.task and json.loads(r.task)) for r in found] == [(1, "first", "abc", {"title": "t", "n": 3}), (2, "empty", None, None)]
    memory.append(log.where("id = 1"), log_path)
    for _ in range(2):  # again it changes nothing
        assert memory.restore_snapshot(1, root, LOG, log_path, task_path)
        assert sorted(r.id for r in memory.read_log(spark, log_path, LOG).collect()) == [1, 3]
        assert [(r.title, r.n) for r in memory.task(spark, task_path, "title string, n long").collect()] == [("t", 3)]
    assert not memory.restore_snapshot(9, root, LOG, log_path, task_path) and memory.restore_snapshot(2, root, LOG, log_path, task_path)


def test_recall_ranks_and_says_what_it_could_not(spark):
    offered = spark.createDataFrame([(c, p, text, 4) for c in (1, 2, 3) for p, text in enumerate(["never use redis", "cache  the\nsession", "speed up"])], "context_id long, pos long, content string, token_count long")
    tasks = spark.createDataFrame([(1, "speed of the cache"), (2, ""), (3, "x")], "context_id long, task string")
    triggers = spark.createDataFrame([(1, "window_usage"), (2, "window_usage"), (3, "none")], "context_id long, reason string")
    found = {r.context_id: (r.surfaced, r.withheld, r.unranked, r.degraded_reason) for r in surfacing.recall_for(offered, tasks, triggers, 8).collect()}
    assert found == {1: (2, 1, 1, "1 candidate(s) share no word with the task and come last"), 2: (2, 1, 3, "no task: candidates are in the order of the records"), 3: (0, 0, 0, None)}
    lines = surfacing.recall_lines(offered, ranking.score_items(offered, tasks), triggers, 8, 9).where("context_id = 1").orderBy("place")
    assert [r.line for r in lines.collect()] == ["  - cache the", "  - speed up"]


def test_pruned_contexts_are_written(spark, tmp_path):
    items = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "context_id long, pos long, content string")
    context.write_pruned(items, str(tmp_path / "p"))
    assert sorted((r.context_id, r.pos, r.content) for r in spark.read.json(str(tmp_path / "p")).collect()) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]
