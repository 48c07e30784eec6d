"""Tasks, replacements, numbered snapshots, resemblances, runs and warnings."""

import json
import random

from quillspark.functions.text import estimate_tokens
from quillspark.operators import health, memory, ranking, surfacing, trials

LOG = "id long, record_type string, status string, supersedes long"


def log(spark):
    rows = [(1, "decision", "active", None), (2, "decision", "rejected", None), (3, "failure", "resolved", None), (4, "failure", None, None), (5, "surfacing", None, None)]
    return spark.createDataFrame(rows, LOG)


def test_typed_scans(spark):
    ids = lambda *a, **k: sorted(r.id for r in memory.typed(log(spark), *a, **k).collect())
    assert ids("decision") == [1] and ids("decision", everything=True) == [1, 2]
    assert ids("failure") == [4] and ids("failure", everything=True) == [3, 4] and ids("surfacing") == [5]


def test_a_task_is_read_or_absent(spark, tmp_path):
    path = str(tmp_path / "task")
    assert memory.task(spark, path, "title string").count() == 0
    memory.set_task(spark.createDataFrame([("t",)], "title string"), path)
    assert [r.title for r in memory.task(spark, path, "title string").collect()] == ["t"]


def test_a_replacement_leaves_the_old_record(spark, tmp_path):
    path = str(tmp_path / "log")
    memory.append(log(spark), path)
    memory.supersede(1, spark.createDataFrame([(9, "decision", "active", None)], LOG), path)
    found = {r.id: r.effective_status for r in memory.effective_status(memory.read_log(spark, path, LOG)).collect()}
    assert len(found) == 6 and found[1] == "superseded" and found[9] == "active"


def test_snapshots_have_numbers(spark, tmp_path):
    root = str(tmp_path / "snapshots")
    assert memory.next_number(memory.snapshots(spark, root, LOG)) == 1
    assert [memory.write_snapshot(log(spark), root, LOG, x) for x in ("a", "b")] == [1, 2]
    taken = memory.snapshots(spark, root, LOG).collect()
    assert sorted((r.snapshot, r.label, r.id) for r in taken) == [(n, x, i) for n, x in ((1, "a"), (2, "b")) for i in (1, 3, 4)]


def test_resemblance_is_held_against_the_text_itself(spark):
    texts = spark.createDataFrame([(1, "never log raw passwords"), (2, "entirely other words")], "query_id long, query string")
    statements = spark.createDataFrame([(7, "never log raw passwords"), (8, "keep the interface small")], "doc_id long, text string")
    found = ranking.resemblances(texts, statements).collect()
    assert [(r.query_id, r.doc_id) for r in found] == [(1, 7)] and found[0].confidence <= 0.85


def test_only_the_last_run_counts(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "run_id string, line long")
    assert sorted(r.line for r in trials.latest_run(rows).collect()) == [2, 3]


def test_warnings_travel_with_the_figures(spark):
    cases = spark.createDataFrame([(1, 30, 0.1, 1.0, 1.0), (2, 3, 0.9, 0.5, 0.5)], "context_id long, items long, duplicate_share double, critical_retention double, digit_retention double")
    found = {r.context_id: json.loads(r.report) for r in health.report_rows(health.case_warnings(cases)).collect()}
    assert found[1]["warnings"] == [] and found[2]["warnings"] == ["duplicates", "few_items", "critical_lost", "figures_lost"]


def test_a_handoff_without_records_or_task_says_so(spark):
    records = spark.createDataFrame([(1, 1, "decision", "use Spark", "it scales", None)], "store_id long, id long, record_type string, statement string, detail string, hard boolean")
    tasks = spark.createDataFrame([(2, "t", None, "open", "now", None, "go")], "store_id long, title string, description string, status string, updated_at string, relevant_files array<string>, next_action string")
    text = {r.store_id: r.text for r in surfacing.render_handoff(records, tasks).collect()}
    assert "No task recorded." in text[1] and "- use Spark\n  - *why:* it scales" in text[1] and text[1].count("None recorded.") == 4
    assert "**t**" in text[2] and text[2].count("None recorded.") == 5 and text[2].endswith("go\n")
    assert "*why:*" not in {r.store_id: r.text for r in surfacing.render_handoff(records, tasks, rationale=False).collect()}[1]


def test_a_handoff_is_counted_anew_after_each_cut(spark):
    rng = random.Random(2)
    records, tasks = [], []
    for store in range(60):
        for i in range(rng.randint(0, 12)):
            kind = rng.choice(["decision", "constraint", "discovery", "failure", "surfacing"])
            words = " ".join(rng.choice(["plan", "  run\t", "ü", "a\n\nb", "limit"]) for _ in range(rng.randint(0, 9)))
            records.append((store, i, kind, rng.choice(["active", "resolved", "rejected", None]), words, rng.choice([None, "", "since it scales ", "x" * 40]), rng.random() < 0.5))
        if store % 3:
            tasks.append((store, "t " * rng.randint(1, 5), rng.choice([None, "about this"]), "open", "now", rng.choice([None, [], ["a.py"]]), rng.choice([None, "go"])))
    rows = spark.createDataFrame(records, "store_id long, id long, record_type string, status string, statement string, detail string, hard boolean")
    told = spark.createDataFrame(tasks, "store_id long, title string, description string, status string, updated_at string, relevant_files array<string>, next_action string")
    open_ = rows.where("record_type IN ('constraint', 'discovery') OR record_type = 'decision' AND status = 'active' OR record_type = 'failure' AND NOT (status <=> 'resolved')")
    everyone = rows.select("store_id").union(told.select("store_id")).distinct()
    texts, cuts = [], ["discovery", None, "failure", "constraint", "decision"]
    for level in range(6):
        gone = [c for c in cuts[:level] if c]
        left = open_.where(~open_.record_type.isin(gone)) if gone else open_
        shown = surfacing.render_handoff(left, told, rationale=level < 2, stores=everyone)
        texts.append({r.store_id: (r.text, r.tokens) for r in shown.withColumn("tokens", estimate_tokens(shown.text)).collect()})
    for budget in (None, 0, 75, 90, 120):
        found = {r.store_id: r for r in surfacing.handoffs(rows, told, budget).collect()}
        assert found.keys() == texts[0].keys()
        for store, r in found.items():
            level = next((n for n in range(6) if budget is None or texts[n][store][1] <= budget), 5)
            assert (r.text, r.tokens) == texts[level][store], (budget, store, level)
            assert list(r.dropped) == list(surfacing.HANDOFF_CUT_ORDER[:level]) and r.budget_met == (budget is None or r.tokens <= budget)
            assert len(r.record_ids) == sum(r.counts)
    footer = surfacing.handoffs(rows, told, 75)
    assert any("dropped to fit budget: discoveries" in r[0] for r in footer.select(surfacing.token_footer(footer)).collect())
