import json
import random
import re

from quillspark.operators import memory, stats
from quillspark.sources import transcripts

LOG = "id long, record_type string, status string, supersedes long"


def log(spark):
    return spark.createDataFrame([(1, "decision", "active", None), (2, "decision", "rejected", None), (3, "constraint", "active", None), (4, "decision", "active", 1)], LOG)


def test_status_snapshot_and_restore(spark):
    df = log(spark)
    assert {r.id: r.effective_status for r in memory.effective_status(df).collect()} == {1: "superseded", 2: "rejected", 3: "active", 4: "active"}
    taken = memory.snapshot(df, 7)
    assert sorted(r.id for r in taken.collect()) == [1, 3, 4] and {r.snapshot for r in taken.collect()} == {7}
    assert [r.id for r in memory.restore(df.where("id <> 3"), taken).collect()] == [3]


def test_logs_skip_lines_that_do_not_parse(spark, tmp_path):
    path = str(tmp_path / "log")
    memory.append(log(spark), path)
    memory.append(log(spark).limit(1), path)
    (tmp_path / "log" / "part-x.json").write_text('{"id": 9, "status": "active"}\n{not json\n')
    assert sorted(r.id for r in memory.read_log(spark, path, LOG).collect()) == [1, 1, 2, 3, 4, 9]


def test_first_fit_skips_and_goes_on(spark):
    rng = random.Random(6)
    rows = [(s, r, 100 * s + r, rng.randint(1, 20)) for s in range(20) for r in range(rng.randint(1, 15))]
    expected = set()
    for s in range(20):
        used = 0
        for _, _, i, t in sorted(x for x in rows if x[0] == s):
            if used + t <= 40:
                used += t
                expected.add((s, i))
    found = memory.first_fit(spark.createDataFrame(rows, "store_id long, rank int, id long, tokens long"), 40)
    assert {(r.store_id, r.id) for r in found.collect()} == expected


def test_first_fit_folds_no_more_than_the_budget_holds(spark):
    rows = spark.range(20000).selectExpr("0L AS store_id", "int(id) AS rank", "id", "(id * 7) % 12 AS tokens")
    used, expected = 0, set()
    for i in range(20000):
        if used + i * 7 % 12 <= 40:
            used += i * 7 % 12
            expected.add(i)
    taken = memory.first_fit(rows, 40)
    assert {r.id for r in taken.collect()} == expected and taken.count() == len(expected)
    folded = re.findall(r"collect_list", taken._jdf.queryExecution().optimizedPlan().toString())
    limits = re.findall(r"WindowGroupLimit.* 40", taken._jdf.queryExecution().optimizedPlan().toString())
    assert folded and limits
    assert memory.first_fit(rows, -1).count() == 0


def test_handoff_cuts_kinds_until_it_fits(spark):
    rows = [(1, "discovery", 50), (1, "decision", 10), (2, "decision", 500), (3, "failure", 5)]
    found = memory.handoff_level(spark.createDataFrame(rows, "store_id int, record_type string, tokens long"), 30)
    assert {r.store_id: (r.cut_level, r.tokens) for r in found.collect()} == {1: (1, 10), 2: (5, 0), 3: (0, 5)}


def test_variance_and_noise_floor(spark):
    frame = lambda rows: spark.createDataFrame([(m,) for m in rows], "metrics map<string,double>")
    one = {r.metric: (r.n, r["mean"], r.stdev) for r in stats.metric_variance(frame([{"a": 1.0, "b": 2.0}, {"a": 3.0}])).collect()}
    assert one == {"a": (2, 2.0, 1.4142), "b": (1, 2.0, 0.0)}
    found = stats.against_noise_floor(frame([{"a": 1.0, "b": 1.0, "c": 1.0}, {"a": 3.0, "c": 2.0}]), frame([{"a": 4.0, "b": 1.0, "c": 2.0}]))
    assert {r.metric: r.verdict for r in found.collect()} == {"a": "likely_real_difference", "b": "insufficient_data", "c": "indistinguishable_from_noise"}


def items(df):
    return [(r.pos, r.kind, r.content) for r in df.orderBy("pos").collect()]


def test_message_lists(spark):
    raw = '[{"role": "User", "content": "hi"}, {"role": "assistant", "content": "  "}, {"role": "tool", "content": [{"type": "text", "text": "a"}, "b", {"n": 1}]}, {"content": 5}]'
    df = spark.createDataFrame([(1, raw), (2, '{"messages": [{"role": "system", "content": "x"}]}'), (3, "not json")], "context_id int, raw string")
    assert items(transcripts.from_messages(df).where("context_id = 1")) == [(0, "user_message", "hi"), (2, "tool_output", 'a\nb\n{"n":1}'), (3, "agent_message", "5")]
    assert items(transcripts.from_messages(df).where("context_id <> 1")) == [(0, "system", "x")]


def test_session_lines(spark):
    values = ['{"type": "user", "message": {"content": "hi"}}', "broken", "", '{"type": "summary"}', '{"type": "user"}', '{"type": "assistant", "message": {"content": [{"text": "yes"}]}}', '{"type": "user", "message": {"content": " "}}', "[1]"]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "context_id int, line_no int, value string")
    assert items(transcripts.from_session(df)) == [(0, "user_message", "hi"), (1, "agent_message", "yes")]
    assert {r.reason: r.n for r in transcripts.skipped(df).collect()} == {"unparseable": 2, "summary": 1, "user_without_message": 1}


def test_plain_texts(spark):
    df = spark.createDataFrame([(1, "intro\nUser: hi\nthere\nAssistant:  yes\nTool:\n"), (2, "one\n\n \n\ntwo")], "context_id int, raw string")
    assert items(transcripts.from_text(df).where("context_id = 1")) == [(0, "system", "intro"), (1, "user_message", "hi\nthere"), (2, "agent_message", "yes")]
    assert items(transcripts.from_text(df).where("context_id = 2")) == [(0, "agent_message", "one"), (1, "agent_message", "two")]


def test_streamed_lines_are_parsed_as_in_batch(spark, tmp_path):
    from quillspark.streaming import event_log

    source = tmp_path / "in"
    source.mkdir()
    spark.createDataFrame([("a", 0, '{"type": "user", "message": {"content": "hi"}}'), ("a", 1, "broken")], event_log.SCHEMA).coalesce(1).write.mode("append").json(str(source))
    paths = [str(tmp_path / x) for x in ("items", "skipped", "checkpoint")]
    for _ in range(2):  # the second run finds nothing new
        event_log.ingest(event_log.read_lines(spark, str(source)), *paths).awaitTermination()
    assert [(r.context_id, r.content) for r in spark.read.parquet(paths[0]).collect()] == [("a", "hi")]
    assert [(r.line_no, r.outcome) for r in spark.read.parquet(paths[1]).collect()] == [(1, "unparseable")]


def test_repository_walk(spark, tmp_path):
    from quillspark.sources import repository

    for path, text in {"a.py": "x = 1", "lib/setup.py": "s", "lib/in/b.py": "y", "venv/c.py": "z", "notes.md": "n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    files = repository.own_files(repository.read_files(spark, str(tmp_path)))
    known = spark.createDataFrame([("a.py", "0"), ("old.py", "1")], "path string, hash string")
    assert {r.path: r.outcome for r in repository.outcomes(files, known).collect()} == {"a.py": "changed", "lib/setup.py": "vendored", "lib/in/b.py": "vendored", "notes.md": "suffix"}
    assert [r.path for r in repository.vanished(files, known).collect()] == ["old.py"]


def test_loading_tells_formats_apart(spark):
    rows = [(1, '[{"role": "user", "content": "a"}]'), (2, '{"type": "user", "message": {"content": "b"}}\n{"type": "assistant", "message": {"content": "c"}}'), (3, '{"type": "user"}'), (4, "User: d\nAssistant: e"), (5, "")]
    found = transcripts.load(spark.createDataFrame(rows, "context_id int, raw string")).orderBy("context_id", "pos").collect()
    assert [(r.context_id, r.content) for r in found] == [(1, "a"), (2, "b"), (2, "c"), (3, '{"type": "user"}'), (4, "d"), (4, "e")]


def test_session_blocks_of_tools(spark):
    import json

    blocks = [
        {"type": "text", "text": "look"},
        {"type": "tool_use", "name": "grep", "input": {"q": "x"}},
        {"type": "tool_result", "content": "plain"},
        {"type": "tool_result", "content": [{"type": "text", "text": "in"}, {"type": "tool_result", "content": [{"type": "text", "text": "deep"}]}, "bare"]},
        {"type": "tool_use"},
        {"type": "image", "k": 1},
        {"type": "tool_result"},
    ]
    df = spark.createDataFrame([(1, 0, json.dumps({"type": "assistant", "message": {"role": "assistant", "content": blocks}}))], "context_id long, line_no int, value string")
    assert transcripts.from_session(df).first().content.split("\n") == ["look", '[tool_call grep] {"q":"x"}', "plain", "in", "deep", "bare", "[tool_call unknown_tool] {}", '{"k":1,"type":"image"}', ""]


def nested(depth, leaf):
    block = {"type": "text", "text": leaf}
    for i in range(depth):
        block = {"type": "tool_result", "content": [block, {"type": "tool_use", "name": f"t{i}", "input": {"tool_result": i}}]}
    return block


def plain_lines(content):
    if isinstance(content, str):
        return content
    out = []
    for b in content:
        if isinstance(b, str):
            out.append(b)
        elif b["type"] == "text":
            out.append(b["text"])
        elif b["type"] == "tool_use":
            out.append(f"[tool_call {b['name']}] {json.dumps(b['input'], separators=(',', ':'))}")
        elif b["type"] == "tool_result":
            out.append(plain_lines(b.get("content", "")))
    return "\n".join(out)


def test_results_of_tools_at_any_depth(spark):
    rng = random.Random(8)

    def grown(depth):
        kind = rng.choice(["text", "list", "list", "string", "none", "empty"]) if depth else "text"
        if kind == "text":
            return {"type": "text", "text": f"w{rng.randrange(99)}"}
        content = {"list": [grown(depth - 1) for _ in range(rng.randint(1, 3))], "string": "a tool_result in words", "empty": []}
        return {"type": "tool_result", "content": content[kind]} if kind != "none" else {"type": "tool_result"}

    cases = [[nested(d, f"leaf {d}")] for d in (0, 1, 3, 4, 20, 60)] + [[grown(6), "between", grown(5)] for _ in range(30)]
    lines = [(1, i, json.dumps({"type": "user", "message": {"role": "user", "content": c}})) for i, c in enumerate(cases)]
    found = {r.line_no: r.content for r in transcripts.session_lines(spark.createDataFrame(lines, "context_id long, line_no long, value string")).collect()}
    assert found == {i: plain_lines(c) for i, c in enumerate(cases)}
