import random

import pyarrow as pa
import pytest

from quillspark.operators import codegraph
from quillspark.sources.graph_store import GraphStore
from quillspark.sources.keyed import KeyedTable
from quillspark.sources.trees import tree_diff


@pytest.fixture
def parsed_paths(monkeypatch):
    """The files that are parsed, run by run."""
    seen, parse = [], codegraph.parse

    def watched(files):
        seen.append(sorted(r.path for r in files.select("path").collect()))
        return parse(files)

    monkeypatch.setattr(codegraph, "parse", watched)
    return seen


FIRST = {"a.py": "import b\ndef f():\n    g()\n", "b.py": "def g(): pass\n", "c.py": "def h(): f()\n", "gone.py": "def old(): g()\n", "turn.py": "def t(): pass\n", "notes.txt": "x", "bad.py": "def ("}
SECOND = {"a.py": "import b\ndef f():\n    g()\n", "b.py": "def g(): pass\ndef h(): pass\n", "c.py": "def h(): f()\n", "new.py": "from a import f\ndef test(): f()\n", "turn.py": "def t(): pass\n", "notes.txt": "x", "bad.py": "def good(): old()\n", ".git/x.py": "def no(): pass"}


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, text string")


def graph_of(spark, store):
    return [sorted((tuple(r) for r in df.collect()), key=str) for df in store.graph(spark)]


def test_two_runs_give_what_one_run_gives(spark, tmp_path, parsed_paths):
    store, fresh = GraphStore(str(tmp_path / "s"), 8), GraphStore(str(tmp_path / "f"), 3)
    assert {r.path: r.outcome for r in store.ingest(frame(spark, FIRST)).collect()} == {x: "new" for x in FIRST} | {"notes.txt": "suffix", "bad.py": "syntax"}
    second = {r.path: r.outcome for r in store.ingest(frame(spark, SECOND)).collect()}
    assert second == {"a.py": "unchanged", "b.py": "changed", "c.py": "unchanged", "new.py": "new", "turn.py": "unchanged", "notes.txt": "suffix", "bad.py": "new", "gone.py": "vanished"}
    fresh.ingest(frame(spark, SECOND))
    assert graph_of(spark, store) == graph_of(spark, fresh)
    assert parsed_paths == [sorted(set(FIRST) - {"notes.txt"}), ["b.py", "bad.py", "new.py"], sorted(set(SECOND) - {"notes.txt", ".git/x.py"})]
    assert {r.outcome for r in store.ingest(frame(spark, SECOND)).collect()} == {"unchanged", "suffix"} and parsed_paths[-1] == []
    assert graph_of(spark, store) == graph_of(spark, fresh)
    store.ingest(frame(spark, SECOND), force=True)
    assert parsed_paths[-1] == parsed_paths[2] and graph_of(spark, store) == graph_of(spark, fresh)


def test_what_no_longer_parses_keeps_its_last_good_state(spark, tmp_path):
    store = GraphStore(str(tmp_path), 4)
    store.ingest(frame(spark, FIRST))
    before = graph_of(spark, store)
    broken = FIRST | {"a.py": "def f(", "b.py": "#" * 1_000_001}
    for _ in range(2):  # and is tried again
        assert {r.path: r.outcome for r in store.ingest(frame(spark, broken)).collect() if r.path in ("a.py", "b.py")} == {"a.py": "syntax", "b.py": "too large"}
    assert graph_of(spark, store) == before


def test_forgetting_files_and_emptying_the_store(spark, tmp_path):
    store = GraphStore(str(tmp_path), 4)
    store.ingest(frame(spark, FIRST))
    assert [r.qualname for r in store.nodes_in_file(spark, "a.py").collect()] == ["f"] and store.nodes_in_file(spark, "x.py").collect() == []
    assert {r.path for r in store.file_hash(spark, frame(spark, {"a.py": "", "z.py": ""})).collect()} == {"a.py"}
    store.forget(frame(spark, {"b.py": "", "z.py": ""}))
    nodes, edges = graph_of(spark, store)
    assert "function:b.py:g" not in {n[0] for n in nodes} and ("function:a.py:f", "g", "calls", False, 3) in edges
    assert {r.outcome for r in store.ingest(frame(spark, FIRST)).collect() if r.path == "b.py"} == {"new"}
    store.ingest(frame(spark, {}))
    assert graph_of(spark, store) == [[], []]
    store.clear(spark)
    assert store.files.read(spark).collect() == [] and graph_of(spark, store) == [[], []]


def test_a_keyed_table_against_a_dictionary(spark, tmp_path):
    rng = random.Random(5)
    table, expected = KeyedTable(str(tmp_path / "t"), "k", "k string, v long", 5), {}
    for step in range(6):
        rows = [(f"k{rng.randrange(12)}", step * 100 + i) for i in range(rng.randrange(9))]
        if step % 2:
            table.upsert(spark.createDataFrame(rows, "k string, v long"), ("v",))
            expected |= dict(rows)
        else:
            gone = [(f"k{rng.randrange(12)}",) for _ in range(4)]
            table.replace(spark.createDataFrame(gone, "k string"), spark.createDataFrame([], "v long, k string"))
            expected = {k: v for k, v in expected.items() if (k,) not in gone}
        assert {r.k: r.v for r in table.read(spark).collect()} == expected and table.read(spark).count() == len(expected)
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(None, 1)], "k string, v long"))


def test_a_change_touches_the_buckets_of_its_keys_only(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), "k", "k long, v long", 16)
    table.upsert(spark.range(500).selectExpr("id AS k", "id AS v"))
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    table.upsert(spark.createDataFrame([(7, 70)], "k long, v long"))
    assert len(before.keys() - files().keys()) == 1 and {r.v for r in table.read(spark).where("k = 7").collect()} == {70} and table.read(spark).count() == 500


def test_files_are_dealt_over_tasks_after_a_shuffle_by_path(spark):
    files = spark.range(400).selectExpr("concat('p', id, '.py') AS path", "'x = 1' AS text").dropDuplicates(["path"])
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert codegraph.parse(files).rdd.getNumPartitions() == wide > 1
    assert tree_diff(files.selectExpr("path", "text AS content"), files.selectExpr("path", "'y' AS content")).rdd.getNumPartitions() == wide


def test_rows_of_many_files_share_batches_and_none_is_lost(monkeypatch):
    monkeypatch.setattr(codegraph, "BATCH_ROWS", 5)
    paths = [f"p{k}.py" for k in range(7)]
    files = pa.RecordBatch.from_arrays([pa.array([*paths, "bad.py", "none.py"]), pa.array(["def f(): g()\n"] * 7 + ["def (", None])], ["path", "text"])
    batches = list(codegraph._parse(iter([files.slice(0, 4), files.slice(4)])))
    rows = [r for b in batches for r in b.to_pylist()]
    assert [r["path"] for r in rows if r["row"] == "file"] == [*paths, "none.py"] and [r["path"] for r in rows if r["row"] == "skipped"] == ["bad.py"]
    assert all(b.num_rows >= 5 for b in batches[:-1]) and len(batches) < 9
    assert list(codegraph._parse(iter([]))) == []


def test_queries_parse_files_of_any_size(spark, tmp_path, monkeypatch):
    from quillspark.plans import code

    monkeypatch.setattr(codegraph, "BATCH_ROWS", 100)
    big = "".join(f"def f{k}():\n    g()\n" for k in range(500)) + "# " + "x" * 1_100_000 + "\ndef g():\n    pass\n"
    files = {"big.py": big, "small.py": "def h():\n    f7()\n"}
    monkeypatch.setattr(code, "project", lambda spark, sf_dir: frame(spark, files))
    nodes = {r.id for r in code.code_graph_nodes(spark, "").collect()}
    assert nodes == {"file:big.py", "file:small.py", "function:small.py:h", "function:big.py:g", *(f"function:big.py:f{k}" for k in range(500))}
    edges = {(r.source, r.target) for r in code.code_graph_edges(spark, "").where("kind = 'calls'").collect()}
    assert ("function:small.py:h", "function:big.py:f7") in edges and ("function:big.py:f499", "function:big.py:g") in edges
    store = GraphStore(str(tmp_path), 2, largest=None)
    assert {r.path: r.outcome for r in store.ingest(frame(spark, files)).collect()} == {"big.py": "new", "small.py": "new"}
    assert "function:big.py:g" in {r.id for r in store.graph(spark)[0].collect()}
