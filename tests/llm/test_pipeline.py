import os

import pytest
from conftest import FIELDS, ODD, documents, sentence

import corpus_pipeline
from quillspark.llm import queries
from quillspark.llm.queries import QUERIES
from quillspark.llm.storage import shared_folder


def build(spark, rng):
    rows, labels = [], []
    line = "This line stands at the top of every page of every site"
    for i in range(200):
        toxic = i % 8 == 0
        words = sentence(rng, 80).split()
        for _ in range(4 if toxic else 0):
            words.insert(rng.randint(0, 80), rng.choice(["vilething", "nastyword"]))
        rows.append((i, f"{line}\n" + " ".join(words), "en", f"src{i % 10}", 0))
        labels.append((i, 1, int(toxic)))
    copies = [(1000 + i, rows[1][1].replace(line, line) + (" end" if i else ""), "en", "src3", 0) for i in range(5)]
    item = sentence(rng, 30)
    leak = [(2000, sentence(rng, 200) + " " + item + " " + sentence(rng, 100), "en", "src1", 0)]
    return {
        "documents": spark.createDataFrame(rows + copies + leak + [(3000, None, None, None, None), rows[5]], FIELDS),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, item)], "item_id long, text string"),
    }


def test_each_stage_does_its_part(spark, rng, monkeypatch):
    frames = build(spark, rng)
    for module in (queries, corpus_pipeline):
        monkeypatch.setattr(module, "table", lambda _s, _d, name: frames[name])
    docs = frames["documents"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, ""), f"test-{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    clean = {i for i in range(200) if i % 8}
    assert clean <= kept["toxicity"].keys() and len([i for i in kept["toxicity"] if i < 200 and i % 8 == 0]) <= 1
    assert kept["line_dedup"].keys() == kept["toxicity"].keys()
    row = kept["line_dedup"][7]
    assert not row.text.startswith("This line") and row.n_chars == len(row.text)
    assert clean <= kept["near_dedup"].keys() and not [i for i in kept["near_dedup"] if 1000 <= i < 2000]
    assert kept["decontamination"].keys() == kept["near_dedup"].keys() - {2000}
    assert kept["packing"].keys() == kept["decontamination"].keys()
    assert 3000 in kept["packing"]


def test_all_operators_are_registered():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]


def use(monkeypatch, frames):
    for module in (queries, corpus_pipeline):
        monkeypatch.setattr(module, "table", lambda _s, _d, name: frames[name])


@pytest.mark.parametrize("stage", range(5))
def test_each_stage_takes_odd_rows_and_empty_tables(spark, rng, monkeypatch, stage):
    frames = build(spark, rng)
    use(monkeypatch, frames)
    run = corpus_pipeline.STAGES[stage][1]
    long = [(5000, " ".join(sentence(rng, 20) for _ in range(3000))), (5001, "word\n" * 30_000)]
    docs = documents(spark, [*ODD, *ODD, *long], "score _key _a label")
    nowhere = docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "CAST(NULL AS string) AS source", "CAST(NULL AS long) AS n_chars")
    ids = {r.doc_id for r in nowhere.collect()}
    for given in (docs, nowhere):
        out = run(spark, given, "").collect()
        assert {r.doc_id for r in out} == ids and len(out) >= len(ids)
    assert run(spark, docs.limit(0), "").collect() == []
    for name in ("labels", "benchmark"):
        use(monkeypatch, frames | {name: frames[name].limit(0)})
        assert {r.doc_id for r in run(spark, docs, "").collect()} == ids


def test_documents_with_one_id_are_told_apart_by_their_texts(spark, rng, monkeypatch):
    frames = build(spark, rng)
    item = frames["benchmark"].first().text
    same = [(1, f"{sentence(rng, 40)} {item} {sentence(rng, 40)}"), (1, sentence(rng, 60)), (1, sentence(rng, 60)), (None, f"a {item}"), (None, "clean")]
    use(monkeypatch, frames)
    docs = documents(spark, same + same[1:2])
    left = corpus_pipeline.drop_benchmark_leaks(spark, docs, "")
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted([(1, same[1][1])] * 2 + [(1, same[2][1]), (0, "clean")])
    assert sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, left, "").collect()) == sorted([(1, same[1][1]), (1, same[2][1]), (0, "clean")])


def test_a_run_gives_what_its_stages_give_and_leaves_one_copy(spark, rng, monkeypatch):
    frames = build(spark, rng)
    use(monkeypatch, frames)
    before = set(os.listdir(shared_folder(spark)))
    found = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, "").collect())
    docs = frames["documents"]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, ""), "by-hand")
    assert found == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in docs.collect()) and found
    left = set(os.listdir(shared_folder(spark))) - before
    assert sum(x.startswith("pipeline-") for x in left) == 1
