import re

import numpy as np
from conftest import ODD, documents, sentence

from quillspark.llm.near_dedup import components, differences, near_duplicates, odd_sketches


def brute_force(rows, size):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    root = lambda x: x if label[x] == x else root(label[x])
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted((d if d is not None else -1, len(s), c if (c := least.get(root(i))) is not None else -1) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def family(rng, first, n, words, edits):
    base = sentence(rng, words).split()
    out = []
    for k in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        out.append((first + k, " ".join(copy)))
    return out


def found(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in df.collect())


def test_links_near_the_limit(spark, rng):
    rows = [(i, sentence(rng, 30)) for i in range(60)]
    rows += family(rng, 1000, 40, 60, 5) + family(rng, 2000, 30, 30, 4) + [(3000 + i, "Exactly THE same few words") for i in range(50)]
    rows += [(4000, "a b"), (4001, "A  B"), (4002, "b a"), (4003, "a"), (4004, "a")]
    rng.shuffle(rows)
    df = documents(spark, rows, "node key label signature")
    result = near_duplicates(df, 2, 0.8)
    assert found(result) == brute_force(rows, 2)
    assert all(r.kept == (r.doc_id == r.component_id) for r in result.collect())


def test_hot_buckets_are_dealt_over_salts(spark, rng, monkeypatch):
    from quillspark.llm import near_dedup

    monkeypatch.setattr(near_dedup, "SAMPLE", 1)
    monkeypatch.setattr(near_dedup, "HOT_SHARE", 0)
    monkeypatch.setattr(near_dedup.link_classes, "__defaults__", (5,))
    rows = family(rng, 0, 60, 80, 12) + [(500 + i, sentence(rng, 30)) for i in range(20)]
    assert found(near_duplicates(documents(spark, rows), 2, 0.8)) == brute_force(rows, 2)


def test_pairs_at_exactly_the_limit_without_star_rounds(spark, monkeypatch):
    from quillspark.llm import near_dedup

    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 0)
    rows = [(2 * k + at, " ".join(f"w{i}x{j}" for j in range(at, at + 9))) for k, i in enumerate((33821, 128477, 162679)) for at in (0, 1)]
    result = found(near_duplicates(documents(spark, rows), 1, 0.8))
    assert result == brute_force(rows, 1) and [x[2] for x in result] == [0, 0, 2, 2, 4, 4]


def test_odd_sketches_show_no_more_differences_than_there_are():
    rng = np.random.default_rng(3)
    for n, own in ((5, 1), (300, 40), (5000, 900)):
        common, one, two = (rng.integers(0, 1 << 48, k, dtype=np.uint64) for k in (n, own, own))
        values, ends = np.concatenate((common, one, common, two)), np.array([0, n + own, 2 * (n + own)])
        sketches = odd_sketches(values, ends)
        assert 0 < differences(sketches[:1], sketches[1:])[0] <= 2 * own


def test_odd_rows_and_empty_table(spark):
    rows = [*ODD, *ODD[:4], (None, "no id here at all"), (77, "no id here at all")]
    assert found(near_duplicates(documents(spark, rows), 2, 0.8)) == brute_force(rows, 2)
    assert near_duplicates(documents(spark, []), 5, 0.8).collect() == []


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 102), (101, 102)]
    labels = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert labels == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 102: 100}


def test_no_table_that_grows_is_broadcast(spark, rng, monkeypatch):
    """Copies of labels for each salt aren't in Spark's guess of a table's size, and went whole through the driver."""
    from quillspark.llm import near_dedup

    plans = {}

    def saved(df, name, write=near_dedup.saved):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin"))
        return write(df, name)

    monkeypatch.setattr(near_dedup, "saved", saved)
    rows = family(rng, 0, 30, 40, 3) + [(500 + i, sentence(rng, 30)) for i in range(20)]
    result = near_duplicates(documents(spark, rows), 2, 0.8)
    assert found(result) == brute_force(rows, 2)
    assert not result._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")
    assert {"edges", "labels", "node-labels", "links", "sets", "components"} <= plans.keys()
    assert not any(n for name, counts in plans.items() if name != "shared-keys" for n in counts)  # hot keys are bounded
