import re

from conftest import ODD, documents, sentence

from quillspark.llm import decontaminate as module
from quillspark.llm.decontaminate import contained_items, decontaminate


def shingle_set(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_force(docs, items):
    out = []
    for i, text in docs:
        have = shingle_set(text)
        for k, item in items:
            want = shingle_set(item)
            if len(n := re.findall(r"[^\x20\x09-\x0D]+", item or "")) < 5:
                have_short = shingle_set(text, len(n)) if len(re.findall(r"[^\x20\x09-\x0D]+", text or "")) >= len(n) else set()
                out += [(i if i is not None else -1, k, 1, 1)] if n and want <= have_short else []
                continue
            if want and 100 * len(want & have) >= 80 * len(want):
                out.append((i if i is not None else -1, k, len(want), len(want & have)))
    return sorted(out)


def found(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.item_id, r.n_shingles, r.n_shared) for r in df.collect())


def corpus(rng):
    items = [(k, sentence(rng, rng.randint(6, 70))) for k in range(40)] + [(90, "one"), (91, ""), (92, None), (93, "two words")]
    docs = [(i, sentence(rng, rng.randint(5, 200))) for i in range(150)]
    for i in range(100):
        words = rng.choice(items[:40])[1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = "changed"
        long = sentence(rng, rng.randint(0, 3000)).split()
        at = rng.randint(0, len(long))
        docs.append((1000 + i, " ".join(long[:at] + words + long[at:])))
    scattered = items[3][1].split()
    docs.append((2000, " ".join(scattered[: len(scattered) // 2] + sentence(rng, 500).split() + scattered[len(scattered) // 2 - 4 :])))
    return docs + ODD, items


def frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_finds_what_brute_force_finds(spark, rng):
    docs, items = corpus(rng)
    expected = brute_force(docs, items)
    assert len(expected) > 50
    assert found(contained_items(documents(spark, docs, "item_id n_shared"), frame(spark, items))) == expected
    left = {r.doc_id for r in decontaminate(documents(spark, docs, "_leak"), frame(spark, items)).collect()}
    assert left == {i for i, _ in docs} - {x[0] for x in expected}


def test_short_items_inside_long_documents(spark, rng):
    items = [(k, sentence(rng, 5 + k % 8)) for k in range(800)]
    docs = [(i, " ".join(sentence(rng, rng.randint(5, 30)) + " " + text for _, text in items[8 * i : 8 * i + 8]) + " last words of it") for i in range(100)]
    expected = brute_force(docs, items)
    assert len(expected) >= 800
    assert found(contained_items(documents(spark, docs), frame(spark, items))) == expected


def test_blocks_of_items(spark, rng, monkeypatch):
    docs, items = corpus(rng)
    monkeypatch.setattr(module, "BLOCK_SHINGLES", 2000)
    assert found(contained_items(documents(spark, docs), frame(spark, items))) == brute_force(docs, items)


def test_repeated_rows_and_empty_tables(spark):
    docs, items = [(1, "a b c d e f g"), (1, "a b c d e f g")], [(1, "a b c d e f"), (1, "a b c d e f")]
    assert len(found(contained_items(documents(spark, docs), frame(spark, items)))) == 4
    assert found(contained_items(documents(spark, []), frame(spark, items))) == []
    assert found(contained_items(documents(spark, docs), frame(spark, []))) == []
    assert decontaminate(documents(spark, docs), frame(spark, [])).count() == 2
