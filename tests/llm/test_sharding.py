import zlib
from collections import defaultdict

from conftest import ODD, documents, sentence

from quillspark.llm import sharding
from quillspark.llm.sharding import shard_by_bytes


def check(rows, result, shards):
    expected = sorted((i if i is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in result) == expected
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in result:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return sizes


def test_balance_with_a_group_of_a_third(spark, rng):
    rows = [(i, sentence(rng, 20)) for i in range(600)] + [(1000 + i, "the same text in a third of all rows") for i in range(300)]
    sizes = check(rows, shard_by_bytes(documents(spark, rows, "size group tie cell shard"), 8).collect(), 8)
    target = sum(sizes.values()) / 8
    assert len(sizes) == 8 and all(abs(x - target) < 0.05 * target for x in sizes.values())


def test_small_groups_stay_together(spark, rng):
    rows = [(10 * i + k, sentence(random_seeded(i), 8)) for i in range(300) for k in range(3)]
    result = shard_by_bytes(documents(spark, rows), 4, group_share=0.05).collect()
    check(rows, result, 4)
    of_text = defaultdict(set)
    for r in result:
        of_text[r.text_crc32].add(r.shard)
    assert all(len(x) == 1 for x in of_text.values())


def test_a_group_of_many_small_rows_is_whole(spark, rng):
    # more copies than a cell takes, but fewer bytes than the law cuts
    rows = [(i, sentence(rng, 40)) for i in range(900)] + [(5000 + i, "") for i in range(100)]
    result = shard_by_bytes(documents(spark, rows), 4, group_share=0.05).collect()
    check(rows, result, 4)
    assert len({r.shard for r in result if r.doc_id >= 5000}) == 1


def random_seeded(i):
    import random

    return random.Random(i)


def test_odd_rows_and_empty_table(spark):
    rows = [*ODD, *ODD[:3]]
    check(rows, shard_by_bytes(documents(spark, rows), 3).collect(), 3)
    assert shard_by_bytes(documents(spark, []), 40).collect() == []


def test_cells_do_not_change_slots(spark, rng, monkeypatch):
    rows = [(i, sentence(rng, 5)) for i in range(200)]
    before = {r.doc_id: (r.shard, r.slot) for r in shard_by_bytes(documents(spark, rows), 5).collect()}
    monkeypatch.setattr(sharding, "CELLS", 8)
    assert {r.doc_id: (r.shard, r.slot) for r in shard_by_bytes(documents(spark, rows), 5).collect()} == before
