import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import ODD, documents, sentence

from quillspark.llm.packing import pack, shortest_pack_first
from quillspark.llm.queries import tokenizer_path
from quillspark.llm.tokenization import Encoder


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_path())
    return lambda text: exact.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_library(encode):
    encoder = Encoder.load(tokenizer_path())
    for text in ("it's <|endoftext|> we''ll", "<|endoftext|><|padding|> x", "it''s we''ll \n\n 's \t x  ", "\x85 a b²³½\xa0é", "漢字 🙂 x", "a" * 3000, "", "1st 22nd—x’s"):
        assert list(encoder.ids(text)) == encode(text)


def test_every_id_lies_in_one_piece(spark, rng, encode):
    rows = [(i, sentence(rng, rng.randint(0, 90))) for i in range(120)] + [(500 + i, "equal texts of one length") for i in range(60)] + [x for x in ODD if x[0]]
    result = pack(documents(spark, rows, "start length rank"), tokenizer_path(), longest=64).collect()
    ids = {i: np.array([*encode(t), 0], dtype="<u4") for i, t in rows}
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in result:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        of_doc[r.doc_id].append((r.start, r.length))
        of_sequence[r.sequence_id].append((r.offset, r.length))
    assert of_doc.keys() == ids.keys()
    gapless = lambda x, total: [a for a, _ in sorted(x)] == [0, *np.cumsum([n for _, n in sorted(x)])[:-1]] and sum(n for _, n in x) == total
    assert all(gapless(x, len(ids[i])) for i, x in of_doc.items())
    assert all(gapless(x, sum(n for _, n in x)) and sum(n for _, n in x) <= 64 for x in of_sequence.values())
    assert sorted(of_sequence) == list(range(len(of_sequence)))


def test_repeated_rows_and_empty_table(spark):
    result = pack(documents(spark, [(1, "twice"), (1, "twice"), (None, None)]), tokenizer_path()).collect()
    assert len(result) == 3 and {r.sequence_id for r in result} == {0} and len({r.offset for r in result}) == 3
    assert pack(documents(spark, []), tokenizer_path()).collect() == []


def test_little_padding(rng):
    histogram = defaultdict(int)
    for _ in range(3000):
        histogram[rng.randint(1, 1023)] += 1
    packs = sum(n for _, n in shortest_pack_first(histogram))
    assert packs * 1024 < 1.01 * sum(k * n for k, n in histogram.items())


def test_patterns_hold_the_histogram(rng):
    for _ in range(200):
        histogram = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
        held = defaultdict(int)
        for lengths, packs in shortest_pack_first(histogram, 64):
            assert sum(n * times for n, times in lengths) <= 64 and packs > 0
            for n, times in lengths:
                held[n] += packs * times
        assert held == histogram
