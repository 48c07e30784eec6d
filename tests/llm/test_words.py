import re

import numpy as np
import pyarrow as pa

from quillspark.llm.words import distinct_by_row, hashed_words, shingles, text_chunks

TEXTS = ["Ab  c\nd e", "", None, "one", " \t two Two ", "ab c", "é É x\x0by", "word " * 300]


def all_words(limit):
    out = []
    for chunk in text_chunks(pa.array(TEXTS), limit):
        words = hashed_words(chunk)
        for d in range(chunk.last - chunk.first):
            at = range(words.of_doc[d], words.of_doc[d + 1])
            out.append([(chunk.data[words.start[i] : words.end[i]].tobytes().decode(), int(words.hash[i])) for i in at])
    return out


def test_words_and_hashes_do_not_depend_on_chunks():
    whole = all_words(1 << 20)
    assert [[w for w, _ in x] for x in whole] == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    assert all_words(1) == whole
    by_word = {}
    for word, h in (x for row in whole for x in row):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), word)
        assert by_word.setdefault(low, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_shingles_of_short_rows():
    chunk = next(text_chunks(pa.array(["a b c", "a b", "b c", "a", "", "b a"])))
    found, ends = shingles(hashed_words(chunk), 2)
    rows = [set(found[a:b].tolist()) for a, b in zip(ends, ends[1:])]
    assert [len(x) for x in rows] == [2, 1, 1, 1, 0, 1]
    assert rows[0] == rows[1] | rows[2] and rows[5] != rows[1]
    values, bounds = distinct_by_row(*shingles(hashed_words(next(text_chunks(pa.array(["a a a a", "a a"])))), 1))
    assert np.diff(bounds).tolist() == [1, 1] and values[0] == values[1]
