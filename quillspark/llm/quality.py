"""Quality rules in a short-circuit cascade, ordered by what they reject per cost on a sample.

Each rule reads one number per document, found from the bytes of a batch without a loop over rows. A rule's number is
computed only for documents that no earlier rule rejected, and what was counted before (words, lines, the counts that are
returned anyway) is counted once; the order decides the work done, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SPACE, U64, Chunk, find_words, mix, span_hashes, text_chunks

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
CONTINUATION = (np.arange(256) & 0xC0) == 0x80
WINDOW = 5
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
DIGITS, CAPITALS, BRACES = (np.isin(np.arange(256), list(x)) for x in (b"0123456789", bytes(range(65, 91)), b"{}"))
LETTERS = np.isin(np.arange(256) & ~0x20, range(65, 91)) | (np.arange(256) >= 0x80)
#: Words of more code points than this are no words of a language.
LONGEST_WORD = 100
#: A page is cut down to the rows that are left once they are fewer than this share of it.
CUT_DOWN = 0.75
#: Rows of the sample that costs and rejections are estimated on.
SAMPLE_ROWS = 500


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the flagged places each row has."""
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


def _repeated(values: np.ndarray) -> np.ndarray:
    """Places whose value stands elsewhere, too."""
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    out = np.zeros(len(values), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


class Page:
    """Rows of texts with their words; lines and each rule's number are found once, when they are asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, of_doc: np.ndarray, known: dict[str, np.ndarray] | None = None) -> None:
        self.data, self.offsets, self.start, self.end, self.of_doc = data, offsets, start, end, of_doc
        self.known = known or {}
        self.n_words = np.diff(of_doc)
        self.row = np.repeat(np.arange(len(self.n_words)), self.n_words)

    @classmethod
    def of(cls, chunk: Chunk) -> Page:
        return cls(chunk.data, chunk.offsets, *find_words(chunk.data, chunk.offsets))

    def only(self, rows: np.ndarray) -> Page:
        """The page of these rows, with what is known of them."""
        runs = lambda bounds: np.concatenate(([0], np.cumsum(bounds[rows + 1] - bounds[rows])))
        at = lambda bounds, new: np.repeat(bounds[rows] - new[:-1], np.diff(new)) + np.arange(new[-1])
        offsets, of_doc = runs(self.offsets), runs(self.of_doc)
        words = at(self.of_doc, of_doc)
        shift = np.repeat(self.offsets[rows] - offsets[:-1], np.diff(of_doc))
        return Page(self.data[at(self.offsets, offsets)], offsets, self.start[words] - shift, self.end[words] - shift, of_doc, {k: v[rows] for k, v in self.known.items()})

    def number(self, name: str) -> np.ndarray:
        if name not in self.known:
            self.known[name] = NUMBERS[name](self)
        return self.known[name]

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Begin, end and row of the ``\n``-split lines with a word."""
        breaks = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate((self.offsets[:-1], breaks + 1)), kind="stable")
        row = np.searchsorted(self.offsets[1:], start, side="right")
        inside = row < len(self.offsets) - 1
        # a break at a row's very end begins an empty line, which has no word
        start, row = start[inside], row[inside]
        end = np.minimum(np.append(start[1:], len(self.data)), self.offsets[1:][row])
        end = np.where((end < self.offsets[1:][row]) | ((end > start) & (self.data[np.maximum(end, 1) - 1] == 10)), np.maximum(end - 1, start), end)
        worded = np.searchsorted(self.start, end) > np.searchsorted(self.start, start)
        return start[worded], end[worded], row[worded]

    def of_row(self, rows: np.ndarray) -> np.ndarray:
        """How often each row is named."""
        return np.bincount(rows, minlength=len(self.n_words))

    def ends_with(self, end: np.ndarray, start: np.ndarray, byte: int, times: int) -> np.ndarray:
        """Which spans end in so many of one byte."""
        out = end - start >= times
        for k in range(1, times + 1):
            out &= self.data[np.maximum(end, k) - k] == byte
        return out

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def of_words(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each word has."""
        total = np.concatenate(([0], np.cumsum(flags[self.data], dtype=np.int64)))
        return total[self.end] - total[self.start]


def _dup_lines(page: Page) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    start, end, row = page.lines
    key = mix(span_hashes(page.data, start, end) + row.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    return page.of_row(row[order[1:][key[order][1:] == key[order][:-1]]])


def _repeat_words(page: Page) -> np.ndarray:
    """Words that lie in a window of five words which the text has twice or more."""
    h, n = page.hashes(), len(page.start)
    if n < WINDOW:
        return np.zeros(len(page.n_words), dtype=np.int64)
    whole = page.row[: n - WINDOW + 1] == page.row[WINDOW - 1 :]
    key = page.row[: n - WINDOW + 1].astype(U64)
    for k in range(WINDOW):
        key = mix(key * U64(0x9DDFEA08EB382D69) + h[k : n - WINDOW + 1 + k])
    at = np.flatnonzero(whole)
    at = at[_repeated(key[at])]
    covered = np.zeros(n + 1, dtype=np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return page.of_row(page.row[np.cumsum(covered[:-1]) > 0])


def _distinct_words(page: Page) -> np.ndarray:
    order = np.lexsort((h := page.hashes(), page.row))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (page.row[order][1:] != page.row[order][:-1])
    return page.of_row(page.row[order[new]])


def _bullets(page: Page) -> np.ndarray:
    start, end, row = page.lines
    return page.of_row(row[(end - start >= 2) & np.isin(page.data[start], list(b"-*")) & (page.data[np.minimum(start + 1, len(page.data) - 1)] == 32)])


def _ellipses(page: Page) -> np.ndarray:
    start, end, row = page.lines
    return page.of_row(row[page.ends_with(end, start, 46, 3)])


def _long_word_chars(page: Page) -> np.ndarray:
    points = page.of_words(~CONTINUATION)
    return np.bincount(page.row, np.where(points > LONGEST_WORD, points, 0), len(page.n_words)).astype(np.int64)


NUMBERS: dict[str, Callable[[Page], np.ndarray]] = {
    "word_chars": lambda page: per_row(~SPACE[page.data] & ~CONTINUATION[page.data], page.offsets),
    "symbols": lambda page: per_row(SYMBOLS[page.data], page.offsets),
    "dup_lines": _dup_lines,
    "repeat_words": _repeat_words,
    "lines": lambda page: page.of_row(page.lines[2]),
    "digits": lambda page: per_row(DIGITS[page.data], page.offsets),
    "capitals": lambda page: per_row(CAPITALS[page.data], page.offsets),
    "braces": lambda page: per_row(BRACES[page.data], page.offsets),
    "shouts": lambda page: page.of_row(page.row[page.ends_with(page.end, page.start, 33, 2)]),
    "unlettered": lambda page: page.of_row(page.row[page.of_words(LETTERS) == 0]),
    "ellipses": _ellipses,
    "bullets": _bullets,
    "long_word_chars": _long_word_chars,
    "distinct_words": _distinct_words,
}
#: What each rule rejects, by the page's numbers.
RULES: dict[str, Callable[[Page], np.ndarray]] = {
    "symbols": lambda page: 10 * page.number("symbols") > 3 * page.n_words,
    "long_words": lambda page: page.number("word_chars") > 20 * page.n_words,
    "short_words": lambda page: 2 * page.number("word_chars") < 3 * page.n_words,
    "same_lines": lambda page: 2 * page.number("dup_lines") > page.number("lines"),
    "digits": lambda page: 2 * page.number("digits") > page.number("word_chars"),
    "capitals": lambda page: 2 * page.number("capitals") > page.number("word_chars"),
    "braces": lambda page: 5 * page.number("braces") > page.n_words,
    "shouting": lambda page: 10 * page.number("shouts") > 3 * page.n_words,
    "unlettered": lambda page: 2 * page.number("unlettered") > page.n_words,
    "ellipses": lambda page: 10 * page.number("ellipses") > 3 * page.number("lines"),
    "bullets": lambda page: 10 * page.number("bullets") > 9 * page.number("lines"),
    "long_runs": lambda page: 2 * page.number("long_word_chars") > page.number("word_chars"),
    "few_distinct": lambda page: page.number("distinct_words") < 6,
}


def base_failed(page: Page) -> np.ndarray:
    return (page.n_words < 10) | (100 * page.number("repeat_words") > 20 * page.n_words)


def judge(page: Page, order: list[str], alive: np.ndarray) -> np.ndarray:
    """Which rows no rule rejects, of those alive at the start."""
    rows = np.arange(len(alive))
    left = alive
    for name in order:
        if left.sum() < CUT_DOWN * len(left):
            page, rows, left = page.only(np.flatnonzero(left)), rows[left], left[left]
        if not len(rows):
            break
        left = left & ~RULES[name](page)
    out = np.zeros(len(alive), dtype=bool)
    out[rows[left]] = True
    return out


def _counts(page: Page) -> list[np.ndarray]:
    return [page.n_words, *(page.number(x) for x in ("word_chars", "symbols", "dup_lines", "repeat_words"))]


def measure_rules(texts: pa.Array) -> tuple[dict[str, int], dict[str, float]]:
    """How many of these texts that reach the rules each rule rejects, and the seconds that it takes beyond the counts that are
    made anyway."""
    spent, rejected = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0)
    for chunk in text_chunks(texts):
        page = Page.of(chunk)
        _counts(page)
        page = page.only(np.flatnonzero(~base_failed(page)))
        for name, rejects in RULES.items():
            known = dict(page.known)
            began = time.perf_counter()
            rejected[name] += int(rejects(page).sum())
            spent[name] += time.perf_counter() - began
            page.known = known
    return rejected, spent


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rejected, spent = measure_rules(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(RULES)), pa.array([rejected[x] for x in RULES], pa.int64()), pa.array([spent[x] for x in RULES])], ["rule", "rejected", "spent"])


def order_rules(texts: DataFrame) -> list[str]:
    """Rule names, the most rejections per second first, as the tasks measure them on ``texts(text)``; a row for each rule comes
    back. Ties go to the cheaper rule, then by name."""
    sums = texts.mapInArrow(_measured, "rule string, rejected long, spent double").groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("spent").alias("spent"))
    of = {r.rule: (r.rejected, r.spent) for r in sums.collect()}
    rank = {x: of.get(x, (0, 0.0)) for x in RULES}
    return sorted(RULES, key=lambda x: (-rank[x][0] / max(rank[x][1], 1e-9), rank[x][1], x))


def _rate(order: list[str]):
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                page = Page.of(chunk)
                counts, failed = _counts(page), base_failed(page)
                kept = judge(page, order, ~failed)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[chunk.first : chunk.last], *(pa.array(x, pa.int64()) for x in counts), pa.array(failed), pa.array(kept)],
                    ["doc_id", *(x.split()[0] for x in METRICS.split(", ")), "base_failed", "kept"],
                )

    return rate


def rate_quality(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts of each document, whether it fails the base rules, and whether all rules keep it.

    The cascade's order comes from about ``sample_rows`` rows, chosen over the whole table by a hash of id and text and measured
    where they are; it changes the time only. All rules and counts read whole texts. A null or empty text has no
    words and fails the base rules. Repeated rows are rated alike, whatever their ids, which may be null; ties between rules
    change the order only. Very long texts are rated whole; a task needs some 30 bytes for each byte of its longest. Other
    columns are ignored; an empty table gives none.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    one_in = max(1, rows.count() // sample_rows)
    order = order_rules(rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(one_in)) == 0).select("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_rate(order), f"doc_id {kind}, {METRICS}, base_failed boolean, kept boolean")
