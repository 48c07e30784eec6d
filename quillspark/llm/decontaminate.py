"""Short test items inside long documents: MinHash containment search in size classes, then exact containment.

Items are classed by the number of their shingles, each class up to twice the size of the one before. For a class, a
document is cut into overlapping windows of twice the class's size, so that an item inside a long document meets a window
of about its own size. Window and item are compared by one-permutation MinHash: a shingle's hash names a bin, and each
bin keeps its smallest hash; one equal bin makes a candidate. There are four bins for each shingle of a full-sized item,
so each shingle that both have is found with a probability over a half by itself, and an item with 0.8 of its shingles in
a document is missed with a probability far below ``0.5 ** (0.8 * shingles)``. That isn't low enough for items of a few
shingles: those of the smallest classes are compared by all their shingles, without bins, and are found always.
Candidates are then counted on the full sets. An item of fewer words than a shingle has is one shingle of all its words,
and is looked up among the documents' runs of as many words.

Items are read in blocks of bounded size; each block is held against all documents in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved
from .words import U64, Words, distinct_by_row, hashed_words, shingles, text_chunks

#: A block's items have at most about so many shingles (8 bytes each), or one item's.
BLOCK_SHINGLES = 1 << 20
BINS_PER_SHINGLE = 4
#: Items of up to ``2 ** EXACT_CLASS`` shingles keep them all.
EXACT_CLASS = 3
FILTER_BITS = 22
FOUND = "doc_id long, item_id long, n_shingles long, n_shared long"


def _size_class(n: np.ndarray) -> np.ndarray:
    """k for sizes over 2 ** (k - 1) and up to 2 ** k."""
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def _bins(size_class: int) -> int:
    return BINS_PER_SHINGLE << size_class


def _signed(keys: np.ndarray, owner: np.ndarray, bins: int) -> np.ndarray:
    """For owners in ascending order: where each bin of each owner has its smallest value; values are in ascending order."""
    slot = owner.astype(np.int64) * bins + (keys % U64(bins)).astype(np.int64)
    order = np.lexsort((keys, slot))
    first = np.ones(len(order), dtype=bool)
    first[1:] = slot[order][1:] != slot[order][:-1]
    return order[first]


class Items:
    """Test items, their sets and, for each size class, the signature values of all its items."""

    def __init__(self, ids: list, texts: pa.Array, size: int) -> None:
        self.ids, self.sets = ids, []
        short: dict[int, list[tuple[int, int]]] = {n: [] for n in range(1, size)}
        for chunk in text_chunks(texts):
            words = hashed_words(chunk)
            values, bounds = distinct_by_row(*shingles(words, size))
            lengths = np.diff(words.of_doc)
            for n, found in short.items():
                hashes, ends = shingles(words, n)
                found += [(int(hashes[ends[row]] >> U64(16)), len(self.sets) + row) for row in np.flatnonzero(lengths == n)]
            self.sets += [values[a:b] if n >= size else values[:0] for n, a, b in zip(lengths, bounds, bounds[1:])]
        counts = np.array([len(x) for x in self.sets], dtype=np.int64)
        # items of fewer words than a shingle, by their number of words: their only values in ascending order, and the items
        self.short = {n: (np.array([v for v, _ in sorted(found)], dtype=U64), np.array([i for _, i in sorted(found)])) for n, found in short.items() if found}
        self.classes = {}
        for k in np.unique(_size_class(counts[counts > 0])):
            own = [i for i in np.flatnonzero(counts) if _size_class(counts[i : i + 1])[0] == k]
            values = np.concatenate([self.sets[i] for i in own])
            items = np.repeat(own, counts[own])
            kept = _signed(values, items, _bins(int(k))) if k > EXACT_CLASS else np.arange(len(values))
            kept = kept[np.argsort(values[kept], kind="stable")]
            self.classes[int(k)] = (values[kept], items[kept])
        self.values = np.unique(np.concatenate([np.zeros(0, dtype=U64), *(values for values, _ in self.classes.values())]))
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self._place(self.values)] = True

    def _place(self, values: np.ndarray) -> np.ndarray:
        return (values & U64(len(self.filter) - 1)).astype(np.int64)

    def known(self, values: np.ndarray) -> np.ndarray:
        """Places of the values that some item's signature has; a document without any needs no windows."""
        maybe = np.flatnonzero(self.filter[self._place(values)])
        return maybe[np.isin(values[maybe], self.values)]


def _candidates(values: np.ndarray, rows: np.ndarray, position: np.ndarray, size_class: int, signature: tuple[np.ndarray, np.ndarray]) -> set[tuple[int, int]]:
    """(row, item) with an equal bin in one of the row's windows; window w has the places from w to w + 2 strides.

    For the smallest classes (row, item) with an equal shingle.
    """
    item_values, items = signature
    if size_class <= EXACT_CLASS:
        low, high = (np.searchsorted(item_values, values, side) for side in ("left", "right"))
        return {(int(rows[i]), int(item)) for i in np.flatnonzero(high > low) for item in items[low[i] : high[i]]}
    stride = 1 << size_class
    window = position // stride
    twice, row_twice = np.concatenate((values, values)), np.concatenate((rows, rows))
    _, owner = np.unique(row_twice * (window.max(initial=0) + 2) + np.concatenate((window + 1, window)), return_inverse=True)
    kept = _signed(twice, owner, _bins(size_class))
    low, high = (np.searchsorted(item_values, twice[kept], side) for side in ("left", "right"))
    equal = np.flatnonzero(high > low)
    return {(int(row_twice[kept[i]]), int(item)) for i in equal for item in items[low[i] : high[i]]}


def _short_items(words: Words, n: int, short: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """(row, item) for the items of n words, fewer than a shingle has, that rows hold."""
    item_values, items = short
    hashes, ends = shingles(words, n)
    values = hashes >> U64(16)
    rows = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    long_enough = np.diff(words.of_doc) >= n  # a shorter text is one run of fewer words
    low, high = (np.searchsorted(item_values, values, side) for side in ("left", "right"))
    return sorted({(int(rows[i]), int(item)) for i in np.flatnonzero((high > low) & long_enough[rows]) for item in items[low[i] : high[i]]})


def _search(items: Items, size: int, percent: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                words = hashed_words(chunk)
                hashes, ends = shingles(words, size)
                values = hashes >> U64(16)
                n = np.diff(ends)
                rows = np.repeat(np.arange(len(n)), n)
                position = np.arange(len(values)) - np.repeat(ends[:-1], n)
                some = np.zeros(len(n), dtype=bool)
                some[rows[items.known(values)]] = True
                at = some[rows]
                pairs: set[tuple[int, int]] = set()
                for k, signature in items.classes.items():
                    pairs |= _candidates(values[at], rows[at], position[at], k, signature)
                out = [(row, items.ids[item], 1, 1) for n, short in items.short.items() for row, item in _short_items(words, n, short)]
                for row, item in sorted(pairs):
                    wanted = items.sets[item]
                    shared = int(np.isin(wanted, values[ends[row] : ends[row + 1]]).sum())
                    if 100 * shared >= percent * len(wanted):
                        out.append((row, items.ids[item], len(wanted), shared))
                if out:
                    row, item, count, shared = zip(*out)
                    ids = batch.column(0)[chunk.first : chunk.last].take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (item, count, shared))], ["doc_id", "item_id", "n_shingles", "n_shared"])

    return search


def contained_items(docs: DataFrame, items: DataFrame, shingle_words: int = 5, containment: float = 0.8, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared``: documents that hold ``containment`` of an item's word shingles or more.

    Shingles are distinct runs of ``shingle_words`` words; an item with fewer words is one shingle of all of them, which any
    document may hold; null, empty and blank items are in no document. Repeated rows of either table give repeated pairs,
    so there are no ties. Very long texts are searched whole; a task needs some 60 bytes for each word of its longest.
    Other columns are ignored; empty tables give an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _found(rows, items.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")), shingle_words, containment)


def _found(rows: DataFrame, items: DataFrame, shingle_words: int, containment: float) -> DataFrame:
    """The pairs of ``rows(doc_id, text)`` and ``items(item_id, text)``; ``doc_id`` may be of any type."""
    kinds = FOUND.replace("doc_id long", f"doc_id {rows.schema['doc_id'].dataType.simpleString()}")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text") / 2)).first()[0] or 0) // BLOCK_SHINGLES))
    found = None
    for k in range(int(blocks)):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(int(blocks))) == k).toArrow().combine_chunks()
        held = Items(block["item_id"].to_pylist(), block["text"], shingle_words)
        part = rows.mapInArrow(_search(held, shingle_words, round(100 * containment)), kinds)
        if blocks > 1:
            part = saved(part, "found-items")  # one block after another: the plan never holds more than one
        found = part if found is None else found.unionByName(part)
    return found


def decontaminate(docs: DataFrame, items: DataFrame, shingle_words: int = 5, containment: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that hold a test item ``(item_id, text)``; see :func:`contained_items`.

    A row is known by its id and two hashes of its text, so another row with the same id and a clean text stays; repeated rows
    go or stay together, and a null id is an id like others. Null and empty texts stay. The found rows are few but grow with the
    documents, so they are joined by a shuffle unless Spark sees that they are small.
    """
    key = F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit("b"), F.col(text)).alias("b"))
    named = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    leaks = _found(docs.select(key.alias("doc_id"), F.col(text).alias("text")), named, shingle_words, containment).select(F.col("doc_id").alias("_leak")).distinct()
    leak = leaks["_leak"]
    same = docs[doc_id].eqNullSafe(leak["id"]) & (F.xxhash64(docs[text]) == leak["a"]) & (F.xxhash64(F.lit("b"), docs[text]) == leak["b"])
    return docs.join(leaks, same, "left_anti")
