"""Words, word hashes and shingles of Arrow text columns, without a Python loop over rows.

A word is a run of bytes other than space and 0x09-0x0D; A-Z are lowered. Since those are single UTF-8 bytes, work on
bytes equals work on characters. Hashes have 64 bits and are the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 2 << 20
CHUNK_ROWS = 1 << 16
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, 256, dtype=U64)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


class Chunk(NamedTuple):
    """Rows ``first`` to ``last`` of a batch: their bytes, and where each row's text begins and ends in them."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Where words begin and end in the bytes; ``of_doc[d]:of_doc[d+1]`` are the words of row d; their hashes."""

    start: np.ndarray
    end: np.ndarray
    of_doc: np.ndarray
    hash: np.ndarray


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Runs of whole rows of about ``limit`` bytes; a null text is empty, a longer text is a chunk of its own."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    every = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1)
        last = min(last, n, first + CHUNK_ROWS)
        yield Chunk(first, last, every[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (the finaliser of MurmurHash3)."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 2 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans, from differences of one running sum of byte values times powers."""
    n = len(data)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(_BYTE[data] * _power(_BASE, n), out=total[1:])
    return mix((total[end] - total[start]) * _power(pow(_BASE, -1, 1 << 64), n + 1)[start] + (end - start).astype(U64))


def find_words(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each run of bytes that aren't gaps, and where each row's runs begin and end in that list."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~gaps[data]
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins[cuts] = inside[1:-1][cuts]
    stops[cuts - 1] = inside[1:-1][cuts - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(stops) + 1, np.searchsorted(start, offsets)


def hashed_words(chunk: Chunk) -> Words:
    """Lower-cased words of the chunk's rows."""
    data = LOWER[chunk.data]
    start, end, of_doc = find_words(data, chunk.offsets)
    return Words(start, end, of_doc, span_hashes(data, start, end))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and where each row's runs begin and end.

    A row with fewer words, but one at least, has its whole sequence as its only shingle; a row without words has none.
    """
    h, of_doc = words.hash, words.of_doc
    n = np.diff(of_doc)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    ends = np.concatenate(([0], np.cumsum(counts)))
    at = np.repeat(of_doc[:-1] - ends[:-1], counts) + np.arange(ends[-1])
    padded = np.concatenate((h, np.zeros(size, dtype=U64)))
    total = np.zeros(len(h), dtype=U64)
    for k, factor in enumerate(_factors(size)):
        total += padded[k : len(h) + k] * factor
    out = total[at]
    for row in np.flatnonzero((n > 0) & (n < size)):  # the words that follow belong to other rows
        own = h[of_doc[row] : of_doc[row + 1]]
        out[ends[row]] = (own * _factors(size)[: len(own)]).sum(dtype=U64) + U64(len(own))
    return mix(out), ends


def _factors(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(31)).integers(0, 2**64, n, dtype=U64) | U64(1)


def distinct_by_row(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, as their upper 48 bits in ascending order, and where each row's values begin and end."""
    n = len(ends) - 1
    rows = np.repeat(np.arange(n, dtype=U64), np.diff(ends))
    keys = np.sort((rows << U64(48)) | (values >> U64(16)))
    if not len(keys):
        return keys, np.zeros(n + 1, dtype=np.int64)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    keys = keys[new]
    return keys & U64((1 << 48) - 1), np.searchsorted(keys >> U64(48), np.arange(n + 1, dtype=U64))
