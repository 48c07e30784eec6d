"""Secrets in texts: all rules in one automaton, one pass over the bytes.

Bytes that lead back to the automaton's start from every state can be in no match; the runs between them are scanned
together, a byte of each at a time. Only runs in which a rule matches are read again, for that rule's spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import Scanner
from .words import find_words, text_chunks

#: Kind to (expression, least bytes of a match). The first three are the base kinds; an assigned value has six or more.
RULES: dict[str, tuple[str, int]] = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 0),
    "access": (r"AKIA[A-Z0-9]+", 20),
    "hex": (r"[0-9a-f]{24,}", 24),
    "github": (r"gh[pousr]_[A-Za-z0-9]+", 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 15),
    "google": (r"AIza[A-Za-z0-9_-]+", 39),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
}
BASE = ("assign", "access", "hex")
LEAST_VALUE = 6
SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string"


@cache
def scanner() -> Scanner:
    """The compiled rules; made once in a driver and sent to the tasks."""
    return Scanner([x for x, _ in RULES.values()])


def _long_enough(kind: str, match: bytes) -> bool:
    if kind != "assign":
        return len(match) >= RULES[kind][1]
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    value = match[at + 1 :].lstrip(b" ")
    return len(value[value[:1] in (b'"', b"'") :]) >= LEAST_VALUE


def find_secrets(scan: Scanner, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, str]]]:
    """For each row, (start, end, kind) in code points, by start and then by kind as listed."""
    kinds = list(RULES)
    start, end, of_row = find_words(data, offsets, scan.all.resets)
    found = scan.rules_in(data, start, end)
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(offsets) - 1)]
    hits = np.flatnonzero(found)
    if not len(hits):
        return out
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    for run, row in zip(hits, np.searchsorted(of_row, hits, side="right") - 1):
        text, base = data[start[run] : end[run]].tobytes(), int(start[run])
        for k, kind in enumerate(kinds):
            if found[run] >> k & 1:
                for a, b in scan.spans(k, text):
                    if _long_enough(kind, text[a:b]):
                        zero = points[offsets[row]]
                        out[row].append((int(points[base + a] - zero), int(points[base + b] - zero), kind))
    rank = {k: i for i, k in enumerate(kinds)}
    for spans in out:
        spans.sort(key=lambda x: (x[0], rank[x[2]]))
    return out


def _scan(compiled: Scanner):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = lambda spans: ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                rows = find_secrets(compiled, chunk.data, chunk.offsets)
                counts = [pa.array([sum(x[2] == kind for x in row) for row in rows], pa.int64()) for kind in BASE]
                base = pa.array([joined(x for x in row if x[2] in BASE) for row in rows], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[chunk.first : chunk.last], *counts, base, pa.array([joined(row) for row in rows], pa.string())], [x.split()[0] for x in SPANS.split(", ")])

    return scan


def scan_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_spans, spans`` for each row of ``docs``; spans are ``kind:start:end`` lists.

    A null or empty text has none, an empty table gives an empty result. Repeated rows are scanned alike; spans that begin at one
    place stand in the order of the rules. A very long text is read twice for each rule that matches in it, whatever it
    holds, and takes some 40 bytes for each of its bytes. Other columns are ignored.
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scan(scanner()), SPANS)

