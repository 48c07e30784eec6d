"""Packing of token pieces into sequences: shortest-pack-first over the histogram of lengths.

Documents are cut into full sequences and one rest. Only the histogram of lengths, one count for each length, comes to
the driver; patterns placed there are joined back to the pieces by their rank among the pieces of the same length.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import saved
from .tokenization import Encoder

#: Ranks are counted in about so many cells, however many pieces there are.
CELLS = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, tokenizer: str, longest: int = 1024, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each document's token ids and the closing id 0, cut into pieces of ``longest`` ids and one rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(tokenizer)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for key, content in zip(batch.column(0), batch.column(1)):
                ids = np.append(encoder.ids(content.as_py() or ""), np.uint32(0)).astype("<u4")
                for begin in range(0, len(ids), longest):
                    piece = ids[begin : begin + longest]
                    for column, value in zip(rows, (key.as_py(), begin, len(piece), zlib.crc32(piece.tobytes()), len(ids))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], longest: int = 1024) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ``([(length, times), ...], packs)``: lengths go longest first, each into the shortest pack there is.

    Works on counts: all packs of one pattern take a length together, and a new pack takes as many of a length as it
    holds, since it stays the shortest until it is full. So the cost depends on the number of lengths only.
    """
    open_packs: list[tuple[int, int]] = []  # (used, pattern), the shortest first
    patterns: list[tuple[list[tuple[int, int]], int]] = []

    def add(held: list[tuple[int, int]], packs: int, used: int) -> None:
        patterns.append((held, packs))
        if used < longest:
            insort(open_packs, (used, len(patterns) - 1))

    for length in sorted(histogram, reverse=True):
        count = histogram[length]
        while count and open_packs and open_packs[0][0] + length <= longest:
            used, k = open_packs.pop(0)
            held, packs = patterns[k]
            taken = min(packs, count)
            patterns[k] = (held, packs - taken)
            if packs > taken:  # only some of these packs get a piece
                insort(open_packs, (used, k))
            *rest, (last, times) = held
            add([*rest, (last, times + 1)] if last == length else [*held, (length, 1)], taken, used + length)
            count -= taken
        most = longest // length
        for times, packs in ((most, count // most), (count % most, 1)):
            if times and packs:
                add([(length, times)], packs, times * length)
    return [(held, packs) for held, packs in patterns if packs]


def _intervals(patterns: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset, times): where the pieces of each length go, in rank order."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for held, packs in patterns:
        offset = 0
        for length, times in held:
            rank = taken.get(length, 0)
            out.append((length, rank, rank + packs * times, sequence, offset, times))
            taken[length] = rank + packs * times
            offset += length * times
        sequence += packs
    return out


def pack(docs: DataFrame, tokenizer: str, longest: int = 1024, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of all documents with their place: ``sequence_id`` (no gaps) and ``offset`` in the sequence.

    Null and empty texts have the closing id only. Repeated rows are documents of their own. Equal pieces of one length may
    trade places, as their rows are equal; other ties of length go by cell, id and start. Very long texts are encoded whole
    and give as many full sequences as they fill. Other columns are ignored; an empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    pieces = saved(cut_pieces(docs, tokenizer, longest, text, doc_id), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `longest` rows
    n = max(1, sum(histogram.values()))
    cells = [0] * (longest + 1)
    for length, count in histogram.items():
        cells[length] = -(-count * CELLS // n)
    # at most CELLS + longest cells
    lengths = spark.createDataFrame([(k, v) for k, v in enumerate(cells) if v], "length long, cells int")
    intervals = np.array(_intervals(shortest_pack_first(histogram, longest)), dtype=np.int64).reshape(-1, 6)
    intervals = intervals[np.lexsort((intervals[:, 1], intervals[:, 0]))]  # at most one for each place in a pattern
    celled = pieces.join(F.broadcast(lengths), "length").withColumn("cell", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("cells")).cast("int"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = celled.groupBy("length", "cell").count().select("length", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ranks_before"))
    inside = Window.partitionBy("length", "cell").orderBy("doc_id", "start", "ids_crc32")
    ranked = celled.join(F.broadcast(totals), ["length", "cell"]).withColumn("rank", F.col("ranks_before") + F.row_number().over(inside) - 1)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return ranked.select(*names, "rank").mapInArrow(_placed(intervals), f"{PIECES}, sequence_id long, offset long")


def _placed(intervals: np.ndarray):
    """Pieces with their rank among the pieces of their length to pieces with their place, by a search among the intervals."""
    length_from, rank_from, _, sequence_from, offset_from, times = intervals.T

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widest = int(intervals[:, 2].max(initial=0)) + 1
        begins = length_from * widest + rank_from
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(begins, length * widest + rank, side="right") - 1
            nth = rank - rank_from[at]
            columns = [*batch.columns[:5], pa.array(sequence_from[at] + nth // times[at]), pa.array(offset_from[at] + nth % times[at] * length)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:5], "sequence_id", "offset"])

    return placed
