"""Quality scores from random-indexing word vectors, a small network and a calibrated temperature.

Every word has a sparse random index vector, made from its hash. A word's vector is the sum of the index vectors of its
neighbours over the whole corpus; words share ``BUCKETS`` rows of one table, so its size is fixed and no word is left out.
A text is the mean and the spread of its words' vectors, and of how alike each word is to the next. A network of two layers
is fitted in numpy to a bounded sample of labelled rows, and its temperature to a part of the sample that the weights never
see.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U64, Chunk, find_words, span_hashes, text_chunks

#: Rows of the table of word vectors, their width, and how far neighbours reach; fixed whatever the corpus.
BUCKETS = 1 << 16
WIDTH = 64
REACH = 2
#: Words that are looked up together, so that a very long text takes no more memory than others.
BLOCK = 1 << 16


class Network(NamedTuple):
    """Shift and scale of the features, two layers, and the temperature that divides the result."""

    shift: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: float
    temperature: float


def hashed(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, as they are written, and where each row's words begin and end."""
    start, end, of_doc = find_words(chunk.data, chunk.offsets)
    return span_hashes(chunk.data, start, end), of_doc


def index_vectors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a vector and their signs, for each word."""
    places = np.stack([(hashes >> U64(32)) & U64(WIDTH - 1), (hashes >> U64(48)) & U64(WIDTH - 1)], axis=1).astype(np.int64)
    signs = np.stack([(hashes >> U64(40)) & U64(1), (hashes >> U64(56)) & U64(1)], axis=1).astype(np.int32)
    return places, 2 * signs - 1


def add_neighbours(table: np.ndarray, hashes: np.ndarray, of_doc: np.ndarray) -> None:
    """Adds, to the row of each word, the index vectors of the words up to REACH places away in its text."""
    flat = table.reshape(-1)
    row = (hashes & U64(BUCKETS - 1)).astype(np.int64) * WIDTH
    doc = np.repeat(np.arange(len(of_doc) - 1), np.diff(of_doc))
    for begin in range(0, len(hashes), BLOCK):
        near = slice(begin, min(begin + BLOCK + REACH, len(hashes)))
        places, signs = index_vectors(hashes[near])
        for k in range(1, REACH + 1):
            left = np.arange(min(BLOCK, len(hashes) - k - begin))
            left = left[doc[begin + left] == doc[begin + left + k]] if len(left) else left
            for one, other in ((left, left + k), (left + k, left)):
                np.add.at(flat, (row[begin + one][:, None] + places[other]).ravel(), signs[other].ravel())


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of this task's table that aren't zero."""
    table = np.zeros((BUCKETS, WIDTH), dtype=np.int32)
    for batch in batches:
        for chunk in text_chunks(batch.column(0)):
            add_neighbours(table, *hashed(chunk))
    yield from _table_rows(table)


def _table_rows(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    some = np.flatnonzero(table.any(axis=1))
    for begin in range(0, len(some), 4096):
        part = some[begin : begin + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([v.tobytes() for v in table[part].astype("<i8")], pa.binary())], ["bucket", "vector"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros((BUCKETS, WIDTH), dtype=np.int64)
    for batch in batches:
        np.add.at(table, batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<i8").reshape(-1, WIDTH))
    yield from _table_rows(table)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets, from all texts: BUCKETS by WIDTH numbers, whatever the corpus."""
    kinds = "bucket long, vector binary"
    rows = docs.mapInArrow(_tables, kinds).repartition("bucket").mapInArrow(_summed, kinds).toArrow()
    table = np.zeros((BUCKETS, WIDTH), dtype=np.float32)
    for batch in rows.to_batches():
        table[batch.column(0).to_numpy()] = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<i8").reshape(-1, WIDTH)
    table = np.sign(table) * np.sqrt(np.abs(table))  # a few frequent neighbours can't hide the rest
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)


def pooled(table: np.ndarray, hashes: np.ndarray, of_doc: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of each row's word vectors, those of the likeness (the product) of a word and the next, and the
    logarithm of the number of words."""
    n_rows = len(of_doc) - 1
    n, total, squares, likeness = np.diff(of_doc), np.zeros((n_rows, WIDTH)), np.zeros((n_rows, WIDTH)), np.zeros((n_rows, 2))
    bucket = (hashes & U64(BUCKETS - 1)).astype(np.int64)
    doc = np.repeat(np.arange(n_rows), n)
    for begin in range(0, len(hashes), BLOCK):
        own, vectors = doc[begin : begin + BLOCK], table[bucket[begin : begin + BLOCK + 1]]
        near = doc[begin : begin + BLOCK + 1]
        alike = (vectors[:-1] * vectors[1:]).sum(axis=1)
        same = near[:-1] == near[1:]
        for power in (1, 2):
            likeness[:, power - 1] += np.bincount(near[:-1][same], alike[same] ** power, minlength=n_rows)
        vectors = vectors[: len(own)]
        at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        total[own[at]] += np.add.reduceat(vectors, at, axis=0)
        squares[own[at]] += np.add.reduceat(vectors * vectors, at, axis=0)
    spread = lambda total, squares, n: (total / n, np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0)))
    words, pairs = np.maximum(n, 1)[:, None], np.maximum(n - 1, 1)[:, None]
    return np.hstack((*spread(total, squares, words), *spread(likeness[:, :1], likeness[:, 1:], pairs), np.log1p(n)[:, None])).astype(np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def gradient(x: np.ndarray, y: np.ndarray, weights: list, decay: float) -> tuple[float, list]:
    """Mean logistic loss with a squared penalty on the layers, and its gradient."""
    inner, inner_bias, outer, outer_bias = weights
    hidden = np.tanh(x @ inner + inner_bias)
    z = hidden @ outer + outer_bias
    loss = np.mean(np.logaddexp(0, z) - y * z) + decay / 2 * ((inner * inner).sum() + (outer * outer).sum())
    dz = (_sigmoid(z) - y) / len(y)
    back = np.outer(dz, outer) * (1 - hidden * hidden)
    return float(loss), [x.T @ back + decay * inner, back.sum(axis=0), hidden.T @ dz + decay * outer, dz.sum()]


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, steps: int = 300, rate: float = 0.02, decay: float = 1e-4, seed: int = 0) -> list:
    """Both layers, by Adam on all rows at once."""
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(())]
    weights = [w.astype(np.float32) for w in weights]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t in range(1, steps + 1):
        _, slopes = gradient(x, y, weights, decay)
        for k, g in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            weights[k] = weights[k] - (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return weights


def calibrated(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature under which the given results are likeliest; 1 without rows of both kinds."""
    if not len(y) or y.min() == y.max():
        return 1.0
    choices = np.exp(np.linspace(-2, 3, 501))
    return float(min(choices, key=lambda t: np.mean(np.logaddexp(0, z / t) - y * z / t)))


def scores(network: Network, x: np.ndarray) -> np.ndarray:
    hidden = np.tanh(((x - network.shift) / network.scale) @ network.inner + network.inner_bias)
    return _sigmoid((hidden @ network.outer + network.outer_bias) / network.temperature)


def train(docs: DataFrame, labels: DataFrame, learnable, table, rows: int = 20_000, held: float = 0.2) -> Network | float:
    """A network for ``docs`` (doc_id, text) from at most ``rows`` labelled ids, the first in the order of a hash of the id.

    A share ``held`` of them sets the temperature alone. An id that is labelled in two ways counts as of low quality; of
    several rows with one id the one with the smallest hash of its text is learnt from. Without labels of both kinds: their
    share of ones (0.5 without labels).
    """
    known = labels.where(learnable(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(3)):
                x = pooled(table.value, *hashed(chunk))
                first = [c[chunk.first : chunk.last] for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*first, pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "quality", "text_hash", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("text_hash"), "text")
    found = texts.mapInArrow(vectors, f"doc_id {kind}, quality int, text_hash long, x binary").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min_by("x", "text_hash").alias("x"))
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    y = found["quality"].to_numpy().astype(np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    x = np.frombuffer(b"".join(found["x"].to_pylist()), dtype=np.float32).reshape(len(y), -1)
    aside = np.arange(len(y)) % max(2, round(1 / held)) == 1
    if y[~aside].min() == y[~aside].max():
        aside[:] = False
    shift, scale = x[~aside].mean(axis=0), x[~aside].std(axis=0) + 1e-3
    weights = fit((x[~aside] - shift) / scale, y[~aside])
    plain = Network(shift, scale, *weights, 1.0)
    hidden = np.tanh(((x[aside] - shift) / scale) @ plain.inner + plain.inner_bias)
    return plain._replace(temperature=calibrated(hidden @ plain.outer + plain.outer_bias, y[aside]))


def score_quality(docs: DataFrame, labels: DataFrame, learnable, text: str = "text", doc_id: str = "doc_id", **bounds) -> DataFrame:
    """``doc_id`` and ``score`` (0 to 1, higher: likelier of quality 1) for each row of ``docs``.

    ``labels`` has doc_id and quality (1, 0 or null); ``learnable`` tells from an id column which rows may be learnt from.
    Word vectors are counted over all texts, without labels. Null and empty texts get the score of a text without words;
    repeated rows get equal scores, and null ids aren't learnt from. Ties in the sample go by id. Very long texts are read
    whole, block by block of words. Other columns are ignored, so none can clash; an empty table gives an empty result. See
    :func:`train` for bounds and for labels of one kind only.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    table = spark.sparkContext.broadcast(word_vectors(rows.select("text")))
    network = train(rows, labels, learnable, table, **bounds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, network if isinstance(network, float) else 0.0)
            if not isinstance(network, float):
                for chunk in text_chunks(batch.column(1)):
                    out[chunk.first : chunk.last] = scores(network, pooled(table.value, *hashed(chunk)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
