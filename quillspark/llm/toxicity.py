"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives; other texts are unlabelled, and the share of toxic rows among the labelled ones
is the class prior. Features are words and runs of bytes inside words. The features that are most typical of the
positives are found by counting on Spark; small numpy classifiers are fitted on the driver to samples of bounded size, and
every whole text is scored in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, saved
from .words import LOWER, U64, Chunk, find_words, mix, span_hashes, text_chunks

BUCKETS = 1 << 22
#: Features take many times the bytes of their text, so chunks are small.
CHUNK = 1 << 19
GRAMS = (4, 5)


class Model(NamedTuple):
    """``slot[bucket]`` is a feature's place in ``weights`` or -1; one row of weights for each classifier."""

    slot: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every word, and of every run of 4 and of 5 bytes inside a word."""
    data = LOWER[chunk.data]
    start, end, of_doc = find_words(data, chunk.offsets)
    row_of_word = np.repeat(np.arange(len(of_doc) - 1), np.diff(of_doc))
    rows, buckets = [row_of_word], [span_hashes(data, start, end)]
    length = end - start
    wide = data.astype(U64)
    for n in GRAMS:
        counts = np.maximum(length - n + 1, 0)
        ends = np.cumsum(counts)
        at = np.repeat(start - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        gram = wide[at]
        for k in range(1, n):
            gram = (gram << U64(8)) | wide[at + k]
        rows.append(np.repeat(row_of_word, counts))
        buckets.append(mix(gram + (U64(n) << U64(48))))
    return np.concatenate(rows), (np.concatenate(buckets) & U64(BUCKETS - 1)).astype(np.int64)


def counted(chunk: Chunk, slot: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and number of each chosen feature in the chunk's rows."""
    rows, buckets = features(chunk)
    place = slot[buckets]
    hit = place >= 0
    key, n = np.unique(rows[hit] * width + place[hit], return_counts=True)
    return key // width, key % width, n


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many positive and unlabelled rows of the sample each bucket occurs; rows are ``(positive, text)``."""
    for batch in batches:
        positive = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        for chunk in text_chunks(batch.column(1), CHUNK):
            rows, buckets = features(chunk)
            key = np.unique(buckets * (chunk.last - chunk.first) + rows)
            bucket, mine = key // (chunk.last - chunk.first), positive[chunk.first : chunk.last][key % (chunk.last - chunk.first)]
            seen, at = np.unique(bucket, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen), pa.array(np.bincount(at[mine], minlength=len(seen)), pa.int64()), pa.array(np.bincount(at[~mine], minlength=len(seen)), pa.int64())],
                ["bucket", "in_positive", "in_unlabelled"],
            )


def _matrix(slot: np.ndarray, width: int):
    """The chosen features of each row of the sample: ``(positive, order, place list, number list)``."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1), CHUNK):
                row, place, n = counted(chunk, slot, width)
                cuts = pa.array(np.searchsorted(row, np.arange(chunk.last - chunk.first + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (place, n)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k)[chunk.first : chunk.last] for k in (0, 2)), *lists], ["positive", "order", "places", "numbers"])

    return rows_of


def _merged(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have a feature, then one row for all those without; each row's share of all rows."""
    some = x.any(axis=1)
    share = np.full(int(some.sum()) + 1, 1 / len(x))
    share[-1] *= int((~some).sum())
    return np.vstack((x[some], np.zeros((1, x.shape[1]), dtype=x.dtype))), share


def _loss(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(z, -50, 50)))  # the sigmoid loss: a few wild rows can't outweigh the rest


def _risk(zp: np.ndarray, zu: np.ndarray, share_p, share_u, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Both parts of the risk, and the way down by each row's result; ``share``: what part of its sample a row stands for."""
    slope = lambda z: _loss(z) * (_loss(z) - 1)
    plus = prior * (_loss(zp) * share_p).sum()
    minus = (_loss(-zu) * share_u).sum() - prior * (_loss(-zp) * share_p).sum()
    # derivatives of each part by z
    dp, du, dn = prior * slope(zp) * share_p, -slope(-zu) * share_u, prior * slope(-zp) * share_p
    return (plus, minus, -dn, -du) if minus < 0 else (plus, minus, dp + dn, du)


def risk(x: np.ndarray, positive: np.ndarray, prior: float, w: np.ndarray, b: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """``prior * R_p+`` and ``R_u- - prior * R_p-`` of a linear classifier, and the derivatives by the results of positive and of
    unlabelled rows: of the sum of both, or against the second alone where it is under zero."""
    z, n = x @ w + b, int(positive.sum())
    return _risk(z[positive], z[~positive], 1 / n, 1 / (len(x) - n), prior)


def fit(x: np.ndarray, positive: np.ndarray, prior: float, seed: int, steps: int = 200, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative risk ``prior * R_p+ + max(0, R_u- - prior * R_p-)``.

    Where the estimate of the negatives' risk falls under zero, the step goes against it, as that is overfitting.
    """
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, 0.01, x.shape[1]).astype(np.float32), np.log(prior / (1 - prior))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    (xp, share_p), (xu, share_u) = _merged(x[positive]), _merged(x[~positive])
    for t in range(1, steps + 1):
        _, _, dp, du = _risk(xp @ w + b, xu @ w + b, share_p, share_u, prior)
        g = np.append(xp.T @ dp.astype(np.float32) + xu.T @ du.astype(np.float32) + decay * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - float(move[-1])
    return w, b


def train(docs: DataFrame, labels: DataFrame, learnable, positives: int = 4000, unlabelled: int = 12000, width: int = 1024, classifiers: int = 3) -> Model | None:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); ``learnable``: which ids it may learn from.

    ``positives`` and ``unlabelled`` bound the samples, taken in the order of a hash of the id, and ``width`` the number of
    features. Each id is in a sample once: of its rows the one with the smallest hash of its text stands for it, and an id
    that is labelled both ways counts as toxic. None if no row is labelled toxic or none is labelled otherwise.
    """
    labels = labels.where(learnable(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n, n_toxic = labels.agg(F.count("*"), F.sum("toxic")).first()
    if not n_toxic or n_toxic == n:
        return None
    order = F.xxhash64("doc_id")
    toxic = labels.where("toxic = 1").select("doc_id").orderBy(order).limit(positives).withColumn("positive", F.lit(True))
    some = docs.where(learnable(F.col("doc_id"))).select("doc_id").distinct().orderBy(order).limit(unlabelled).withColumn("positive", F.lit(False))
    ids = toxic.unionByName(some)  # the unlabelled texts are as the corpus is, so a positive may be among them, too
    rows = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "positive").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    sample = saved(rows.select("positive", "text", order.alias("order")), "toxicity-sample")  # at most positives + unlabelled rows

    spread = sample.mapInArrow(_spread, "bucket long, in_positive long, in_unlabelled long").groupBy("bucket").agg(F.sum("in_positive").alias("p"), F.sum("in_unlabelled").alias("u"))
    sizes = {r.positive: r["count"] for r in ids.groupBy("positive").count().collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return None
    # what toxic texts alone have, is in a share `prior` of the unlabelled texts, as compared with the positives
    share_p, share_u = (F.col("p") - F.sqrt("p")) / n_p, F.col("u") / n_u
    typical = spread.where((F.col("p") > 1) & (share_u <= 2 * n_toxic / n * share_p)).orderBy(F.col("p").desc(), "bucket").limit(width)
    chosen = np.array(sorted(r.bucket for r in typical.select("bucket").collect()), dtype=np.int64)
    if not len(chosen):
        return None
    slot = np.full(BUCKETS, -1, dtype=np.int16)
    slot[chosen] = np.arange(len(chosen))
    found = sample.mapInArrow(_matrix(slot, len(chosen)), "positive boolean, order long, places array<int>, numbers array<int>").orderBy("positive", "order").toArrow()
    x = np.zeros((found.num_rows, len(chosen)), dtype=np.float32)
    places, numbers = found["places"].combine_chunks(), found["numbers"].combine_chunks()
    if isinstance(places, pa.ChunkedArray):  # a table without rows
        return None
    x[np.repeat(np.arange(found.num_rows), places.value_lengths().to_numpy()), places.flatten().to_numpy()] = np.log1p(numbers.flatten().to_numpy())
    positive = found["positive"].to_numpy()
    del found, places, numbers
    dropped(sample)
    if positive.all() or not positive.any():
        return None
    fitted = []
    for k in range(classifiers):  # each from its own part of the unlabelled texts
        part = positive | (np.arange(len(positive)) % classifiers != k) if classifiers > 1 else np.ones(len(positive), dtype=bool)
        if not (part & ~positive).any():
            part = np.ones(len(positive), dtype=bool)
        fitted.append(fit(x[part], positive[part], n_toxic / n, seed=k))
    return Model(slot, np.array([w for w, _ in fitted]), np.array([b for _, b in fitted]))


def _score(model: Model | None, text: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if model is not None:
                for chunk in text_chunks(batch.column(text), CHUNK):
                    row, place, n = counted(chunk, model.slot, model.weights.shape[1])
                    z = np.array([b + np.bincount(row, w[place] * np.log1p(n), minlength=chunk.last - chunk.first) for w, b in zip(model.weights, model.bias)]).mean(axis=0)
                    out[chunk.first : chunk.last] = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            columns = [x for x in batch.schema.names if x != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in columns), pa.array(out)], [*columns, "score"])

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, learnable, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = (), **bounds) -> DataFrame:
    """``doc_id``, the columns of ``keep`` and ``score`` (0 to 1, higher: likelier toxic) for each row of ``docs``.

    ``labels`` has columns doc_id and toxic (1, 0 or null); ``learnable`` tells from an id column which rows may be learnt
    from. Null and empty texts get the score of a text without features. Without toxic labels every score is 0. Repeated
    rows get equal scores, null ids aren't learnt from, and ties among features and samples go by hashes. Very long texts
    are scored whole; a task needs some 200 bytes for each byte of its longest text. A kept column named ``score`` would
    clash with the result and is refused; other columns are ignored. See :func:`train` for the bounds.
    """
    if "score" in keep:
        raise ValueError("a kept column can't be named score")
    model = train(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), labels, learnable, **bounds)
    source = text if text in keep else "_text"  # a kept text is sent to the tasks once
    rows = docs.select(F.col(doc_id).alias("doc_id"), *keep, *([] if text in keep else [F.col(text).alias("_text")]))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_text")
    return rows.mapInArrow(_score(model, source), f"{kinds}, score double")


def remainder(doc_id, divisor: int):
    """crc32 of an id's text, modulo ``divisor``: fixes which rows are held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))
