"""Ranking by BM25, by vectors, and by fused ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, term_count, terms
from ..storage import merged, saved

# Results must agree with them.
K1, B, RRF_K = 1.5, 0.75, 60

#: Terms of the queries, or else of the documents, with which that side is sent to each executor at most, and products that a task
#: sums up. Results don't depend on them.
TERMS_SENT, SUMS_A_TASK = 200_000, 4_000_000


def numbered(scored: DataFrame, by: tuple[str, ...] = (), score: str = "score", tie: str = "doc_id") -> DataFrame:
    """Adds ``rank``, from 1 for the highest score, within ``by``; ties go by ``tie``.

    One sort by range deals the rows out, equal scores by their tie as well, and numbers them as they lie; only how many rows of
    each group a partition has is summed up.
    """
    order = [*map(F.col, by), F.desc(score), F.asc(tie)]
    ordered = saved(scored.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ordered.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return ordered.join(sizes, [*by, "_part"]).withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_part", "_at", "_first", "_before")


def bm25(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``query_id, doc_id, score, rank`` for ``queries(query_id, query)`` over ``docs(doc_id, text)``; scores over 0 only. Scores that
    agree to nine places are ties."""
    found = bm25_scores(queries, docs)
    return numbered(found.withColumn("_order", F.round("score", 9)), by=("query_id",), score="_order").drop("_order")


def bm25_scores(queries: DataFrame, docs: DataFrame, few: bool | None = None) -> DataFrame:
    """``query_id, doc_id, score`` for ``queries(query_id, query)`` over ``docs(doc_id, text)``; scores over 0 only.

    A query's repeated terms count as often as they stand. Only terms of some query leave the scan. If the queries have few terms
    (``few``; counted if not given) they are sent to where a document's terms meet, and if only the documents do, these are sent to where
    a query's meet: a pair is then summed up where it arises, and no pairs are shuffled. Spark would go by the size of files, which
    depends on how many tasks wrote them. If both have many, they meet by term and their sums by pair.
    """
    few = _few_terms(queries.select("query")) if few is None else few
    asked = queries.select("query_id", F.explode(terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    counted = docs.select("doc_id", terms(F.col("text")).alias("t"))
    totals = docs.agg(F.count("*").alias("n_docs"), F.avg(term_count(F.col("text"))).alias("mean_length"))
    words = counted.select("doc_id", F.size("t").alias("length"), F.explode("t").alias("term"))
    any_asked = asked.select("term").distinct()
    tf = saved(words.join(F.broadcast(any_asked) if few else any_asked, "term", "left_semi").groupBy("doc_id", "term", "length").agg(F.count("*").alias("tf")), "term-counts")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n, d = F.col("n_docs"), F.col("df")
    idf = F.log(1 + (n - d + 0.5) / (d + 0.5))
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    wanted = saved(asked.join(df, "term"), "query-terms")
    products = wanted.agg(F.sum("df")).first()[0] or 0  # a task's sums are bounded, however few partitions a shuffle has
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-products // SUMS_A_TASK))
    if few:
        met = tf.repartition(tasks, "doc_id").join(F.broadcast(wanted), "term")
    elif _few_terms(docs.select("text")):
        met = wanted.repartition(tasks, "query_id").join(F.broadcast(tf), "term")
    else:
        met = merged(tf, wanted, "term")
    scored = met.join(F.broadcast(totals)).groupBy("query_id", "doc_id").agg(F.sum(F.col("times") * idf * saturated).alias("score"))
    return scored.where("score > 0")


def _few_terms(texts: DataFrame) -> bool:
    return (texts.agg(F.sum(term_count(F.col(texts.columns[0])))).first()[0] or 0) <= TERMS_SENT


def self_scores(queries: DataFrame) -> DataFrame:
    """``query_id, self_score``: the score of each query against itself as the only document."""
    asked = queries.select("query_id", F.explode(terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    idf = F.log(F.lit(4.0) / 3)
    return asked.groupBy("query_id").agg(F.sum(F.col("times") * idf * F.col("times") * (K1 + 1) / (F.col("times") + K1)).alias("self_score"))


def vector_rank(query: DataFrame, vectors: DataFrame) -> DataFrame:
    """``doc_id, score, rank`` of ``vectors(doc_id, vector)`` by cosine with the one row of ``query(vector)``; all are ranked.

    Scores that agree to nine places are ties, as the order of additions is free.
    """
    scored = vectors.join(F.broadcast(query.limit(1).withColumnRenamed("vector", "_q"))).select("doc_id", cosine(F.col("vector"), F.col("_q")).alias("score"))
    return numbered(scored.withColumn("_order", F.round("score", 9)), score="_order").drop("_order")


#: Cells of an index of vectors at most, sampled vectors for each when their centres are fitted, and vectors that a task compares at once.
MOST_CELLS, CELL_SAMPLE, CELL_ROWS, QUERY_ROWS = 1024, 16, 1 << 15, 256


def vector_search(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``query_id, doc_id, score, rank``: the ``k`` rows of ``vectors(doc_id, vector)`` nearest to each of ``queries(query_id, vector)``.

    Exact, with two passes over the vectors however many queries there are. Centres are fitted to a sample (MOST_CELLS *
    CELL_SAMPLE vectors at most), and every vector belongs to the cell of its nearest centre. A first pass compares each query
    with the cells nearest to it that hold ``k`` vectors or more; a second with each further cell whose nearest point, by the
    angle to its centre and the cell's widest angle, could still reach the k-th best. Large cells are cut into parts, so that
    equal vectors spread over tasks. Scores are cosines, 0 for zero vectors; to nine places they are ties, which go by id.
    Vectors of another length than the first query's are left out, as are nulls.
    """
    asked = queries.where("vector IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    rows = vectors.where("vector IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("vector").cast("array<double>").alias("vector"))
    first = asked.agg(F.min_by(F.size("vector"), "query_id").alias("n")).first()
    width = first.n or 0
    asked, rows = asked.where(F.size("vector") == width), rows.where(F.size("vector") == width)
    found = "query_id long, doc_id long, score double"
    if not width:
        return rows.sparkSession.createDataFrame([], f"{found}, rank int")
    total = rows.count()
    cells = int(min(MOST_CELLS, max(1, total**0.5)))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, total // (cells * CELL_SAMPLE)))) == 0).select("vector").limit(cells * CELL_SAMPLE).toArrow()
    centres = _centres(_unit(_matrix(sample["vector"], width)), cells)

    index = saved(rows.mapInArrow(_to_cells(centres), "cell int, angle double, doc_id long, vector array<double>"), "cells")
    sizes = np.zeros((len(centres), 2))
    for r in index.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("wide")).collect():  # a row for each cell
        sizes[r.cell] = r.n, r.wide
    parts = np.maximum(1, np.ceil(sizes[:, 0] / CELL_ROWS)).astype(np.int64)
    cut = F.pmod(F.xxhash64("doc_id"), F.element_at(F.array(*map(F.lit, parts.tolist())), F.col("cell") + 1))
    none = F.lit(None)
    stored = index.select("cell", cut.cast("int").alias("part"), F.lit(0).alias("query"), F.col("doc_id").alias("id"), "vector")

    def compared(wanted: DataFrame) -> DataFrame:
        met = stored.unionByName(wanted).repartition("cell", "part").sortWithinPartitions("cell", "part", "query", "id")
        return met.mapInArrow(_compare(k, width), found)

    probe = "cell int, part int, query int, id long, vector array<double>"
    near = saved(compared(asked.withColumn("least", none.cast("double")).mapInArrow(_probes(centres, sizes, parts, k), probe)), "nearest")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    best = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).groupBy("query_id").agg(F.min("score").alias("least"))
    far = compared(asked.join(best, "query_id").select("query_id", "vector", "least").mapInArrow(_probes(centres, sizes, parts, k), probe))
    return near.unionByName(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _matrix(lists: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten() if len(lists) else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(n == 0, 1, n)


def _centres(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit vectors that sampled unit vectors gather around; any centres give right results, good ones give small cells."""
    sample = np.unique(sample[sample.any(axis=1)], axis=0)
    if not len(sample):
        return np.eye(1, sample.shape[1])
    centres = sample[np.random.default_rng(5).permutation(len(sample))[:cells]]
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        centres = np.where(sums.any(axis=1, keepdims=True), _unit(sums), centres)
    return centres


def _angles(a: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ centres.T, -1, 1))


def _to_cells(centres: np.ndarray):
    """Unit vectors with the cell of the nearest centre and the angle to it; zero vectors have a right angle to everything."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column(1), centres.shape[1]))
            angles = _angles(unit, centres)
            cell = angles.argmin(axis=1) if len(unit) else np.zeros(0, dtype=np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(unit.ravel()), centres.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(unit)), cell]), batch.column(0), lists], ["cell", "angle", "doc_id", "vector"])

    return deal


def _probes(centres: np.ndarray, sizes: np.ndarray, parts: np.ndarray, k: int):
    """The cells that each query ``(query_id, vector, least)`` is held against: without ``least`` the nearest that hold ``k`` vectors,
    with it all others that could hold one at least as good. A cell is any number of degrees from a zero vector."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column(1), centres.shape[1]))
            for at in range(0, len(unit), QUERY_ROWS):
                some = unit[at : at + QUERY_ROWS]
                angles = _angles(some, centres)
                order = np.argsort(angles, axis=1, kind="stable")
                held = np.cumsum(sizes[order, 0], axis=1)
                early = np.zeros(angles.shape, dtype=bool)
                np.put_along_axis(early, order, held - sizes[order, 0] < k, axis=1)
                if batch.column(2).null_count:
                    wanted = early
                else:
                    least = batch.column(2).to_numpy()[at : at + QUERY_ROWS]
                    reach = np.where(some.any(axis=1)[:, None], np.cos(np.maximum(angles - sizes[:, 1], 0)), 0.0)
                    wanted = ~early & (reach >= least[:, None] - 1e-8)
                query, cell = np.nonzero(wanted & (sizes[:, 0] > 0))
                times = parts[cell]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                query, cell = np.repeat(query, times), np.repeat(cell, times)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(some[query].ravel()), centres.shape[1]).cast(pa.list_(pa.float64()))
                ids = batch.column(0).take(pa.array(at + query))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.ones(len(cell), dtype=np.int32)), ids, lists], ["cell", "part", "query", "id", "vector"])

    return probe


def _compare(k: int, width: int):
    """The ``k`` best of a cell's part for each query that meets it; rows are sorted by part, vectors before queries. A part's vectors
    are held, queries pass by in blocks."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, ids, held = None, [], []
        for batch in batches:
            cell, part, query, id_ = (batch.column(n).to_numpy() for n in range(4))
            rows = _matrix(batch.column(4), width)
            new = np.ones(len(cell), dtype=bool)
            new[1:] = (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (query[1:] != query[:-1])
            bounds = np.append(np.flatnonzero(new), len(cell))
            for a, b in zip(bounds[:-1], bounds[1:]):
                if (cell[a], part[a]) != place:
                    place, ids, held = (cell[a], part[a]), [], []
                if not query[a]:
                    ids.append(id_[a:b])
                    held.append(rows[a:b])
                    continue
                if not held:
                    continue
                if len(held) > 1:
                    ids, held = [np.concatenate(ids)], [np.vstack(held)]
                for at in range(a, b, QUERY_ROWS):
                    yield _best(id_[at : min(b, at + QUERY_ROWS)], rows[at : min(b, at + QUERY_ROWS)] @ held[0].T, ids[0], k)

    return compare


def _best(queries: np.ndarray, scores: np.ndarray, docs: np.ndarray, k: int) -> pa.RecordBatch:
    out = []
    for q in range(len(queries)):
        rounded = np.round(scores[q], 9)
        maybe = np.flatnonzero(rounded >= np.partition(rounded, -k)[-k]) if len(rounded) > k else np.arange(len(rounded))
        first = maybe[np.lexsort((docs[maybe], -rounded[maybe]))[:k]]
        out.append((np.full(len(first), queries[q]), docs[first], scores[q][first]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["query_id", "doc_id", "score"])


def fuse(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of two rankings ``(doc_id, score, rank)``: ``doc_id, fused, method, rank``."""
    both = lexical.select("doc_id", F.col("rank").alias("lr")).join(semantic.select("doc_id", F.col("rank").alias("sr")), "doc_id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    method = F.when(F.col("lr").isNull(), "semantic").when(F.col("sr").isNull(), "lexical").otherwise("hybrid")
    fused = both.select("doc_id", (part("lr") + part("sr")).alias("fused"), method.alias("method"))
    return numbered(fused, score="fused")


def score_items(items: DataFrame, task: str | DataFrame) -> DataFrame:
    """``context_id, pos, score`` of the items of each context by BM25 for a task; each context is a corpus of its own.

    ``task`` is one text for all contexts, or ``(context_id, task)``. Items without a term of the task have no row. An empty task
    scores nothing.
    """
    counted = items.select("context_id", "pos", terms(F.col("content")).alias("t"))
    totals = counted.groupBy("context_id").agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean_length"))
    words = counted.select("context_id", "pos", F.size("t").alias("length"), F.explode("t").alias("term"))
    if isinstance(task, str):
        asked = items.sparkSession.createDataFrame([(task,)], "task string").select(F.explode(terms(F.col("task"))).alias("term")).groupBy("term").agg(F.count("*").alias("times"))
        asked_words = words.join(F.broadcast(asked), "term")  # the terms of one task: a stated, short list
    else:
        asked = task.select("context_id", F.explode(terms(F.col("task"))).alias("term")).groupBy("context_id", "term").agg(F.count("*").alias("times"))
        asked_words = words.join(asked, ["context_id", "term"])
    tf = asked_words.groupBy("context_id", "pos", "length", "term", "times").agg(F.count("*").alias("tf"))
    df = tf.groupBy("context_id", "term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scored = tf.join(df, ["context_id", "term"]).join(totals, "context_id").groupBy("context_id", "pos").agg(F.sum(F.col("times") * idf * saturated).alias("score"))
    return scored.where("score > 0")


def hybrid(query: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, fused, method, mode, degraded_reason`` for the one row of ``query(query, vector)`` over ``docs(doc_id, text, vector)``.

    Ranks by words and by vectors are fused. Where vectors can't be ranked the mode is ``lexical_only``, with the reason: no
    column of vectors on either side, no vector for the query, or none of the documents that is as long as the query's. Some
    documents without a vector have their rank by words alone. No rows: nothing matched at all.
    """
    one = query.limit(1)
    lexical = bm25(one.select(F.lit(0).alias("query_id"), "query"), docs.select("doc_id", "text"))
    reason = None
    usable = docs.where("false").select("doc_id", F.lit(None).cast("array<double>").alias("vector"))
    if "vector" not in query.columns or "vector" not in docs.columns:
        reason = "no vectors given"
    else:
        width = one.agg(F.max(F.size("vector"))).first()[0] or 0
        if width <= 0:
            reason = "the query has no vector"
        else:
            usable = docs.where(F.size("vector") == width).select("doc_id", "vector")
            if usable.isEmpty():
                reason = "no document has a usable vector"
    semantic = usable.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")) if reason else vector_rank(one.select("vector"), usable)
    fused = fuse(lexical.select("doc_id", "score", "rank"), semantic)
    return fused.select("doc_id", "fused", "method", F.lit("lexical_only" if reason else "hybrid").alias("mode"), F.lit(reason).cast("string").alias("degraded_reason"))


def resemblances(texts: DataFrame, statements: DataFrame, threshold: float = 0.15, most: float = 0.85) -> DataFrame:
    """``query_id, doc_id, similarity, confidence`` of texts ``(query_id, query)`` and the statements ``(doc_id, text)`` that they resemble.

    No ranks are needed, so nothing is sorted. A score is held against the text's own, so one statement on file isn't enough for a high similarity; overlap of words is never
    full confidence.
    """
    few = _few_terms(texts.select("query"))
    own = self_scores(texts)
    found = bm25_scores(texts, statements, few).join(F.broadcast(own) if few else own, "query_id").withColumn("similarity", F.col("score") / F.col("self_score"))
    confidence = F.round(F.least("similarity", F.lit(most)), 2)
    return found.where(F.col("similarity") >= threshold).select("query_id", "doc_id", "similarity", confidence.alias("confidence"))
