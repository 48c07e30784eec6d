"""Brown's class-based n-grams: exchange clustering of words, then smoothed perplexity of every text.

Exchange clustering gives classes to the most frequent words, one by one, and to the last bytes of all others; one more
unit ends a text. Then every further word of the vocabulary's head that is frequent enough gets the class that explains
best which classes stand before and after it: those neighbours are counted on Spark, a row for each word and class. Only
rarer words go by their last bytes. The probability of a token is that of its class after the class of the token before,
times that of its word in the class. Word counts come from all learnable texts and stay in Spark: only the head of the
vocabulary goes to the tasks; tokens outside it meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import saved
from .words import CHUNK_BYTES, LOWER, U64, Chunk, Words, hashed_words, text_chunks

#: The end of a text counts as this word, which no text has.
END = U64(1)
SUFFIX_BYTES = 3


class Bounds(NamedTuple):
    """What limits the model's parts on the driver and in the tasks, whatever the corpus."""

    head_words: int = 400_000  # words whose counts and classes go to every task
    unit_words: int = 1_000  # words whose classes are found by exchange
    least: int = 4  # further words of the head with so many tokens get a class by their neighbours
    suffixes: int = 500  # units of all other words, by last bytes
    classes: int = 48
    sweeps: int = 4


def suffix_of(chunk: Chunk, words: Words) -> np.ndarray:
    """The last bytes of each word as a number."""
    data = LOWER[chunk.data]
    out = np.zeros(len(words.hash), dtype=np.int64)
    for k in range(1, SUFFIX_BYTES + 1):
        has = words.end - k >= words.start
        out = out * 256 + np.where(has, data[np.maximum(words.end - k, 0)], 0)
    return out


def with_ends(values: np.ndarray, of_doc: np.ndarray, end: int | np.integer) -> tuple[np.ndarray, np.ndarray]:
    """The rows' values with ``end`` after each row, and where each row's begin and stop."""
    n = len(of_doc) - 1
    return np.insert(values, of_doc[1:], end), of_doc + np.arange(n + 1)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in text_chunks(batch.column(0), 2 * CHUNK_BYTES):
            words = hashed_words(chunk)
            values, _ = with_ends(words.hash, words.of_doc, END)
            suffixes, _ = with_ends(suffix_of(chunk, words), words.of_doc, -1)
            # a word has one suffix: its first place has it
            word, first, n = np.unique(values, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(suffixes[first]), pa.array(n)], ["word", "suffix", "n"])


class Units:
    """Unit numbers: 0 ends a text, then words of their own, then suffixes; the last is for words with none of those."""

    def __init__(self, words: np.ndarray, suffixes: np.ndarray) -> None:
        self.words, self.word_order = np.sort(words), np.argsort(words)
        self.suffixes, self.suffix_order = np.sort(suffixes), np.argsort(suffixes)
        self.n_words, self.n = len(words), 2 + len(words) + len(suffixes)

    @staticmethod
    def _find(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_values, values), max(len(sorted_values) - 1, 0))
        return at, sorted_values[at] == values if len(sorted_values) else np.zeros(len(values), dtype=bool)

    def of(self, words: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
        out = np.full(len(words), self.n - 1, dtype=np.int64)
        at, known = self._find(self.suffixes, suffixes)
        out[known] = 1 + self.n_words + self.suffix_order[at[known]]
        at, known = self._find(self.words, words)
        out[known] = 1 + self.word_order[at[known]]
        out[words == END] = 0
        return out


def _unit_rows(chunk: Chunk, units: Units) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's words; then of all tokens with ends: word, unit and row bounds; and the units before each, 0 at a start."""
    words = hashed_words(chunk)
    token, bounds = with_ends(words.hash, words.of_doc, END)
    suffix, _ = with_ends(suffix_of(chunk, words), words.of_doc, -1)
    unit = units.of(token, suffix)
    before = np.zeros_like(unit)
    before[1:] = unit[:-1]
    before[bounds[:-1]] = 0
    return words, token, unit, before, bounds


def _count_pairs(units: Units):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(units.n * units.n, dtype=np.int64)
        for batch in batches:
            for chunk in text_chunks(batch.column(0)):
                _, _, unit, before, _ = _unit_rows(chunk, units)
                dense += np.bincount(before * units.n + unit, minlength=len(dense))
        at = np.flatnonzero(dense)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(dense[at])], ["pair", "n"])

    return count


def exchange(pairs: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """A class for each unit, so that classes tell most about the class that follows.

    Units start in classes by their frequency, dealt in turn; a sweep takes each unit out and puts it where the sum of
    n log n over class pairs, less that over classes, is largest. Ties go to the smaller class. Unit 0 keeps class 0.
    """
    n = len(pairs)
    classes = max(2, min(classes, n))
    total = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = np.argsort(-total[1:], kind="stable") + 1
    member = np.zeros(n, dtype=np.int64)
    member[order] = 1 + np.arange(n - 1) % (classes - 1)
    xlogx = lambda x: x * np.log(np.maximum(x, 1))
    onehot = np.zeros((n, classes))
    onehot[np.arange(n), member] = 1
    left, right = pairs.T @ onehot, pairs @ onehot  # [unit, class]: pairs from the class to the unit, from the unit to the class
    table = onehot.T @ right
    for _ in range(sweeps):
        moved = 0
        for u in order:
            old, own = member[u], pairs[u, u]
            into, out_of = left[u].copy(), right[u].copy()
            into[old] -= own
            out_of[old] -= own
            table[old] -= out_of
            table[:, old] -= into
            table[old, old] -= own
            rows, columns = table.sum(axis=1), table.sum(axis=0)
            # what changes if the unit joins class c: row c, column c, and the cell where they meet
            gain = (xlogx(table + out_of) - xlogx(table)).sum(axis=1) + (xlogx(table + into[:, None]) - xlogx(table)).sum(axis=0)
            d = np.diag(table)
            do, di = out_of, into
            gain -= (xlogx(d + do) - xlogx(d)) + (xlogx(d + di) - xlogx(d))
            gain += xlogx(d + do + di + own) - xlogx(d)
            gain -= xlogx(rows + do.sum() + own) - xlogx(rows) + xlogx(columns + di.sum() + own) - xlogx(columns)
            gain[0] = -np.inf
            new = int(np.argmax(gain)) if gain.max() > gain[old] + 1e-9 else int(old)
            table[new] += out_of
            table[:, new] += into
            table[new, new] += own
            if new != old:
                left[:, old] -= pairs[u]
                left[:, new] += pairs[u]
                right[:, old] -= pairs[:, u]
                right[:, new] += pairs[:, u]
                member[u] = new
                moved += 1
        if not moved:
            break
    return member


class Model(NamedTuple):
    """Log probabilities (base 10) and the head of the vocabulary, as the tasks need them."""

    units: Units
    class_of_unit: np.ndarray
    after: np.ndarray  # [class before, class]
    unit_log: np.ndarray  # of a rare word's unit: its share of its class, over its smoothed count of words
    head: np.ndarray  # sorted hashes of frequent words
    head_count: np.ndarray
    head_class: np.ndarray  # -1: the word goes by its last bytes
    head_log: np.ndarray  # of a word with a class: its share of its class
    n_tokens: int
    n_distinct: int


class Classes(NamedTuple):
    """The classes of tokens: those of words in the head, where they have one, and of their units."""

    units: Units
    of_unit: np.ndarray
    head: np.ndarray
    of_head: np.ndarray

    def tokens(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the chunk's tokens with ends: word, unit, place in the head (-1: none), class, the class before, row bounds."""
        _, token, unit, _, bounds = _unit_rows(chunk, self.units)
        at, known = Units._find(self.head, token)
        at = np.where(known, at, -1)
        own = np.where(known, self.of_head[at], -1) if len(self.head) else at
        own = np.where(own >= 0, own, self.of_unit[unit])
        before = np.full_like(own, self.of_unit[0])
        before[1:] = own[:-1]
        before[bounds[:-1]] = self.of_unit[0]
        return token, unit, at, own, before, bounds


def _count_neighbours(classes: Classes, asked: np.ndarray):
    """``(place, neighbour, n)``: how often a class stands before (or, ``k`` on, after) the words at places in the head."""
    k = int(classes.of_unit.max()) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(0), 4 * CHUNK_BYTES):
                _, _, at, own, before, bounds = classes.tokens(chunk)
                after = np.append(own[1:], classes.of_unit[0])
                after[bounds[1:] - 1] = classes.of_unit[0]
                hit = np.flatnonzero(asked[at] & (at >= 0))
                key, n = np.unique(np.concatenate((at[hit] * (2 * k) + before[hit], at[hit] * (2 * k) + k + after[hit])), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key // (2 * k)), pa.array((key % (2 * k)).astype(np.int32)), pa.array(n)], ["place", "neighbour", "n"])

    return count


def _best_class(k: int, left: np.ndarray, right: np.ndarray, size: np.ndarray):
    """Rows ``(place, neighbours)`` to the class under which a word's neighbours are likeliest, the smaller on ties.

    ``left[c, d]`` is the log probability of class d after c, ``right`` the same with the word's class as the first, and
    ``size`` that of one token among those of a class.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            pairs = lists.flatten()
            counts = np.zeros((batch.num_rows, 2 * k))
            counts[row, pairs.field("neighbour").to_numpy()] = pairs.field("n").to_numpy()
            gain = counts[:, :k] @ left + counts[:, k:] @ right.T + counts[:, :k].sum(axis=1)[:, None] * size
            gain[:, 0] = -np.inf  # the end's own class
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gain.argmax(axis=1).astype(np.int16))], ["place", "class"])

    return best


def _count_classes(classes: Classes):
    """How often each class follows each: a row for each pair."""
    k = int(classes.of_unit.max()) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(k * k, dtype=np.int64)
        for batch in batches:
            for chunk in text_chunks(batch.column(0)):
                _, _, _, own, before, _ = classes.tokens(chunk)
                dense += np.bincount(before * k + own, minlength=k * k)
        at = np.flatnonzero(dense)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(dense[at])], ["pair", "n"])

    return count


def transitions(table: np.ndarray) -> np.ndarray:
    """Log10 probabilities of classes after classes; unseen pairs fall back on the class's own share."""
    share = (table.sum(axis=0) + 0.5) / (table.sum() + 0.5 * len(table))
    back = 5.0  # the weight of the class's own share, in tokens
    return np.log10((table + back * share) / (table.sum(axis=1, keepdims=True) + back))


def _by_class(member: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    return np.bincount(member, values, k)


def _score(model: Model):
    base_of = lambda c: np.log10((c + 0.5) / (model.n_tokens + 0.5 * (model.n_distinct + 1)))
    classes = Classes(model.units, model.class_of_unit, model.head, model.head_class)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        uid = (context.partitionId() if context else 0) << 40
        for batch in batches:
            for chunk in text_chunks(batch.column(1)):
                token, unit, at, own, before, bounds = classes.tokens(chunk)
                known = at >= 0
                c = np.where(known, model.head_count[at] if len(model.head) else 0, 0)
                named = known & (model.head_class[at] >= 0 if len(model.head) else False) | (token == END)
                emitted = np.where(named, model.head_log[at] if len(model.head) else 0, model.unit_log[unit] + np.where(known, np.log10(c + 0.5), 0))
                emitted = np.where(token == END, model.unit_log[0], emitted)
                base = np.where(known, base_of(c), 0)
                sums = [np.add.reduceat(x, bounds[:-1]) for x in (model.after[before, own] + emitted, base, (c > 0).astype(np.int64))]
                # tokens outside the head, if there are more words than it holds
                rest = np.flatnonzero(~known)
                row = np.searchsorted(bounds, rest, side="right") - 1
                key = np.lexsort((token[rest], row))
                r, w = row[key], token[rest][key]
                new = np.ones(len(key), dtype=bool)
                new[1:] = (r[1:] != r[:-1]) | (w[1:] != w[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(key)))
                cuts = np.searchsorted(r[first], np.arange(len(bounds))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (w[first].view(np.int64), times)]
                n = len(bounds) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid + np.arange(n)), batch.column(0)[chunk.first : chunk.last], pa.array(np.diff(bounds)), *(pa.array(x) for x in sums), *lists],
                    ["uid", "doc_id", "n_tokens", "score", "base_score", "n_known", "words", "times"],
                )
                uid += n

    return score


def _head(vocabulary: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words and their counts, at most ``limit`` of them, the most frequent first.

    Counts are put into bins, 16 for each doubling; the head has whole bins, so no more than it comes to the driver.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(vocabulary.groupBy(level.alias("level")).count().collect(), reverse=True)  # 1024 rows at most
    held = np.cumsum([r["count"] for r in sizes])
    levels = [r.level for r, n in zip(sizes, held) if n <= limit]
    if not levels:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    rows = vocabulary.where(level >= min(levels)).select("word", "n").toArrow()
    words, n = rows["word"].to_numpy().view(U64), rows["n"].to_numpy()
    order = np.lexsort((words, -n))
    return words[order], n[order]


def train(learnt: DataFrame, vocabulary: DataFrame, bounds: Bounds) -> Model:
    """The model of the texts ``learnt`` (one column), whose words ``vocabulary`` (word, suffix, n) has counted."""
    spark = vocabulary.sparkSession
    n_tokens, n_distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words, counted = _head(vocabulary, bounds.head_words)
    own = words[words != END][: bounds.unit_words]
    among = lambda x: F.broadcast(spark.createDataFrame(pa.table({"word": x.view(np.int64)})))  # noqa: E731  never more than the head
    by_suffix = lambda x: vocabulary.join(among(x), "word", "left_anti").where("suffix >= 0").groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    suffixes = np.array([r.suffix for r in by_suffix(own).orderBy(F.desc("n"), "suffix").limit(bounds.suffixes).collect()], dtype=np.int64)
    units = Units(own, suffixes)

    pairs = np.zeros(units.n * units.n)  # at most that many rows come
    found = learnt.mapInArrow(_count_pairs(units), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs[found["pair"].to_numpy()] = found["n"].to_numpy()
    pairs = pairs.reshape(units.n, units.n)
    of_unit = exchange(pairs, bounds.classes, bounds.sweeps)
    k = int(of_unit.max()) + 1

    # classes of words in the head: by exchange, or by neighbours, or none
    order = np.argsort(words)
    head, count = words[order], counted[order]
    of_head = np.full(len(head), -1, dtype=np.int16)
    at, by_exchange = Units._find(units.words, head)
    of_head[by_exchange] = of_unit[1 + units.word_order[at[by_exchange]]] if len(own) else 0
    asked = ~by_exchange & (count >= bounds.least) & (head != END)
    if asked.any():
        onehot = np.eye(k)[of_unit]
        table = onehot.T @ pairs @ onehot
        after = transitions(table)
        size = -np.log10(_by_class(of_unit, pairs.sum(axis=0), k) + 1)
        counts = learnt.mapInArrow(_count_neighbours(Classes(units, of_unit, head, of_head), asked), "place long, neighbour int, n long").groupBy("place", "neighbour").agg(F.sum("n").alias("n"))
        lists = counts.groupBy("place").agg(F.collect_list(F.struct("neighbour", "n")).alias("neighbours"))  # two for each class at most
        best = lists.mapInArrow(_best_class(k, after, after, size), "place long, class short").toArrow()
        of_head[best["place"].to_numpy()] = best["class"].to_numpy()

    classes = Classes(units, of_unit, head, of_head)
    table = np.zeros(k * k)
    found = learnt.mapInArrow(_count_classes(classes), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most k * k rows
    table[found["pair"].to_numpy()] = found["n"].to_numpy()

    # what is left to the units: tokens and words without a class of their own, by the units' last bytes
    left = by_suffix(head[of_head >= 0]).withColumn("kept", F.col("suffix").isin([int(x) for x in suffixes]))
    sums = {r[0]: (r[1], r[2]) for r in left.groupBy(F.when(F.col("kept"), F.col("suffix")).alias("suffix")).agg(F.sum("n"), F.sum("k")).collect()}  # a row for each unit
    tokens, kinds = np.zeros(units.n), np.zeros(units.n)
    tokens[0] = int(count[head == END].sum())
    for unit, key in enumerate([*suffixes.tolist(), None], 1 + units.n_words):
        tokens[unit], kinds[unit] = sums.get(key, (0, 0))
    named, held = of_head >= 0, np.r_[True, np.zeros(units.n_words, dtype=bool), np.ones(len(suffixes) + 1, dtype=bool)]
    size = _by_class(of_unit[held], tokens[held] + 0.5, k) + _by_class(of_head[named], count[named] + 0.5, k)
    size = np.maximum(size, 0.5)  # a class that words have left
    unit_log = np.log10((tokens + 0.5) / size[of_unit])
    unit_log[1:] -= np.log10(tokens[1:] + 0.5 * (kinds[1:] + 1))  # half for each of its words and for one unseen
    head_log = np.log10((count + 0.5) / size[np.maximum(of_head, 0)])
    return Model(units, of_unit, transitions(table.reshape(k, k)), unit_log, head, count, of_head, head_log, int(n_tokens), int(n_distinct))


def score_texts(docs: DataFrame, learnable: Callable[[Column], Column], text: str = "text", doc_id: str = "doc_id", bounds: Bounds = Bounds()) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``.

    Tokens are lower-cased words and one end. ``base_score`` is the log10 probability of the text by word counts alone,
    ``score`` that by the class model; both learn from the rows that ``learnable`` (a condition on the id) names, all of
    them; rows without an id are none of those. Null and empty texts have the end only. Repeated rows are scored alike; ties
    of frequency go by word hashes. Very long texts are scored whole; a task needs some 100 bytes for each word of its
    longest. Other columns are ignored. If nothing can be learnt from, as in an empty table, all probabilities are those of
    unseen words.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    learnt = rows.where(learnable(F.col("doc_id"))).select("text")
    counts = learnt.mapInArrow(_count_words, "word long, suffix long, n long").groupBy("word").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"))
    vocabulary = saved(counts, "vocabulary")
    model = train(learnt, vocabulary, bounds)
    n_tokens, n_distinct = model.n_tokens, model.n_distinct
    kinds = "uid long, doc_id long, n_tokens long, score double, base_score double, n_known long, words array<long>, times array<long>"
    scored = saved(rows.mapInArrow(_score(model), kinds), "scored")

    # words outside the head: each has its count in the vocabulary, or none at all
    tail = vocabulary.select("word", F.col("n").alias("c"))
    rare = scored.select("uid", F.explode(F.arrays_zip("words", "times")).alias("t")).select("uid", F.col("t.words").alias("word"), F.col("t.times").alias("times"))
    met = rare.join(tail, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    of_doc = met.groupBy("uid").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("logs"),
        F.sum("times").alias("tokens"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"),
    )
    base_total = float(np.log10(n_tokens + 0.5 * (n_distinct + 1)))
    zero = F.lit(0.0)
    return scored.drop("words", "times").join(of_doc, "uid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(int(n_tokens)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("logs", zero) - F.coalesce("tokens", F.lit(0)) * base_total).alias("base_score"),
        (F.col("score") + F.coalesce("logs", zero)).alias("score"),
    )
