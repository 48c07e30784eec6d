"""Phrases whose words stand together more often than chance, mined level by level.

Pass k counts k-grams, but only those whose two (k-1)-grams are both frequent; the frequent ones of the pass before are
broadcast as a filter of bits whose size is bounded whatever their number. Such a filter takes no frequent gram for a rare
one, so all counts at or over the threshold are exact; a rare gram that it lets through is counted and then goes. Counting
is by text, never by hash: inside a batch words are numbered by a dictionary and grams by pairs of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import dropped, saved
from .words import LOWER, U64, Chunk, find_words, mix, span_hashes, text_chunks

#: Bytes of text that are counted together in a task.
CHUNK = 6 << 20
#: Bits of the filter for each frequent gram, and its largest size in words of 64 bits (32 MB).
BITS_EACH = 32
MOST_WORDS = 1 << 22
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[0x20] = True
_FACTOR = np.random.Generator(np.random.PCG64(99)).integers(0, 2**64, 16, dtype=U64) | U64(1)


def _lang_hash(lang: str) -> np.uint64:
    raw = np.frombuffer(lang.encode(), dtype=np.uint8)
    return span_hashes(raw, np.array([0]), np.array([len(raw)]))[0]


def _gram_hash(lang: np.uint64 | np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of grams from their words' hashes (a row for each gram)."""
    return mix(lang + (words * _FACTOR[: words.shape[1]]).sum(axis=1, dtype=U64))


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte spans as an Arrow array."""
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    kept = data[np.cumsum(inside[:-1]).astype(bool)]
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(kept))


def _numbered(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Each word's number, whether the next word follows it in one piece, the words, and their hashes."""
    data = LOWER[chunk.data]
    start, end, of_doc = find_words(data, chunk.offsets, _GAP)
    if not len(start):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), pa.array([], pa.large_string()), np.zeros(0, dtype=U64)
    coded = _strings(data, start, end).dictionary_encode()
    words = coded.dictionary
    breaks = np.concatenate(([0], np.cumsum(_BREAK[data])))
    joined = np.zeros(len(start), dtype=bool)
    joined[:-1] = breaks[start[1:]] == breaks[end[:-1]]
    last = of_doc[1:][np.diff(of_doc) > 0] - 1
    joined[last] = False
    _, offsets, text = words.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    return coded.indices.to_numpy().astype(np.int64), joined, words, span_hashes(np.frombuffer(text, dtype=np.uint8), at[:-1], at[1:])


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & U64(64 * len(bits) - 1)
    return (bits[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1) > 0


def counted(chunk: Chunk, lang: np.uint64, filters: list[np.ndarray]) -> tuple[pa.Array, np.ndarray]:
    """The chunk's grams of ``len(filters) + 1`` words whose both subgrams pass, as texts, and how often each occurs."""
    number, joined, words, hashes = _numbered(chunk)
    gram, width, member = number, len(words), np.arange(len(words))[:, None]  # member: the words of each gram by its number
    at = np.arange(len(number))
    for bits in filters:
        if not len(gram):
            break
        passes = np.append(_has(bits, _gram_hash(lang, hashes[member])), False)
        if len(at):
            place = np.full(len(number) + 1, -1, dtype=np.int64)  # the gram that begins at each word
            place[at] = gram
            size = member.shape[1]
            ends = at + size
            ok = passes[gram] & (ends < len(number))
            at, gram, ends = at[ok], gram[ok], ends[ok]
            ok = joined[ends - 1] & passes[place[at + 1]]
            at, gram, ends = at[ok], gram[ok], ends[ok]
        key, first, gram = np.unique(gram * width + number[ends], return_index=True, return_inverse=True)
        member = np.column_stack((member[key // width], key % width)) if len(key) else np.zeros((0, member.shape[1] + 1), dtype=np.int64)
    counts = np.bincount(gram, minlength=len(member))
    texts = [words.take(pa.array(member[:, k])) for k in range(member.shape[1])]
    return (pc.binary_join_element_wise(*texts, pa.scalar(" ", pa.large_string())) if len(texts) > 1 else texts[0]), counts


_COUNTS = "lang string, phrase string, n long"


def _count(filters: list):
    """Counts of grams by language; at the first level also a row without a phrase that counts all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [f.value for f in filters]
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = batch.column(1).filter(pa.array(langs.indices.to_numpy() == k)) if len(langs.dictionary) > 1 else batch.column(1)
                key = _lang_hash(lang)
                for chunk in text_chunks(own, CHUNK):
                    phrase, n = counted(chunk, key, bits)
                    phrase = phrase.cast(pa.string())
                    if not bits and len(n):
                        phrase, n = pa.concat_arrays([phrase, pa.array([""])]), np.append(n, n.sum())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), phrase, pa.array(n, pa.int64())], ["lang", "phrase", "n"])

    return count


def _bit_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1), CHUNK):
                start, end, of_doc = find_words(chunk.data, chunk.offsets, _SPACE)
                size = int(of_doc[1]) if len(of_doc) > 1 else 1  # all phrases of a level have as many words
                langs = batch.column(0)[chunk.first : chunk.last].dictionary_encode()
                lang = np.array([_lang_hash(x) for x in langs.dictionary.to_pylist()], dtype=U64)[langs.indices.to_numpy()]
                slot = _gram_hash(lang, span_hashes(chunk.data, start, end).reshape(-1, size)) & U64(64 * words - 1)
                place, which = (slot >> U64(6)).astype(np.int64), np.left_shift(U64(1), slot & U64(63)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(which)], ["place", "bits"])

    return rows


def _filter(frequent: DataFrame) -> np.ndarray:
    """The frequent grams as bits: a power of two of words, about BITS_EACH bits a gram, MOST_WORDS words at most."""
    words = 1 << max(0, min(MOST_WORDS, frequent.count() * BITS_EACH // 64 + 1).bit_length() - 1)
    set_bits = frequent.select("lang", "phrase").mapInArrow(_bit_rows(words), "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(words, dtype=U64)
    bits[set_bits["place"].to_numpy()] = set_bits["bits"].to_numpy().view(U64)
    return bits


def _cut(phrase: str, k: int, words: int) -> tuple:
    return F.substring_index(phrase, " ", k), F.substring_index(phrase, " ", k - words)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, best: int = 2000) -> DataFrame:
    """The ``best`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased in A-Z, cut at ``.,;:!?`` and at line ends, and the pieces cut at spaces and tabs. A phrase of 2
    to ``longest`` words with ``a >= least`` occurrences scores ``1000 * a * n // (l * r)`` at its weakest cut (the first
    of equal ones), where ``l`` and ``r`` count the parts and ``n`` all words. Phrases that never occur but inside a longer
    one are dropped: counts can't rise with length, so those are the ones with a phrase of one more word that holds them
    and has the same count.

    Null texts are empty, null languages are ``und``, repeated rows count each time, and ties in rank go by count and then
    by the bytes of the phrase. Other columns are ignored; an empty table gives an empty result. Very long texts are counted
    whole: a task holds some 60 bytes for each byte of its longest text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    filters, levels, total = [], [], None
    for size in range(1, longest + 1):
        counts = rows.mapInArrow(_count(list(filters)), _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        counts = saved(counts.where((F.col("n") >= least) | (F.col("phrase") == "")), f"grams-{size}")
        if total is None:
            total = counts.where("phrase = ''").select("lang", F.col("n").alias("all"))
        levels.append(counts.where("phrase <> ''"))
        if size < longest:
            filters.append(spark.sparkContext.broadcast(_filter(levels[-1])))

    part = None
    for level in levels[:-1]:
        part = level if part is None else part.unionByName(level)
    cuts = None
    for words, level in enumerate(levels[1:], 2):
        for k in range(1, words):
            left, right = _cut("phrase", k, words)
            one = level.select("lang", "phrase", F.col("n").alias("a"), F.lit(k).alias("k"), left.alias("left"), right.alias("right"))
            cuts = one if cuts is None else cuts.unionByName(one)
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]).join(total, "lang")
    wide = {x: F.col(x).cast("decimal(18,0)") for x in ("a", "l", "r", "all")}
    cuts = cuts.withColumn("over", wide["a"] * wide["all"] * F.lit(1000).cast("decimal(4,0)")).withColumn("under", wide["l"] * wide["r"])
    weakest = cuts.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.max("all").alias("n"))

    inner = None
    for words, level in enumerate(levels[2:], 3):
        for held in (F.substring_index("phrase", " ", words - 1), F.substring_index("phrase", " ", 1 - words)):
            one = level.select("lang", held.alias("phrase"), "n")
            inner = one if inner is None else inner.unionByName(one)
    if inner is not None:
        inner = inner.groupBy("lang", "phrase").agg(F.max("n").alias("inside"))
        weakest = weakest.join(inner, ["lang", "phrase"], "left").where(F.coalesce(F.col("inside"), F.lit(0)) < F.col("a"))
    scored = weakest.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    # the best of each part first, so that no task ranks all phrases of a language
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    scored = saved(scored, "phrases").withColumn("part", F.spark_partition_id())
    near = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
