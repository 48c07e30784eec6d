"""Five stages from raw documents to packed sequences, each by one of the operators of quillspark.llm.

A stage takes the documents that its predecessor kept and gives documents with the same columns; the last gives the packed
pieces. Near-duplicates are found on five-word shingles with a similarity of 0.8 or more.

What every stage does with odd rows: null, empty and very long texts are documents like others, and are kept unless they are
toxic, near copies or leaks; null ids, languages and sources are values like others; of rows that are the same in id and text the
near-duplicate stage keeps one, and ties go by the smallest id; an empty table gives an empty one; columns beside those of
documents are left behind. Without labels nothing is toxic, without benchmark items nothing leaks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.decontaminate import decontaminate
from quillspark.llm.line_dedup import dedup_lines
from quillspark.llm.near_dedup import near_duplicates
from quillspark.llm.packing import pack
from quillspark.llm.queries import table, tokenizer_path
from quillspark.llm.storage import dropped, saved
from quillspark.llm.toxicity import remainder, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.3; labels are learnt only from rows that op8_toxicity learns from."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), learnable=lambda x: remainder(x, 4) != 2, keep=("text", "lang", "source", "n_chars"))
    return scored.where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that spread over many sites; ``n_chars`` follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id; of repeated rows one."""
    found = near_duplicates(docs, shingle_words=5, similarity=0.8)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct().hint("merge")  # grows with the corpus
    # rows with one id and one text are one document; two hashes, as one of 64 bits is not enough for very many texts
    keyed = docs.withColumns({"_a": F.xxhash64("text"), "_b": F.xxhash64(F.lit("b"), F.col("text"))})
    left = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_a") == F.col("_hash")), "left_anti")
    return left.dropDuplicates(["doc_id", "_a", "_b"]).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), shingle_words=5, containment=0.8).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return pack(docs, tokenizer_path(), longest=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: A learnt classifier and a tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again before the next, and deleted once the next
    one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
