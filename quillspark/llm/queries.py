"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import share_package
from .collocations import collocations
from .decontaminate import contained_items
from .html_text import main_texts
from .line_dedup import dedup_lines
from .lm_scoring import score_texts
from .near_dedup import near_duplicates
from .packing import pack
from .prefix_trie import prefix_trie
from .quality import rate_quality
from .quality_classifier import score_quality
from .secrets import scan_secrets
from .sharding import shard_by_bytes
from .toxicity import remainder, score_toxicity


def tokenizer_path() -> str:
    """The public vocabulary that packing counts in."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return share_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(divisor: int, rest: int) -> Column:
    """Whether a row is held out; one without an id isn't, though nothing is learnt from it either."""
    return F.coalesce(remainder(F.col("doc_id"), divisor) == rest, F.lit(False)).alias("held_out")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=40)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shingle_words=5, containment=0.8)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), learnable=lambda x: remainder(x, 5) != 1)
    return scored.select("doc_id", held_out(5, 1), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), longest=1024)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, similarity=0.8)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learnable=lambda x: remainder(x, 4) != 2)
    return scored.select("doc_id", held_out(4, 2), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_quality(table(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learnable=lambda x: remainder(x, 3) != 1)
    return scored.select("doc_id", held_out(3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=100, longest=5, best=2000)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_html_text": op4_html_text,
    "op5_packing": op5_packing,
    "op6_near_dedup": op6_near_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_secrets": op9_secrets,
    "op10_quality": op10_quality,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_collocations": op12_collocations,
    "op13_prefix_trie": op13_prefix_trie,
}
