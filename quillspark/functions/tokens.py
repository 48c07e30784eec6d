"""Exact token counts by a public vocabulary that is given by its path; the estimate, and a method that says so, without one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import MODEL_WINDOWS, TOKEN_METHOD, estimate_tokens


def is_exact(method: Column) -> Column:
    """Whether a count's method is a vocabulary and no estimate."""
    return F.startswith(method, F.lit("vocabulary:"))


def with_tokens(df: DataFrame, text: str, vocabulary: str | None = None) -> DataFrame:
    """``df`` with ``token_count`` and ``token_method``: by the vocabulary's ids, without special tokens, or by the estimate.

    The file is sent to the executors with the job. One that can't be read as a vocabulary gives the estimate, and the method says
    which it was; a run has one method throughout. Null and empty texts have no tokens.
    """
    exact = vocabulary is not None and _readable(vocabulary)
    if not exact:
        return df.withColumn("token_count", estimate_tokens(F.col(text))).withColumn("token_method", F.lit(TOKEN_METHOD))
    name = vocabulary.rpartition("/")[2]
    df.sparkSession.sparkContext.addFile(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(SparkFiles.get(name))
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = coder.encode_batch([x or "" for x in batch.column(at).to_pylist()], add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x.ids) for x in found], pa.int64())], [*batch.schema.names, "token_count"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(count, f"{kinds}, token_count long").withColumn("token_method", F.lit(f"vocabulary:{name}"))


def _readable(path: str) -> bool:
    try:
        from tokenizers import Tokenizer

        Tokenizer.from_file(path)
    except Exception:  # the library raises a bare Exception for a missing or broken file
        return False
    return True


def known_models() -> tuple[str, ...]:
    """The models whose windows are known, by the beginning of their names."""
    return tuple(name for name, _ in MODEL_WINDOWS)
