"""Contiguous shards of nearly equal bytes, by global prefix sums over per-partition totals.

All steps are DataFrame operations. Rows are ordered by a hash of their text, so equal texts stand together, and dealt
into at most ``2 * CELLS + CELLS`` cells of that order, whatever the number of rows. Only the cells' totals are summed
up in one place; inside a cell a window adds the rest. A text that more than ``2 / CELLS`` of all rows share is cut
into several cells by document id, so copies never gather in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved

#: Cells of the global order: a fixed number, so the table of their totals is small however many rows there are.
CELLS = 4096
#: Texts with so many copies or fewer stay in one cell, however small the table.
SMALL_GROUP = 64
#: Bytes that each row takes besides its text.
ROW_BYTES = 16


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, none for null, with the row's own bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def _hash60(text: Column) -> Column:
    """The first 60 bits of a text's MD5, which SQL engines agree on."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def shard_by_bytes(docs: DataFrame, shards: int = 40, text: str = "text", doc_id: str = "doc_id", group_share: float = 0.01) -> DataFrame:
    """Each row of ``docs`` with its shard: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Cuts are at equal targets of the summed size. The law for equal texts, which stand side by side: a run of at most
    ``group_share`` of a shard goes whole to the shard that holds the run's middle; of a larger one each row goes to the
    shard that holds the row's middle. ``slot`` numbers a shard's rows without gaps. Null texts count as empty, repeated
    rows are rows of their own, null ids come first among equal texts, other columns are ignored, and an empty table gives
    an empty result. Ties of id and text are rows that can't be told apart. Very long texts: only their size and hashes
    are carried; one larger than a shard fills a shard alone.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = saved(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            text_bytes(F.col(text)).alias("size"),
            F.crc32(content.cast("binary")).alias("text_crc32"),
            _hash60(content).alias("group"),
            _hash60(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("tie"),
        ),
        "shard-rows",
    )
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()

    # at most CELLS / 2 groups are so large: the broadcast is bounded
    large = rows.groupBy("group").agg(F.count("*").alias("copies")).where(F.col("copies") > max(2 * n / CELLS, SMALL_GROUP))
    large = large.select("group", F.ceil(F.col("copies") * CELLS / max(n, 1)).cast("int").alias("parts"))
    celled = rows.join(F.broadcast(large), "group", "left").withColumn(
        "cell",
        F.struct(
            F.shiftright("group", 60 - CELLS.bit_length() + 1).alias("bucket"),
            F.when(F.col("parts").isNotNull(), F.col("group")).alias("large"),
            F.when(F.col("parts").isNotNull(), F.pmod("tie", "parts")).alias("part"),
        ),
    )
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = celled.groupBy("cell").agg(F.sum("size").alias("b"), F.count("*").alias("k"))
    totals = totals.select("cell", "b", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("rows_before"))
    # a large group's run goes through all of its cells
    of_large = Window.partitionBy("cell.large")
    totals = totals.withColumn("large_run", F.when(F.col("cell.large").isNotNull(), F.sum("b").over(of_large))).withColumn("large_begins", F.when(F.col("cell.large").isNotNull(), F.min("bytes_before").over(of_large)))

    inside = Window.partitionBy("cell").orderBy("group", "tie", "doc_id")
    group = Window.partitionBy("cell", "group")
    placed = (
        celled.join(F.broadcast(totals), "cell")
        .withColumn("begins", F.col("bytes_before") + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("at", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("run", F.coalesce("large_run", F.sum("size").over(group)))
        .withColumn("whole", F.col("run") <= F.lit(group_share * total / shards))
        .withColumn("middle", F.when(F.col("whole"), 2 * F.coalesce("large_begins", F.min("begins").over(group)) + F.col("run")).otherwise(2 * F.col("begins") + F.col("size")))
        .withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"middle * {shards} div {2 * max(total, 1)}")).cast("int"))
    )
    placed = saved(placed.select("doc_id", "size", "text_crc32", "shard", "at"), "shard-placed")
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # one row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("at") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
