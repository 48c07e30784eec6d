"""Tables that cut lineage: written once into the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where it is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: lost executors lose none of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input, by sorting both. Spark's guess of a table's size comes from a few packed
    columns of the files below it, and what is exploded or generated from them can be a hundred times as large; by that guess it
    would send such a table whole through the driver to each executor, and keep to that plan once it sees the true size."""
    return left.join(right.hint("merge"), on, how)


#: Keys that are dealt over several tasks at most: any other is in a thousandth of all look-ups at most.
FREQUENT_KEYS = 1000


def first_known(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``found``, what ``known(key, value)`` has for the first of the columns ``keys`` that it has, and ``nth``, which of them
    that is, from 0; nulls if none. ``known`` has each key once.

    Very many rows may ask for one key, or for nothing. Rows of the most frequent keys, a stated number, and those that ask for
    nothing (any more) are dealt over as many parts as a shuffle has; each part gets a copy of what is known of these keys.
    """
    asked = rows.select(F.explode(F.array(*keys)).alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))
    often = [r.key for r in asked.orderBy(F.desc("n"), "key").limit(FREQUENT_KEYS).collect()]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    itself = F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int")
    copies = F.when(F.col("key").isin(often), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    copies = known.select(F.col("key").alias("_key"), F.col("value").alias("_value"), F.explode(copies).alias("_part"))
    met = rows.withColumns({"found": F.lit(None).cast(known.schema["value"].dataType), "nth": F.lit(None).cast("int")})
    for i, key in enumerate(keys):
        wanted = met.withColumn("_key", F.when(F.col("found").isNull(), F.col(key)))
        wanted = wanted.withColumn("_part", F.when(F.col("_key").isNull() | F.col("_key").isin(often), itself).otherwise(0))
        nth = F.coalesce("nth", F.when(F.col("_value").isNotNull(), F.lit(i)))
        met = merged(wanted, copies, ["_key", "_part"], "left").withColumns({"found": F.coalesce("found", "_value"), "nth": nth}).drop("_key", "_part", "_value")
    return met


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of saved tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
