"""Tables in shared folders that change key by key."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import dropped, saved

BUCKET = "_bucket"


class KeyedTable(NamedTuple):
    """Rows in Parquet files, dealt by a hash of their key into buckets; a change rewrites the buckets of the keys that it names.

    The number of buckets is fixed when a table is first written: choose it so that a bucket is a few files of a good size.
    """

    path: str
    key: str
    schema: str
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _read(self, spark: SparkSession) -> DataFrame:
        schema = f"{self.schema}, {BUCKET} int"
        try:
            return spark.read.schema(schema).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows; none where nothing has been written."""
        return self._read(spark).drop(BUCKET)

    def replace(self, keys: DataFrame, rows: DataFrame) -> None:
        """The rows of ``keys`` (a column named as the key) go and ``rows`` come; rows of a key not named are added to those it has.

        New buckets are written in full before old ones are exchanged for them, and the same call again gives the same table
        if one was cut off in between, as long as ``keys`` names all keys of ``rows``. Null keys are refused.
        """
        spark = rows.sparkSession
        rows = rows.select(*[x for x in spark.createDataFrame([], self.schema).columns])
        keys = keys.select(self.key).distinct()
        if not rows.where(F.col(self.key).isNull()).isEmpty():
            raise ValueError(f"a row has no {self.key}")
        named = keys.unionByName(rows.select(self.key)).select(self.bucket().alias(BUCKET)).distinct()
        touched = [r[0] for r in named.collect()]  # as many as there are buckets, at most
        left = self._read(spark).where(F.col(BUCKET).isin(touched)).join(keys, self.key, "left_anti") if touched else self._read(spark).where("false")
        staged = saved(left.unionByName(rows.withColumn(BUCKET, self.bucket())), "staged")
        filled = {r[0] for r in staged.select(BUCKET).distinct().collect()}
        staged.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        for bucket in set(touched) - filled:
            self._delete(spark, f"{self.path}/{BUCKET}={bucket}")
        dropped(staged)

    def upsert(self, rows: DataFrame, order: tuple[str, ...] = ()) -> None:
        """Each row takes the place of the one with its key; of rows with one key the last by ``order`` stands."""
        if order:
            last = F.row_number().over(Window.partitionBy(self.key).orderBy(*[F.col(c).desc() for c in order]))
            rows = rows.withColumn("_n", last).where("_n = 1").drop("_n")
        self.replace(rows.select(self.key), rows)

    def clear(self, spark: SparkSession) -> None:
        self._delete(spark, self.path)

    @staticmethod
    def _delete(spark: SparkSession, folder: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
