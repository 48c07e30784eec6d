"""A code graph that is brought up to date file by file: only files whose text has changed are parsed again."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import raw_hash
from ..operators import codegraph
from ..storage import saved
from . import repository
from .keyed import KeyedTable

FILES = "path string, hash string, ingested_at timestamp"


class GraphStore(NamedTuple):
    """Parsed rows and file hashes below one shared folder. What names mean is found when the graph is read, from the rows of all
    files, so it can't be out of date. Files of more than ``largest`` bytes are left out; with None no file is too large."""

    root: str
    buckets: int = 64
    largest: int | None = repository.LARGEST_FILE

    @property
    def parsed(self) -> KeyedTable:
        return KeyedTable(f"{self.root}/parsed", "path", codegraph.ROWS, self.buckets)

    @property
    def files(self) -> KeyedTable:
        return KeyedTable(f"{self.root}/files", "path", FILES, self.buckets)

    def ingest(self, files: DataFrame, force: bool = False, extra_skipped: tuple[str, ...] = ()) -> DataFrame:
        """Brings the store to the state of ``files(path, text)`` and gives ``path, outcome`` for each file.

        Outcomes are those of :func:`repository.outcomes`, and ``syntax`` and ``vanished``. New and changed files are parsed
        (with ``force`` all that are in scope); the rows of a changed file go before its new ones come, those of a file that
        is gone go for good. A file that is listed but can't be read, is too large, doesn't parse or has left the scope keeps
        what its last good text gave. Hashes are written last, so a run that was cut off is done again by the next.
        """
        spark = files.sparkSession
        listed = repository.own_files(files.where("path IS NOT NULL"), extra_skipped).dropDuplicates(["path"])
        known = self.files.read(spark)
        found = saved(repository.outcomes(listed, known.where("false") if force else known, self.largest), "outcomes")
        due = listed.join(found.where("outcome IN ('new', 'changed')"), "path", "left_semi")
        sized = {} if self.largest == codegraph.LARGEST_FILE else {"largest": None}  # which are too large is settled by their outcomes
        parsed = saved(codegraph.parse(due, **sized), "parsed")
        bad = parsed.where("row = 'skipped'").select("path", F.col("kind").alias("_bad"))
        gone = saved(repository.vanished(listed, known), "vanished")
        good = due.join(bad, "path", "left_anti")
        keys = good.select("path").unionByName(gone)
        self.parsed.replace(keys, parsed.where("row <> 'skipped'"))
        self.files.replace(keys, good.select("path", raw_hash(F.col("text")).alias("hash"), F.current_timestamp().alias("ingested_at")))
        report = found.join(bad, "path", "left").select("path", F.coalesce("_bad", "outcome").alias("outcome"))
        return report.unionByName(gone.select("path", F.lit("vanished").alias("outcome")))

    def graph(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges; see :func:`codegraph.code_graph`."""
        return codegraph.code_graph(self.parsed.read(spark))

    def file_hash(self, spark: SparkSession, paths: DataFrame) -> DataFrame:
        """``path, hash`` of those of ``paths(path)`` that are in the store."""
        return self.files.read(spark).join(paths.select("path").distinct(), "path", "left_semi").select("path", "hash")

    def nodes_in_file(self, spark: SparkSession, path: str) -> DataFrame:
        """The definitions of a file in the order of their lines; its bucket alone is read."""
        own = self.parsed._read(spark).where((F.col("path") == path) & (F.col("_bucket") == F.pmod(F.xxhash64(F.lit(path)), F.lit(self.buckets))))
        return codegraph.nodes_of(own).orderBy("line", "id")

    def forget(self, paths: DataFrame) -> None:
        """Removes files ``(path)`` with all that they gave; references to them stay, without a definition."""
        spark = paths.sparkSession
        for table in (self.files, self.parsed):
            table.replace(paths, spark.createDataFrame([], table.schema))

    def clear(self, spark: SparkSession) -> None:
        for table in (self.files, self.parsed):
            table.clear(spark)
