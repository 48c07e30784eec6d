"""Files of a repository: which are code of its own, what changed, and what is gone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import raw_hash
from ..storage import merged

# Results must agree with them. A harness's own folder is added by the caller.
SKIPPED_DIRS = (
    ".git", ".hg", ".svn", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".venv", "venv", "env",
    "node_modules", "dist", "build", "site-packages", ".eggs", "htmlcov", ".idea", ".vscode",
)
PROJECT_FILES = ("pyproject.toml", "setup.py", "setup.cfg", "Cargo.toml")
LARGEST_FILE = 1_000_000


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, text`` of all files below a folder that have bytes; paths are relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/") + "/"
    return files.select(F.substring_index("path", prefix, -1).alias("path"), F.col("content").cast("string").alias("text"))


def own_files(files: DataFrame, extra_skipped: tuple[str, ...] = ()) -> DataFrame:
    """Files outside the skipped folders."""
    return files.where(~F.arrays_overlap(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), F.array(*map(F.lit, SKIPPED_DIRS + extra_skipped))))


def nested_projects(files: DataFrame) -> DataFrame:
    """``folder`` of each project inside the repository."""
    name, folder = F.substring_index("path", "/", -1), F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    return files.where(name.isin(*PROJECT_FILES) & F.contains("path", F.lit("/"))).select(folder.alias("folder")).distinct()


def outcomes(files: DataFrame, known: DataFrame, largest: int | None = LARGEST_FILE) -> DataFrame:
    """``path, outcome`` for each file: why it is skipped, or whether its text is new, changed or as ``known(path, hash)``. With
    None for ``largest`` no file is too large.

    A file below a nested project is vendored; its folders are listed and looked up, so no pairs of files and projects arise.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    vendored = files.select("path", F.explode(above).alias("folder")).join(nested_projects(files), "folder", "left_semi").select("path").distinct().withColumn("_vendored", F.lit(True))
    hashed = files.withColumn("hash", raw_hash(F.col("text"))).join(vendored, "path", "left").join(known.select("path", F.col("hash").alias("_known")), "path", "left")
    outcome = (
        F.when(~F.col("path").endswith(".py"), "suffix")
        .when(F.col("_vendored"), "vendored")
        .when(F.lit(False) if largest is None else F.octet_length("text") > largest, "too large")
        .when(F.col("_known").isNull(), "new")
        .when(F.col("_known") == F.col("hash"), "unchanged")
        .otherwise("changed")
    )
    return hashed.select("path", outcome.alias("outcome"))


def vanished(files: DataFrame, known: DataFrame) -> DataFrame:
    return known.join(files.select("path"), "path", "left_anti").select("path")


def coverage(outcomes_: DataFrame) -> DataFrame:
    """One row: files in the graph, out of scope and failed, and the share of those in scope that is in the graph."""
    count = lambda *names: F.sum(F.col("outcome").isin(*names).cast("long"))
    sums = outcomes_.agg(count("new", "changed", "unchanged").alias("in_graph"), count("suffix", "vendored").alias("out_of_scope"), count("too large", "syntax").alias("failed"))
    scope = F.col("in_graph") + F.col("failed")
    return sums.withColumn("coverage", F.when(scope > 0, F.round(F.col("in_graph") / scope, 4)).otherwise(F.lit(1.0)))


def forget(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id, path, ...)`` and edges ``(source, target, ...)`` without those of the given files."""
    gone = merged(nodes, paths, "path", "left_semi").select(F.col("id").alias("_gone"))
    left = edges
    for end in ("source", "target"):
        left = merged(left, gone.toDF(end), end, "left_anti")
    return merged(nodes, paths, "path", "left_anti"), left.select(*edges.columns)
