"""Whole trees of files: a digest for every folder, and what changed between two versions as text that can be applied."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import folders

#: Digits of a path's hash that deal a folder's files into groups: 4,096, so no folder is ever joined up in one row.
GROUP_DIGITS = 3


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, content`` (bytes) of all files below a folder; paths are relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.substring_index("path", root.rstrip("/") + "/", -1).alias("path"), "content")


def tree_digests(files: DataFrame) -> DataFrame:
    """``folder, files, bytes, digest`` for every folder of ``files(path, content)`` and all that lies below it; the root is empty.

    Two folders have one digest if and only if they have the same files below them, by relative path and content; neither order
    nor the folder's own name matters. A folder's files are dealt by the hash of their relative path; each group's lines (path and
    SHA-256 of the content, in the order of the paths) have a digest, and the folder's is that of its groups' digests in their
    order. Of rows with one path the one with the smallest hash counts. Null contents are empty, rows without a path are left out.
    """
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    hashed = files.where("path IS NOT NULL").select("path", F.sha2(content, 256).alias("sha"), F.octet_length(content).cast("long").alias("size"))
    hashed = hashed.groupBy("path").agg(F.min(F.struct("sha", "size")).alias("x")).select("path", "x.*")
    spread = hashed.select("sha", "size", "path", F.explode(folders(F.col("path"))).alias("folder"))
    relative = F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substring(path, length(folder) + 2)"))
    spread = spread.withColumn("rel", relative).withColumn("group", F.substring(F.sha2("rel", 256), 1, GROUP_DIGITS))
    line = F.transform(F.sort_array(F.collect_list(F.struct("rel", "sha"))), lambda x: F.concat(x["rel"], F.lit("\0"), x["sha"], F.lit("\n")))
    groups = spread.groupBy("folder", "group").agg(F.sha2(F.array_join(line, ""), 256).alias("sha"), F.count("*").alias("n"), F.sum("size").alias("size"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("group", "sha"))), lambda x: F.concat(x["group"], F.lit(":"), x["sha"], F.lit("\n"))), "")
    return groups.groupBy("folder").agg(F.sum("n").alias("files"), F.sum("size").alias("bytes"), F.concat(F.lit("sha256:"), F.sha2(joined, 256)).alias("digest"))


def _lines(content: bytes | None) -> list[str]:
    parts = (content or b"").decode().split("\n")
    return [x + "\n" for x in parts[:-1]] + [x for x in parts[-1:] if x]


def _unified(path: str, before: bytes | None, after: bytes | None) -> str:
    """One file's part of a patch; a last line without an end is marked."""
    head = f"diff --git a/{path} b/{path}\n" + ("new file mode 100644\n" if before is None else "deleted file mode 100644\n" if after is None else "")
    lines = difflib.unified_diff(_lines(before), _lines(after), "/dev/null" if before is None else f"a/{path}", "/dev/null" if after is None else f"b/{path}")
    return head + "".join(x if x.endswith("\n") else x + "\n\\ No newline at end of file\n" for x in lines)


def _is_text(content: bytes | None) -> bool:
    try:
        (content or b"").decode()
    except UnicodeDecodeError:
        return False
    return True


def _diffs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, before, after, was, now in zip(*(c.to_pylist() for c in batch.columns)):
            before, after = before if was else None, after if now else None
            change = "added" if not was else "deleted" if not now else "changed"
            text = all(map(_is_text, (before if was else b"", after if now else b"")))
            out.append((path, change, _unified(path, (before or b"") if was else None, (after or b"") if now else None) if text else None))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], ["path", "change", "diff"])


def tree_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, change, diff`` of the files ``(path, content)`` that differ between two versions: added, deleted or changed, with a
    unified diff of their lines. Joined in the order of the paths the diffs are a patch that makes the second version of the first.

    Files that aren't UTF-8 text can't be told as lines: they have a null diff, and are never left out. Paths are unique in each
    version. A task holds the two versions of one file.
    """
    one = before.where("path IS NOT NULL").select("path", F.col("content").cast("binary").alias("before"), F.lit(True).alias("was"))
    two = after.where("path IS NOT NULL").select("path", F.col("content").cast("binary").alias("after"), F.lit(True).alias("now"))
    both = one.join(two, "path", "full")
    there = lambda c: F.coalesce(c, F.lit(False))
    same = there(F.col("was")) & there(F.col("now")) & (F.coalesce("before", F.lit(b"")) == F.coalesce("after", F.lit(b"")))
    differ = both.where(~same).select("path", "before", "after", there(F.col("was")).alias("was"), there(F.col("now")).alias("now"))
    # comparing lines takes far longer than reading them, so the few files that differ are dealt over as many tasks as a shuffle has
    tasks = int(before.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return differ.repartition(tasks, F.xxhash64("path")).mapInArrow(_diffs, "path string, change string, diff string")
