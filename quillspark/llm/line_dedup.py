"""Removal of lines that spread over many sites: HyperLogLog sketches first, exact counts near the threshold.

All steps are DataFrame operations. Sketches of the sites of each line merge by aggregation; only lines whose estimate
lies near the threshold get exact distinct counts. A text that stands on many sites as a whole is one text, and counts
for its first site only: copies are no boilerplate, near-duplicate removal decides on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import saved

#: Removed lines are dealt over so many salts before the join with all lines, as one line can stand in most documents.
SALTS = 32


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def spread_lines(lines: DataFrame, min_sites: int = 5, band: float = 0.25, lg_k: int = 10) -> DataFrame:
    """Hashes ``line`` of the lines that stand on at least ``min_sites`` distinct sites, given rows ``(line, site)``.

    A sketch with ``2 ** lg_k`` registers has a standard error of about ``1.04 / 2 ** (lg_k / 2)``; estimates nearer to the
    threshold than the share ``band`` of it (eight standard errors by default) are replaced by exact counts.
    """
    spread = saved(lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sites")).select("line", F.hll_sketch_estimate("sites").alias("sites")).where(F.col("sites") > min_sites * (1 - band) - 1), "line-spread")
    sure = spread.where(F.col("sites") > min_sites * (1 + band)).select("line")
    near = spread.where(F.col("sites") <= min_sites * (1 + band)).select("line")
    counted = lines.join(_salted(near), ["line", "salt"], "left_semi").select("line", "site").distinct()
    exact = counted.groupBy("line").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("line")
    return sure.unionByName(exact)


def _salted(lines: DataFrame) -> DataFrame:
    salted = lines.select("line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return salted.hint("merge")  # its size grows with the corpus: never broadcast


def dedup_lines(docs: DataFrame, min_sites: int = 5, text: str = "text", doc_id: str = "doc_id", site: str = "source") -> DataFrame:
    """``docs`` with ``text`` cleaned of the lines that stand on ``min_sites`` sites or more, ``n_lines`` and ``n_removed``.

    Lines are compared without leading and trailing spaces; lines of nothing else stay. Equal texts count once, for the
    smallest of their sites. A null text stays null with no lines; a null site is one site; repeated rows are all kept;
    other columns pass through, except that columns named like the results are replaced. Very long texts: a row's lines
    are one array, a few times the text's size. There are no ties, and an empty table gives an empty result.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # the row's own columns stay inside a struct, so none can clash with those made here
    rows = docs.select(F.struct(*columns).alias("row"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.xxhash64(text).alias("whole"))
    rows = rows.withColumn("key", F.xxhash64(F.col("row")[doc_id], "whole", "site"))
    content = F.col("row")[text]
    hashed = lambda line: F.xxhash64(F.trim(line))
    eligible = F.array_distinct(F.transform(F.filter(_lines(content), lambda x: F.trim(x) != ""), hashed))
    lines = saved(rows.select("key", "site", F.explode(eligible).alias("line")).withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")), "lines")
    first = rows.groupBy("whole").agg(F.min(F.struct("site", "key")).alias("first")).select("first.key").hint("merge")  # grows with the corpus
    removed = spread_lines(lines.join(first, "key", "left_semi"), min_sites)
    of_doc = lines.join(_salted(removed), ["line", "salt"], "left_semi").groupBy("key").agg(F.collect_set("line").alias("removed"))
    spread = lambda line: F.array_contains("removed", hashed(line))
    found = rows.select("key", "row").join(of_doc, "key", "left")
    found = found.select(
        "row",
        F.when(F.col("removed").isNotNull(), F.array_join(F.filter(_lines(content), lambda x: ~spread(x)), "\n")).otherwise(content).alias("cleaned"),
        F.when(content.isNull(), 0).otherwise(F.size(_lines(content))).cast("long").alias("n_lines"),
        F.when(F.col("removed").isNotNull(), F.size(F.filter(_lines(content), spread))).otherwise(0).cast("long").alias("n_removed"),
    )
    return found.select(*[F.col("cleaned" if c == text else f"row.`{c}`").alias(c) for c in columns], "n_lines", "n_removed")
