"""Append-only logs of typed records, snapshots, handoffs and first-fit selection."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HANDOFF_CUTS = ("discovery", "rationale", "failure", "constraint", "decision")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines; lines that don't parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def set_task(task: DataFrame, path: str) -> None:
    """The one object that is overwritten."""
    task.write.mode("overwrite").json(path)


def task(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The task that is set, or no row where there is none or it doesn't parse."""
    try:
        return read_log(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def supersede(old: int, replacement: DataFrame, path: str) -> None:
    """Append a record that points at the one it replaces; the old record isn't touched."""
    append(replacement.withColumn("supersedes", F.lit(old).cast("long")), path)


def active(log: DataFrame) -> DataFrame:
    return log.where("status = 'active'")


def typed(log: DataFrame, record_type: str, everything: bool = False) -> DataFrame:
    """The records of a type: active decisions, unresolved failures, all others; ``everything`` includes the rest."""
    found = log.where(F.col("record_type") == record_type)
    if everything or record_type not in ("decision", "failure"):
        return found
    return active(found) if record_type == "decision" else found.where("NOT (status <=> 'resolved')")


def effective_status(log: DataFrame) -> DataFrame:
    """``id, status, effective_status``: a record that a later one replaces is superseded, whatever its own status."""
    replaced = log.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("id"), F.lit(True).alias("_replaced")).distinct()
    status = F.when(F.col("_replaced"), "superseded").otherwise(F.col("status"))
    return log.join(replaced, "id", "left").select("id", "status", status.alias("effective_status"))


def summary(log: DataFrame) -> DataFrame:
    return log.groupBy("record_type").agg(F.count("*").alias("total"), F.sum((F.col("status") == "active").cast("long")).alias("active"))


def snapshot(log: DataFrame, number: int) -> DataFrame:
    """Active decisions and all other records but surfacings, as numbered rows."""
    return log.where("record_type <> 'surfacing' AND (record_type <> 'decision' OR status = 'active')").withColumn("snapshot", F.lit(number))


def write_snapshot(log: DataFrame, root: str, schema: str, label: str = "") -> int:
    """Write the log's state under the next number, which is returned."""
    number = next_number(snapshots(log.sparkSession, root, schema))
    snapshot(log, number).withColumn("label", F.lit(label)).write.mode("append").partitionBy("snapshot").json(root)
    return number


def snapshots(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All snapshots' records with ``label`` and ``snapshot``; lines that don't parse are left out."""
    return task(spark, root, f"{schema}, label string, snapshot int")


def next_number(taken: DataFrame) -> int:
    """One past the highest number there is; 1 without any."""
    return taken.agg(F.coalesce(F.max("snapshot"), F.lit(0)) + 1).first()[0]


def restore(log: DataFrame, taken: DataFrame) -> DataFrame:
    """The snapshot's records whose id the log no longer has: what a restore appends."""
    return taken.join(log.select("id").distinct(), "id", "left_anti")


def handoff_level(records: DataFrame, budget: int, types: tuple[str, ...] = HANDOFF_CUTS, task_tokens: int = 0) -> DataFrame:
    """How many kinds of records a handoff of each store must leave out, in the order of ``types``, to fit the budget.

    ``records`` has ``store_id, record_type, tokens``. If nothing fits, all are left out.
    """
    cut = F.coalesce(*[F.when(F.col("record_type") == t, F.lit(i)) for i, t in enumerate(types)])
    sums = records.withColumn("cut", cut).groupBy("store_id").pivot("cut", list(range(len(types)))).agg(F.sum("tokens")).na.fill(0)
    levels = []
    for level in range(len(types) + 1):
        total = sum((F.col(str(i)) for i in range(level, len(types))), F.lit(task_tokens))
        levels.append(F.struct(F.lit(level).alias("level"), total.cast("long").alias("tokens")))
    fits = F.filter(F.array(*levels), lambda x: x["tokens"] <= budget)
    chosen = F.when(F.size(fits) > 0, F.get(fits, F.lit(0))).otherwise(levels[-1])
    return sums.select("store_id", chosen.alias("c")).select("store_id", F.col("c.level").alias("cut_level"), F.col("c.tokens").alias("tokens"))


def first_fit(candidates: DataFrame, budget: int) -> DataFrame:
    """The candidates ``(store_id, rank, id, tokens)`` that are taken in rank order, skipping those that don't fit.

    Tokens are 0 or more. Once a size doesn't fit, no later candidate of it does: of each size only as many as the budget
    holds are folded, so the budget bounds a store's array. Candidates without tokens are taken beside the fold.
    """
    nth = F.row_number().over(Window.partitionBy("store_id", "tokens").orderBy("rank", "id"))
    # the first bound on _n follows from the second; as it is a literal, Spark applies it before the shuffle too
    first = candidates.where(F.col("tokens").between(1, budget)).withColumn("_n", nth).where((F.col("_n") <= budget) & (F.col("_n") * F.col("tokens") <= budget))
    ordered = first.groupBy("store_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "tokens"))).alias("c"))

    def take(state: Column, x: Column) -> Column:
        fits = state["used"] + x["tokens"] <= budget
        return F.struct(
            F.when(fits, state["used"] + x["tokens"]).otherwise(state["used"]).alias("used"),
            F.when(fits, F.concat(state["ids"], F.array(x["id"]))).otherwise(state["ids"]).alias("ids"),
        )

    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))
    folded = ordered.select("store_id", F.aggregate("c", zero, take).alias("s"))
    free = candidates.where((F.col("tokens") == 0) & F.lit(budget >= 0)).select("store_id", F.col("id").cast("long").alias("id"))
    return folded.select("store_id", F.explode("s.ids").alias("id")).unionByName(free)


def latest(log: DataFrame, key: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The last row of each key: what an upsert leaves."""
    last = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order]))
    return log.withColumn("_n", last).where("_n = 1").drop("_n")


#: What a snapshot knows besides records: a row for each number.
SNAPSHOT_META = "label string, task string, commit string, taken_at timestamp, snapshot int"


def take_snapshot(log: DataFrame, root: str, schema: str, label: str = "", task_: DataFrame | None = None, commit: str | None = None) -> int:
    """Writes the log's state, the task as JSON and the commit id of the code under the next number, which is returned.

    Records are written first and the snapshot's own row last: a snapshot without that row was cut off, and is not listed.
    """
    spark = log.sparkSession
    number = next_number(task(spark, f"{root}/meta", SNAPSHOT_META))
    snapshot(log, number).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot").json(f"{root}/records")
    one = spark.range(1).select(F.lit(label).alias("label"), F.lit(commit).cast("string").alias("commit"), F.current_timestamp().alias("taken_at"), F.lit(number).alias("snapshot"))
    told = F.lit(None).cast("string").alias("task")
    meta = one.select("*", told) if task_ is None else one.join(task_.limit(1).select(F.to_json(F.struct("*")).alias("task")), how="left")
    meta.write.mode("append").partitionBy("snapshot").json(f"{root}/meta")
    return number


def taken_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """``label, task, commit, taken_at, snapshot`` of all snapshots, the oldest first."""
    return task(spark, f"{root}/meta", SNAPSHOT_META).orderBy("snapshot")


def restore_snapshot(number: int, root: str, schema: str, log_path: str, task_path: str) -> bool:
    """Appends the snapshot's records whose ids the log lacks, and sets its task if it has one. Again it appends nothing.

    Whether there is such a snapshot.
    """
    spark = SparkSession.getActiveSession()
    meta = taken_snapshots(spark, root).where(F.col("snapshot") == number).collect()  # one row at most
    if not meta:
        return False
    records = task(spark, f"{root}/records", f"{schema}, snapshot int").where(F.col("snapshot") == number).drop("snapshot")
    append(restore(task(spark, log_path, schema), records), log_path)
    if meta[0].task is not None:
        spark.createDataFrame([(meta[0].task,)], "value string").write.mode("overwrite").text(task_path)  # it is JSON already
    return True
