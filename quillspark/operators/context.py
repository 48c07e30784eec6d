"""The context pipeline: measure, dedup, classify, rank, filter, compress, budget and place, with a ledger.

Items are rows ``(context_id, pos, kind, content)``; ``pos`` is their order and unique in a context. All windows are
partitioned by the context, so one exchange serves classification, budget and placement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CRITICAL_MARKERS, OBSOLETE_MARKERS, TOKEN_METHOD, estimate_tokens, has_financial_figure, is_noise, marker_in, normalised, tokens_of
from ..storage import saved

# Results must agree with them.
LONGEST_OUTPUT, HEAD_CHARS, TAIL_CHARS = 2000, 1200, 600
DROP_ORDER = ("irrelevant", "obsolete", "redundant", "relevant")
BUCKETS = ("critical", "relevant", "redundant", "obsolete", "irrelevant")


def measure(items: DataFrame) -> DataFrame:
    """Adds token_count, token_method, original_index and content_hash."""
    return (
        items.withColumn("_plain", normalised(F.col("content")))
        .withColumn("token_count", tokens_of(F.length("_plain")))
        .withColumn("token_method", F.lit(TOKEN_METHOD))
        .withColumn("original_index", F.col("pos"))
        .withColumn("content_hash", F.substring(F.sha2("_plain", 256), 1, 16))
        .drop("_plain")
    )


def dedup(measured: DataFrame) -> DataFrame:
    """The first item of each content hash in a context."""
    first = F.row_number().over(Window.partitionBy("context_id", "content_hash").orderBy("pos"))
    return measured.withColumn("_n", first).where("_n = 1").drop("_n")


def classify(items: DataFrame, pins: tuple[str, ...] = (), retired: tuple[str, ...] = (), few: bool = False) -> DataFrame:
    """Adds relevance and relevance_reason by a cascade of rules; the first that holds decides.

    ``pins`` and ``retired`` are further markers, tried before the built-in ones. Recency compares the index before
    deduplication with the number of items here, and applies to contexts of more than ten items. With ``few`` large contexts, only
    their sizes are gathered by context, and the items, which should be written, stay spread.
    """
    text = F.col("content")
    critical, obsolete = marker_in(F.col("_low"), pins + CRITICAL_MARKERS), marker_in(F.col("_low"), retired + OBSOLETE_MARKERS)
    first = F.min("pos").over(Window.partitionBy("context_id", "content_hash"))
    total = F.count("*").over(Window.partitionBy("context_id"))
    recent = (F.col("_total") > 10) & (F.col("original_index") >= F.col("_total") - F.greatest(F.lit(3), F.floor(F.col("_total") / 10)))
    rule = lambda relevance, reason: F.struct(F.lit(relevance).alias("relevance"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    decided = (
        F.when(critical.isNotNull(), rule("critical", F.concat(F.lit("explicit marker "), critical)))
        .when(has_financial_figure(text), rule("critical", "financial figure"))
        .when(F.col("kind") == "memory", rule("critical", "persisted memory record"))
        .when(F.col("kind") == "system", rule("critical", "system prompt"))
        .when(obsolete.isNotNull(), rule("obsolete", F.concat(F.lit("obsolescence marker "), obsolete)))
        .when(F.col("pos") > F.col("_first"), rule("redundant", F.concat(F.lit("exact duplicate of item #"), F.col("_first").cast("string"))))
        .when((F.col("kind") == "tool_output") & is_noise(text), rule("irrelevant", "tool output without information"))
        .when(recent, rule("critical", "most recent exchange"))
        .otherwise(rule("relevant", "no demotion rule matched"))
    )
    if few:
        sizes = saved(items.groupBy(F.col("context_id").alias("_c")).agg(F.count("*").alias("_total")), "sizes")
        counted = items.join(sizes, F.col("context_id").eqNullSafe(F.col("_c"))).drop("_c")
    else:
        counted = items.withColumn("_total", total)
    out = counted.withColumn("_first", first).withColumn("_low", F.lower(text)).withColumn("_rule", decided)
    return out.withColumn("relevance", F.col("_rule.relevance")).withColumn("relevance_reason", F.col("_rule.reason")).drop("_first", "_total", "_low", "_rule")


def annotate_rank(items: DataFrame, scores: DataFrame) -> DataFrame:
    """``rank_score`` of each item from ``(context_id, pos, score)``, 0 where it has none; nothing is reordered."""
    return items.join(scores.select("context_id", "pos", F.col("score").alias("rank_score")), ["context_id", "pos"], "left").withColumn("rank_score", F.coalesce("rank_score", F.lit(0.0)))


def keeps_information() -> Column:
    """False for tool output that was found irrelevant."""
    return ~((F.col("kind") == "tool_output") & (F.col("relevance") == "irrelevant"))


def is_cut() -> Column:
    return (F.col("kind") == "tool_output") & (F.col("relevance") != "critical") & (F.length("content") > LONGEST_OUTPUT)


def compressed(label: str = "quillspark") -> Column:
    """Long tool output that isn't critical, cut to its head and tail around a note of what was left out."""
    text = F.col("content")
    left_out = F.format_number(F.length(text) - HEAD_CHARS - TAIL_CHARS, 0)
    note = F.concat(F.lit("\n\n[... "), left_out, F.lit(f" characters elided by {label} ...]\n\n"))
    return F.when(is_cut(), F.concat(F.substring(text, 1, HEAD_CHARS), note, F.substring(text, -TAIL_CHARS, TAIL_CHARS))).otherwise(text)


def compress(items: DataFrame) -> DataFrame:
    """Items with long output cut; only what was cut is counted again."""
    return items.withColumn("token_count", tokens_after()).withColumn("content", compressed())


def tokens_after() -> Column:
    short = compressed()
    return F.when(is_cut(), estimate_tokens(short)).otherwise(F.col("token_count"))


def over_budget(budget: int, tokens: str = "token_count") -> Column:
    """Which items must go: the least relevant first, and in a bucket the lowest rank and then the newest first.

    Critical items never go. An item goes while the items before it leave the context over its budget.
    """
    bucket = F.coalesce(*[F.when(F.col("relevance") == b, F.lit(i)) for i, b in enumerate(DROP_ORDER)], F.lit(len(DROP_ORDER)))
    order = Window.partitionBy("context_id").orderBy(bucket, F.col("rank_score"), F.col("original_index").desc(), F.col("pos").desc())
    gone = F.coalesce(F.sum(tokens).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (F.col("relevance") != "critical") & (F.sum(tokens).over(Window.partitionBy("context_id")) - gone > budget)


def enforce_budget(items: DataFrame, budget: int) -> DataFrame:
    return items.withColumn("_drop", over_budget(budget)).where(~F.col("_drop")).drop("_drop")


def place(items: DataFrame) -> DataFrame:
    """Adds ``placed``: the first half of the critical items, then the others, then the other half."""
    critical = (F.col("relevance") == "critical").cast("int")
    running = F.sum(critical).over(Window.partitionBy("context_id").orderBy("pos"))
    total = F.sum(critical).over(Window.partitionBy("context_id"))
    zone = F.when(critical == 0, 1).when(running <= F.floor((total + 1) / 2), 0).otherwise(2)
    order = F.row_number().over(Window.partitionBy("context_id").orderBy("_zone", "pos")) - 1
    return items.withColumn("_zone", zone).withColumn("placed", order.cast("long")).drop("_zone")


def run(items: DataFrame, scores: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """The items that the pipeline keeps, with all it found and their place."""
    out = classify(dedup(measure(items)))
    out = annotate_rank(out, scores) if scores is not None else out.withColumn("rank_score", F.lit(0.0))
    out = compress(out.where(keeps_information()))
    return place(enforce_budget(out, budget) if budget is not None else out)


def ledger(items: DataFrame, scores: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """Items and tokens before and after each stage of each context, from one pass over one wide table."""
    whole = Window.partitionBy("context_id")
    raw = measure(items).withColumn("i0", F.count("*").over(whole)).withColumn("t0", F.sum("token_count").over(whole))
    out = classify(dedup(raw))
    out = annotate_rank(out, scores) if scores is not None else out.withColumn("rank_score", F.lit(0.0))
    # the budget sees informative items only: others have no tokens there
    out = out.withColumn("informative", keeps_information()).withColumn("after", F.when(F.col("informative"), tokens_after()))
    kept = out.withColumn("dropped", F.when(F.col("informative"), over_budget(budget, "after") if budget is not None else F.lit(False)).otherwise(True))
    if_ = lambda condition, value: F.coalesce(F.sum(F.when(condition, value)), F.lit(0))
    informative, alive = F.col("informative"), F.col("informative") & ~F.col("dropped")
    sums = kept.groupBy("context_id").agg(
        F.max("i0").alias("i0"), F.max("t0").alias("t0"), F.count("*").alias("i1"), F.sum("token_count").alias("t1"),
        if_(informative, F.lit(1)).alias("i2"), if_(informative, F.col("token_count")).alias("t2"),
        if_(informative, F.col("after")).alias("t3"),
        if_(alive, F.lit(1)).alias("i4"), if_(alive, F.col("after")).alias("t4"),
    )
    stages = [("dedup", "i0", "t0", "i1", "t1"), ("classify", "i1", "t1", "i1", "t1")]
    if scores is not None:
        stages.append(("rank", "i1", "t1", "i1", "t1"))
    stages += [("filter_tool_output", "i1", "t1", "i2", "t2"), ("compress", "i2", "t2", "i2", "t3")]
    if budget is not None:
        stages.append(("budget", "i2", "t3", "i4", "t4"))
    stages.append(("place", "i4", "t4", "i4", "t4"))
    rows = [
        F.struct(F.lit(n).alias("stage_no"), F.lit(name).alias("stage"), *(F.col(c).cast("long").alias(a) for c, a in zip((ib, ia, tb, ta), ("items_before", "items_after", "tokens_before", "tokens_after"))))
        for n, (name, ib, tb, ia, ta) in enumerate(stages)
    ]
    return sums.select("context_id", F.explode(F.array(*rows)).alias("r")).select("context_id", "r.*")


def breakdown(classified: DataFrame) -> DataFrame:
    """Tokens of each bucket in each context; all five are there."""
    return classified.groupBy("context_id").pivot("relevance", list(BUCKETS)).agg(F.sum("token_count")).na.fill(0, list(BUCKETS))


def tail_truncate(measured: DataFrame, budget: int) -> DataFrame:
    """The newest items that fit together; the newest one stays even if it doesn't fit."""
    newest = Window.partitionBy("context_id").orderBy(F.col("pos").desc())
    out = measured.withColumn("_used", F.sum("token_count").over(newest)).withColumn("_n", F.row_number().over(newest))
    return out.where((F.col("_used") <= budget) | (F.col("_n") == 1)).drop("_used", "_n")


def write_pruned(items: DataFrame, path: str) -> None:
    """Writes contexts as they are to be read next, a JSON line for each item, sorted by context and place within each file."""
    items.repartition("context_id").sortWithinPartitions("context_id", "pos").write.mode("overwrite").json(path)
