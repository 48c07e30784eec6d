"""Health of contexts, what pruning retains, and corpus reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_WINDOW, financial_figures, health_score, ratio, reduction

# Results must agree with them.
SUSPICIOUS_DUPLICATES, FEWEST_ITEMS, FEWEST_CASES = 0.5, 20, 3


def health(classified: DataFrame, window: int = DEFAULT_WINDOW) -> DataFrame:
    """One row of ratios and a score for each context."""
    tokens, of = F.col("token_count"), lambda *buckets: F.sum(F.when(F.col("relevance").isin(*buckets), F.col("token_count")).otherwise(0))
    sums = classified.groupBy("context_id").agg(
        F.sum(tokens).alias("total_tokens"),
        of("critical", "relevant").alias("useful"),
        of("redundant", "obsolete").alias("wasted"),
        F.sum(F.when((F.col("kind") == "tool_output") & (F.col("relevance") != "critical"), tokens).otherwise(0)).alias("tool"),
    )
    out = sums.select(
        "context_id",
        F.col("total_tokens").cast("long").alias("total_tokens"),
        ratio(F.col("total_tokens"), F.lit(window)).alias("window_usage"),
        ratio(F.col("useful"), F.col("total_tokens")).alias("relevant_ratio"),
        F.lit(1.0).alias("critical_retained"),
        ratio(F.col("wasted"), F.col("total_tokens")).alias("redundancy"),
        ratio(F.col("tool"), F.col("total_tokens")).alias("tool_noise"),
    )
    return out.withColumn("score", health_score(F.col("critical_retained"), F.col("relevant_ratio"), F.col("redundancy"), F.col("tool_noise"), F.col("window_usage")))


def surfacing_trigger(health: DataFrame, usage: float = 0.75, relevant: float = 0.5) -> DataFrame:
    """Whether and why memory should be brought back into a context."""
    reason = F.when(F.col("window_usage") >= usage, "window_usage").when(F.col("relevant_ratio") <= relevant, "relevant_ratio")
    return health.select("context_id", F.coalesce(reason, F.lit("none")).alias("reason"))


def critical_retention(before: DataFrame, after: DataFrame) -> DataFrame:
    """The share of each context's critical items that are still there; 1 where there were none."""
    critical = before.where("relevance = 'critical'").select("context_id", "pos")
    kept = after.select("context_id", "pos", F.lit(1).alias("_kept"))
    share = critical.join(kept, ["context_id", "pos"], "left").groupBy("context_id").agg((F.count("_kept") / F.count("*")).alias("share"))
    return before.select("context_id").distinct().join(share, "context_id", "left").select("context_id", F.coalesce("share", F.lit(1.0)).alias("critical_retention"))


def digit_retention(before: DataFrame, after: DataFrame) -> DataFrame:
    """The share of each context's distinct figures that are still there; 1 where there were none."""
    figures = lambda df: df.select("context_id", F.explode(financial_figures(F.col("content"))).alias("figure")).distinct()
    share = figures(before).join(figures(after).withColumn("_kept", F.lit(1)), ["context_id", "figure"], "left").groupBy("context_id").agg((F.count("_kept") / F.count("*")).alias("share"))
    return before.select("context_id").distinct().join(share, "context_id", "left").select("context_id", F.coalesce("share", F.lit(1.0)).alias("digit_retention"))


def duplicate_share(classified: DataFrame) -> DataFrame:
    return classified.groupBy("context_id").agg(
        ratio(F.sum(F.when(F.col("relevance") == "redundant", F.col("token_count")).otherwise(0)), F.sum("token_count")).alias("duplicate_share"), F.count("*").alias("items")
    )


def corpus_report(cases: DataFrame) -> DataFrame:
    """Cases ``(context_id, tokens_before, tokens_after, items, duplicate_share)`` rolled up, weighted by tokens."""
    warned = (F.col("duplicate_share") > SUSPICIOUS_DUPLICATES) | (F.col("items") < FEWEST_ITEMS)
    return cases.agg(
        F.count("*").alias("cases"),
        F.sum("tokens_before").cast("long").alias("tokens_before"),
        F.sum("tokens_after").cast("long").alias("tokens_after"),
        reduction(F.sum("tokens_before"), F.sum("tokens_after")).alias("reduction_ratio"),
        F.sum(warned.cast("long")).alias("warned_cases"),
        ((F.count("*") >= FEWEST_CASES) & (F.sum(warned.cast("long")) == 0)).alias("publishable"),
    )


def case_warnings(cases: DataFrame) -> DataFrame:
    """``cases`` (with ``items, duplicate_share, critical_retention, digit_retention``) and the reasons not to publish each."""
    reasons = F.array(
        F.when(F.col("duplicate_share") > SUSPICIOUS_DUPLICATES, "duplicates"),
        F.when(F.col("items") < FEWEST_ITEMS, "few_items"),
        F.when(F.col("critical_retention") < 1, "critical_lost"),
        F.when(F.col("digit_retention") < 1, "figures_lost"),
    )
    return cases.withColumn("warnings", F.array_compact(reasons))


def report_rows(cases: DataFrame) -> DataFrame:
    """A JSON object for each case, so that the warnings travel with the figures."""
    return cases.select("context_id", F.to_json(F.struct(*[c for c in cases.columns])).alias("report"))
