"""Variance of repeated measurements and comparison with their noise floor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_variance(repeats: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of each metric: n, mean, sample standard deviation (0 for one value), min and max, over the repeats that report it."""
    values = repeats.select(*by, F.explode("metrics").alias("metric", "value")).where("value IS NOT NULL")
    return values.groupBy(*by, "metric").agg(
        F.count("*").alias("n"),
        F.round(F.avg("value"), 4).alias("mean"),
        F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 4).alias("stdev"),
        F.round(F.min("value"), 4).alias("min"),
        F.round(F.max("value"), 4).alias("max"),
    )


def against_noise_floor(within: DataFrame, between: DataFrame) -> DataFrame:
    """A verdict for each metric: is the mean of ``between`` outside the range of ``within``?"""
    floor = metric_variance(within).select("metric", F.col("n").alias("n_within"), F.col("min").alias("floor_min"), F.col("max").alias("floor_max"))
    other = metric_variance(between).select("metric", F.col("n").alias("n_between"), F.col("mean").alias("between_mean"))
    outside = (F.col("between_mean") < F.col("floor_min")) | (F.col("between_mean") > F.col("floor_max"))
    few = (F.coalesce("n_within", F.lit(0)) < 2) | F.col("n_between").isNull()
    verdict = F.when(few, "insufficient_data").when(outside, "likely_real_difference").otherwise("indistinguishable_from_noise")
    return floor.join(other, "metric", "full_outer").withColumn("verdict", verdict)
