"""Metric roll-ups and generation statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_mean(metrics: DataFrame, keys: tuple[str, ...] = ("step", "metric"), rank_col: str = "rank",
              value_col: str = "value") -> DataFrame:
    """Mean over ranks of each rank's value at a step (an all-reduce average).

    A rank that logged several values at one step contributes their mean.
    Both levels are partial + final hash aggregates.
    """
    per_rank = metrics.groupBy(*keys, rank_col).agg(F.avg(value_col).alias("__v"))
    return per_rank.groupBy(*keys).agg(
        F.avg("__v").alias(value_col), F.count(F.lit(1)).cast("long").alias("n_ranks")
    )


def prefix_metric(phase: str, metric: Column | str) -> Column:
    """``phase/metric`` names (the reference uses ``train``, ``val``, ``final``)."""
    m = F.col(metric) if isinstance(metric, str) else metric
    return F.concat_ws("/", F.lit(phase), m)


def generation_stats(sampled: DataFrame, by: tuple[str, ...] = ("rank", "batch_no")) -> DataFrame:
    """A10: rows, new tokens and completed share per batch (wall time is kept out)."""
    g = sampled.groupBy(*by).agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.sum("n_new").cast("long").alias("new_tokens"),
        F.sum(F.col("finished").cast("int")).cast("long").alias("n_finished"),
    )
    return g.withColumn("completed_share", F.col("n_finished") / F.col("n_rows"))


def metrics_from_events(events: DataFrame) -> DataFrame:
    """Stand-in metric log from ``events``: step = event_id div 10, rank = user_id mod 2."""
    return events.select(
        (F.col("event_id") / 10).cast("long").alias("step"),
        (F.col("user_id") % 2).cast("int").alias("rank"),
        F.col("event_type").alias("metric"),
        F.col("value").cast("double").alias("value"),
    )
