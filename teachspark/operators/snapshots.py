"""Snapshot selection over a manifest ``(run_id, step, is_final, path)``.

Nothing is deleted here: retention returns the rows to drop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SNAPSHOTS_KEPT


def latest_snapshot(manifest: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Per run, the final snapshot if there is one, else the largest step."""
    best = F.max(F.struct(F.col("is_final"), F.col("step"), F.col("path"))).alias("b")
    return manifest.groupBy(run_col).agg(best).select(
        run_col, F.col("b.step").alias("step"), F.col("b.is_final").alias("is_final"), F.col("b.path").alias("path")
    )


def expired_snapshots(manifest: DataFrame, keep: int = SNAPSHOTS_KEPT, run_col: str = "run_id") -> DataFrame:
    """Step snapshots beyond the newest ``keep`` of their run; the final one is exempt.

    Two scans: the ``keep``-th largest step of each run, then one join. The
    largest steps are found in hash parts of a run first (a window whose
    ``row_number <= keep`` limits each part before the shuffle), then among
    the parts' winners, so one run holding most of the manifest is never
    sorted in a single task.
    """
    rest = manifest.filter(~F.col("is_final"))
    if keep <= 0:
        return rest
    steps = rest.select(run_col, "step").filter(F.col("step").isNotNull()).distinct()
    part = Window.partitionBy(run_col, F.pmod(F.xxhash64("step"), F.lit(64))).orderBy(F.desc("step"))
    whole = Window.partitionBy(run_col).orderBy(F.desc("step"))
    top = steps.withColumn("__k", F.row_number().over(part)).filter(F.col("__k") <= keep)
    top = top.withColumn("__k", F.row_number().over(whole)).filter(F.col("__k") == keep)
    return rest.join(top.select(run_col, F.col("step").alias("__kth")), run_col).filter(F.col("step") < F.col("__kth")).drop("__kth")


def manifest_from_events(events: DataFrame) -> DataFrame:
    """Stand-in manifest: each event saves a snapshot of run ``user_id`` at step ``event_id div 10``;
    a ``signup`` event saves the run's final snapshot."""
    is_final = F.col("event_type") == "signup"
    step = F.when(is_final, F.lit(None).cast("long")).otherwise((F.col("event_id") / 10).cast("long"))
    m = events.select(F.col("user_id").alias("run_id"), step.alias("step"), is_final.alias("is_final")).distinct()
    name = F.when(F.col("is_final"), F.lit("final")).otherwise(F.col("step").cast("string"))
    return m.withColumn("path", F.concat(F.lit("run-"), F.col("run_id").cast("string"), F.lit("/step-"), name))
