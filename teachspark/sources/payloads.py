"""Score payloads (logits computed elsewhere) as a model's output: aligned, checked and judged.

A payload is a table ``(id, pos, logits array)``. Two of them are bucketed and sorted alike by
``(id, pos)`` when they are stored, so they join bucket by bucket, without a shuffle and without
a sort. Rows that can't be judged are counted by reason, never lost in the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import divergence as DV

KEYS = ["id", "pos"]
#: Reasons for which a position isn't judged.
REASONS = ("no_student", "no_teacher", "repeated", "length", "logits")


def store_payload(scores: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """Write a payload as table ``name`` at ``path``, in ``buckets`` buckets; rows of a null id or position go to one bucket like any other."""
    rows = scores.select(F.col("id").cast("long").alias("id"), F.col("pos").cast("int").alias("pos"), F.col("logits").cast("array<double>").alias("logits"))
    # One file a bucket: the writer gets its rows by the bucket's own hash.
    rows.repartition(buckets, *KEYS).write.mode("overwrite").option("path", path).bucketBy(buckets, *KEYS).sortBy(*KEYS).saveAsTable(name)
    return scores.sparkSession.table(name)


def open_payload(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).select(*KEYS, "logits")


def paired(teacher: DataFrame, student: DataFrame) -> DataFrame:
    """``id, pos, lt, ls, reason``: every key of either payload once; ``reason`` is null where both sides can be judged."""
    side = lambda df, x: df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias(f"n{x}"), F.first("logits").alias(f"l{x}"))
    t, s = side(teacher, "t"), side(student, "s")
    both = t.withColumnsRenamed({k: f"t_{k}" for k in KEYS}).join(s, F.expr(" and ".join(f"t_{k} = {k}" for k in KEYS)), "full")
    bad = lambda c: F.col(c).isNull() | (F.size(c) == 0) | F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    reason = (
        F.when(F.col("nt").isNull(), "no_teacher")
        .when(F.col("ns").isNull(), "no_student")
        .when((F.col("nt") > 1) | (F.col("ns") > 1), "repeated")
        .when(F.size("lt") != F.size("ls"), "length")
        .when(bad("lt") | bad("ls"), "logits")
    )
    return both.select(*[F.coalesce(f"t_{k}", k).alias(k) for k in KEYS], "lt", "ls", reason.alias("reason"))


def rejects(pairs: DataFrame) -> DataFrame:
    """``reason, n_positions`` for each reason that occurs."""
    return pairs.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n_positions"))


def judged(pairs: DataFrame, keep: tuple[str, ...] = ("id", "pos")) -> DataFrame:
    """A1-A4 of the positions without a reason: ``*keep, kl_ts, kl_st, jsd_ref``."""
    rows = pairs.where("reason is null").select(*keep, DV.log_softmax("lt").alias("lp"), DV.log_softmax("ls").alias("lq"))
    return rows.select(*keep, DV.kl_teacher_student("lp", "lq").alias("kl_ts"), DV.kl_student_teacher("lp", "lq").alias("kl_st"), DV.jsd_reference("lp", "lq").alias("jsd_ref"))
