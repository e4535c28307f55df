"""Batch divergences and evaluation roll-ups.

Two physical forms of the same numbers:

* dense: a per-position divergence column (from array logits or a scorer)
  summed per batch -- partial + final hash aggregate;
* pre-aggregated, for table models: the divergence of a position depends
  only on its context token, so count judged positions per (batch, ctx)
  first, then join the V-row per-context divergence table and weight.
  Work drops from positions x V to V^2 + positions, and a hot context is one
  counted row instead of many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIVERGENCES = ("kl_ts", "kl_st", "jsd_ref")
# The reference logs these three under its own names.
REFERENCE_NAMES = {"kl_ts": "reverse_kl", "kl_st": "forward_kl", "jsd_ref": "jsd_p_q"}


def context_divergence(teacher: DataFrame, student: DataFrame, beta: float = 0.5) -> DataFrame:
    """Per-context divergences between two table models ``(ctx, tok, logp)``.

    Returns ``(ctx, kl_ts, kl_st, jsd_ref, jsd_beta)``: KL(P||S), KL(S||P), the
    reference's JSD and JSD(beta). One row per context (V rows).
    """
    t = teacher.select("ctx", "tok", F.col("logp").alias("lp"))
    s = student.select("ctx", "tok", F.col("logp").alias("lq"))
    j = t.join(s, ["ctx", "tok"])
    P, S = F.exp("lp"), F.exp("lq")
    lm = F.log(F.lit(0.5) * P + F.lit(0.5) * S)
    lmb = F.log(F.lit(beta) * P + F.lit(1 - beta) * S)
    return j.groupBy("ctx").agg(
        F.sum(P * (F.col("lp") - F.col("lq"))).alias("kl_ts"),
        F.sum(S * (F.col("lq") - F.col("lp"))).alias("kl_st"),
        (F.lit(0.5) * F.sum(F.exp(lm) * (lm - F.col("lp"))) + F.lit(0.25) * F.sum(F.exp(lm) * (lm - F.col("lq")))).alias(
            "jsd_ref"
        ),
        (F.lit(beta) * F.sum(P * (F.col("lp") - lmb)) + F.lit(1 - beta) * F.sum(S * (F.col("lq") - lmb))).alias(
            "jsd_beta"
        ),
    )


def batch_divergence(positions: DataFrame, by: list[str], cols: tuple[str, ...] = DIVERGENCES) -> DataFrame:
    """A6 ("batchmean"): per batch, sum of per-position divergence / judged positions."""
    n = F.count(F.lit(1))
    return positions.groupBy(*by).agg(
        n.cast("long").alias("n_positions"), *[(F.sum(c) / n).alias(c) for c in cols]
    )


def batch_divergence_by_context(
    positions: DataFrame, ctx_div: DataFrame, by: list[str], cols: tuple[str, ...] = DIVERGENCES
) -> DataFrame:
    """A6 pre-aggregated for table models (see module docstring)."""
    counts = positions.groupBy(*by, "ctx").agg(F.count(F.lit(1)).alias("__n"))
    # ctx_div has one row per context token: bounded by the model vocabulary.
    j = counts.join(F.broadcast(ctx_div.select("ctx", *cols)), "ctx")
    return j.groupBy(*by).agg(
        F.sum("__n").cast("long").alias("n_positions"),
        *[(F.sum(F.col("__n") * F.col(c)) / F.sum("__n")).alias(c) for c in cols],
    )


def evaluate(batches: DataFrame, by: list[str] = (), cols: tuple[str, ...] = DIVERGENCES, weighted: bool = False) -> DataFrame:
    """One row per (by..., metric).

    Default is the reference's unweighted mean of batch means; ``weighted``
    gives the position-weighted mean, its metrics named ``weighted_...``.
    """
    by = list(by)
    stack = F.explode(
        F.array(*[F.struct(F.lit(REFERENCE_NAMES.get(c, c)).alias("metric"), F.col(c).alias("v")) for c in cols])
    ).alias("m")
    long = batches.select(*by, "n_positions", stack).select(*by, "n_positions", "m.metric", "m.v")
    if weighted:
        agg = (F.sum(F.col("v") * F.col("n_positions")) / F.sum("n_positions")).alias("value")
        long = long.withColumn("metric", F.concat(F.lit("weighted_"), F.col("metric")))
    else:
        agg = F.avg("v").alias("value")
    return long.groupBy(*by, "metric").agg(agg, F.count(F.lit(1)).cast("long").alias("n_batches"))
