"""Distilling a table-valued student on Spark.

The student is a table ``W(ctx, tok, logit, m, v)`` (logits of the next
token given the previous one, plus AdamW moments). A training step is:

1. judged positions of the step's batches -> weight per context
   ``w(c) = sum_r n(r, c) / (R * N_r)`` (each rank's batch mean, averaged
   over ranks the way a data-parallel all-reduce does);
2. gradient w.r.t. the logits in closed form, joined on ``(ctx, tok)``;
3. global L2 clip (one scalar aggregate);
4. AdamW as column arithmetic;
5. the new table is written to the shared folder named by
   ``spark.checkpoint.dir`` and read back, so the plan does not grow with
   the step count.

Every per-context window below is partitioned by ``ctx``: one partition is
one model row of V entries, whatever the data size.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ADAM_BETA1, ADAM_BETA2, ADAM_EPS, CLIP_EPS, CLIP_NORM


def init_student(model: DataFrame) -> DataFrame:
    """Parameters from a fitted table model: logits = log-probs, zero moments."""
    return model.select(
        "ctx", "tok", F.col("logp").alias("logit"), F.lit(0.0).alias("m"), F.lit(0.0).alias("v")
    )


def student_log_probs(W: DataFrame) -> DataFrame:
    """``(ctx, tok, ls)``: log-softmax of the logits inside each context."""
    c = Window.partitionBy("ctx")
    mx = F.max("logit").over(c)
    shifted = F.col("logit") - mx
    return W.select("ctx", "tok", shifted.alias("__z")).select(
        "ctx", "tok", (F.col("__z") - F.log(F.sum(F.exp("__z")).over(c))).alias("ls")
    )


def context_weights(positions: DataFrame, world_size: int) -> DataFrame:
    """``(ctx, w)`` with ``w = sum_r n(r, ctx) / (R * N_r)``; at most V rows."""
    per_rank = positions.groupBy("rank").agg(F.count(F.lit(1)).alias("__rank_n"))
    cnt = positions.groupBy("rank", "ctx").agg(F.count(F.lit(1)).alias("__cnt"))
    # per_rank has one row per rank (bounded by the world size).
    j = cnt.join(F.broadcast(per_rank), "rank")
    return j.groupBy("ctx").agg(F.sum(F.col("__cnt") / (F.lit(float(world_size)) * F.col("__rank_n"))).alias("w"))


def gradient(W: DataFrame, teacher: DataFrame, weights: DataFrame, loss: str = "rkl") -> DataFrame:
    """``(ctx, tok, g, loss_term)`` for every parameter (zero where the context is unused).

    ``rkl`` is the reference's default loss, KL(teacher || student): g = w (S - P).
    ``jsd`` is the reference's JSD, 0.5 KL(M||P) + 0.25 KL(M||S):
    g = w S (d - sum S d), d = .25 (m - p + 1) + .125 (m - s + 1) - .25 M / S.
    ``loss_term`` summed over all rows is the step's loss.
    """
    ls = student_log_probs(W)
    t = teacher.select("ctx", "tok", F.col("logp").alias("lp"))
    j = ls.join(t, ["ctx", "tok"]).join(F.broadcast(weights), "ctx", "left").fillna(0.0, ["w"])
    S, P, w = F.exp("ls"), F.exp("lp"), F.col("w")
    if loss == "rkl":
        return j.select("ctx", "tok", (w * (S - P)).alias("g"), (w * P * (F.col("lp") - F.col("ls"))).alias("loss_term"))
    if loss != "jsd":
        raise ValueError(f"unknown loss {loss!r}")
    lm = F.log(F.lit(0.5) * P + F.lit(0.5) * S)
    M = F.exp(lm)
    d = (
        F.lit(0.25) * (lm - F.col("lp") + 1) + F.lit(0.125) * (lm - F.col("ls") + 1) - F.lit(0.25) * M / S
    )
    term = w * (F.lit(0.5) * M * (lm - F.col("lp")) + F.lit(0.25) * M * (lm - F.col("ls")))
    j = j.select("ctx", "tok", "w", "ls", S.alias("__S"), d.alias("__d"), term.alias("loss_term"))
    sd = F.sum(F.col("__S") * F.col("__d")).over(Window.partitionBy("ctx"))
    return j.select("ctx", "tok", (F.col("w") * F.col("__S") * (F.col("__d") - sd)).alias("g"), "loss_term")


def grad_norm(grad: DataFrame) -> float:
    """Global L2 norm: one aggregate, one scalar to the driver."""
    return float(grad.agg(F.sqrt(F.sum(F.col("g") * F.col("g")))).collect()[0][0] or 0.0)


def clip_factor(norm: float | Column, max_norm: float = CLIP_NORM) -> float | Column:
    """``min(1, max_norm / (norm + 1e-6))``, of a number or of a column."""
    if isinstance(norm, Column):
        return F.least(F.lit(1.0), F.lit(max_norm) / (norm + F.lit(CLIP_EPS)))
    return min(1.0, max_norm / (norm + CLIP_EPS))


def lr_at(step: int | Column, base: float, warmup: int = 0, name: str = "constant") -> float | Column:
    """T5: the learning rate used by optimizer step ``step`` (0-based), a number or a column."""
    if isinstance(step, Column):
        if name not in ("constant", "constant_with_warmup"):
            raise ValueError(f"unknown schedule {name!r}")
        warm = F.when(step < warmup, F.lit(base) * step / F.lit(float(max(1, warmup)))) if name != "constant" else F.when(F.lit(False), F.lit(base))
        return warm.otherwise(F.lit(base))
    if name == "constant":
        return base
    if name == "constant_with_warmup":
        return base * (step / max(1, warmup) if step < warmup else 1.0)
    raise ValueError(f"unknown schedule {name!r}")


def adamw(W: DataFrame, grad: DataFrame, lr: float, weight_decay: float, t: int, scale: float = 1.0) -> DataFrame:
    """T4: one AdamW step (decoupled decay, bias-corrected moments) at 1-based step ``t``."""
    g = F.col("g") * F.lit(scale)
    j = W.join(grad.select("ctx", "tok", "g"), ["ctx", "tok"])
    m = F.lit(ADAM_BETA1) * F.col("m") + F.lit(1 - ADAM_BETA1) * g
    v = F.lit(ADAM_BETA2) * F.col("v") + F.lit(1 - ADAM_BETA2) * g * g
    j = j.select("ctx", "tok", (F.col("logit") * F.lit(1 - lr * weight_decay)).alias("logit"), m.alias("m"), v.alias("v"))
    bc1 = 1 - ADAM_BETA1**t
    bc2 = 1 - ADAM_BETA2**t
    denom = F.sqrt("v") / F.lit(math.sqrt(bc2)) + F.lit(ADAM_EPS)
    return j.select("ctx", "tok", (F.col("logit") - F.lit(lr / bc1) * F.col("m") / denom).alias("logit"), "m", "v")


@dataclass
class DistillConfig:
    steps: int
    learning_rate: float
    weight_decay: float = 0.0
    warmup_steps: int = 0
    schedule: str = "constant"
    loss: str = "rkl"
    world_size: int = 2
    skip_batches: int | None = None
    clip_norm: float = CLIP_NORM


def _written(df: DataFrame, path: str) -> DataFrame:
    """Write once to shared storage and read back: one computation, and the lineage is cut."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def distill(
    spark: SparkSession, W0: DataFrame, teacher: DataFrame, positions: DataFrame, cfg: DistillConfig,
    snapshot_root: str | None = None,
    progress: Callable[[int, float, float, float], None] | None = None,
    work_dir: str | None = None,
    log_root: str | None = None,
    run_id: str = "run",
) -> tuple[DataFrame, DataFrame]:
    """The step loop. ``positions`` carries ``step, rank, ctx`` (and ``batch_no`` for skips).

    Returns the final parameters and the loss curve ``(step, loss, grad_norm, lr)``.
    Per step only two scalars (loss, norm) reach the driver. Teacher and
    positions are written once (those of the steps that run, partitioned by step,
    so a step reads only its own files); the gradient and the parameters of every step
    are written to the shared folder and read back, so the plan never grows
    and a lost executor re-reads files instead of replaying earlier steps.
    With ``snapshot_root`` the parameters of each step are kept as S6
    snapshots with a manifest, and those after the last step are committed as ``final``.
    With ``log_root`` each step's loss, gradient norm and rate are logged (S5),
    exactly once per (run, step). Tables that no later step reads are deleted.
    """
    import uuid

    from ..session import shared_path
    from ..sources.publish import delete
    from ..sources.store import commit_snapshot, log_metrics, write_snapshot

    work = work_dir or shared_path(spark, "distill", uuid.uuid4().hex)
    teacher = _written(teacher.select("ctx", "tok", "logp"), f"{work}/teacher")
    keep = ["step", "rank", "ctx"] + (["batch_no"] if cfg.skip_batches else [])
    # A folder for each step that the loop runs, however many steps the positions hold (maybe none of these).
    positions = positions.where(F.col("step").between(0, cfg.steps - 1)).select(*keep)
    positions.write.mode("overwrite").partitionBy("step").parquet(f"{work}/positions")
    positions = spark.read.schema(positions.schema).parquet(f"{work}/positions")
    held = f"{work}/W-0"
    W = _written(W0.select("ctx", "tok", "logit", "m", "v"), held)
    curve = []
    # Skipped batches count as steps but move neither the optimizer's clock nor the schedule's.
    skipped = set()
    if cfg.skip_batches:
        skipped = {r["step"] for r in positions.filter(F.col("batch_no") < cfg.skip_batches).select("step").distinct().collect()}
    updates = 0
    for step in range(cfg.steps):
        if step in skipped:
            continue
        pos = positions.filter(F.col("step") == step)
        # The norm and the loss are observed while the gradient is written:
        # no second pass over it.
        obs = Observation(f"grad-{step}")
        g = gradient(W, teacher, context_weights(pos, cfg.world_size), cfg.loss).observe(
            obs, F.sum(F.col("g") * F.col("g")).alias("ss"), F.sum("loss_term").alias("l")
        )
        grad = _written(g, f"{work}/grad-{step}")
        stats = obs.get
        norm, loss = math.sqrt(float(stats["ss"] or 0.0)), float(stats["l"] or 0.0)
        lr = lr_at(updates, cfg.learning_rate, cfg.warmup_steps, cfg.schedule)
        updates += 1
        new_W = adamw(W, grad, lr, cfg.weight_decay, updates, clip_factor(norm, cfg.clip_norm))
        if snapshot_root:
            W = spark.read.parquet(write_snapshot(new_W, snapshot_root, step + 1))
        else:
            W = _written(new_W, f"{work}/W-{step + 1}")
        delete(spark, f"{work}/grad-{step}")
        if held:
            delete(spark, held)
        held = None if snapshot_root else f"{work}/W-{step + 1}"
        curve.append((step, loss, norm, lr))
        if log_root:
            rows = [(run_id, step, 0, "train", name, value) for name, value in ((cfg.loss, loss), ("grad_norm", norm), ("lr", lr))]
            log_metrics(spark.createDataFrame(rows, "run_id string, step long, rank int, phase string, metric string, value double"), log_root, run_id, step)
        if progress:
            progress(step, loss, norm, lr)
    if snapshot_root:
        commit_snapshot(W, snapshot_root, "final", run_id)
    for name in ("teacher", "positions"):
        delete(spark, f"{work}/{name}")
    schema = "step int, loss double, grad_norm double, lr double"
    return W, spark.createDataFrame(curve, schema)
