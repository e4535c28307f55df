"""Table language models fitted from counts (stand-ins for pretrained checkpoints).

P(v | c) = (n(c, v) + a * u(v)) / (n(c) + a),  u(v) = (n(v) + k) / (N + k V)

with c the previous token, n(v) the successor count and V the model
vocabulary (ids 1..V). The model is a dense table ``(ctx, tok, logp)`` of V^2
rows: its size is fixed by the vocabulary, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import BOS_ID, EOS_ID

# Largest model (rows) that joins may broadcast; above it they shuffle on ctx.
BROADCAST_MODEL_ROWS = 4_000_000


def bigram_counts(seqs: DataFrame, ids_col: str = "input_ids", wrap: bool = True) -> DataFrame:
    """``(ctx, tok, n)`` over every adjacent pair of every whole sequence.

    Pairs come from ``inline(arrays_zip(s[:-1], s[1:]))``: built-in, code-
    generated expressions, linear in the sequence (no lambda, and no copy of
    the whole array into every exploded row). The count is a partial + final
    aggregate, so a hot pair collapses to one row per map task before the
    shuffle.
    """
    seq = F.concat(F.array(F.lit(BOS_ID)), F.col(ids_col), F.array(F.lit(EOS_ID))) if wrap else F.col(ids_col)
    n = F.size("s") - 1
    pairs = F.arrays_zip(F.slice("s", 1, n).alias("ctx"), F.slice("s", 2, n).alias("tok"))
    return (
        seqs.select(seq.alias("s"))
        .filter(F.size("s") > 1)
        .select(F.inline(pairs))
        .groupBy("ctx", "tok")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fit_table_lm(
    spark: SparkSession, counts: DataFrame, vocab_size: int, alpha: float, k: float = 1.0
) -> DataFrame:
    """Dense ``(ctx, tok, logp)`` for ctx, tok in 1..V from bigram counts, which are read three times (pass a written table)."""
    V = vocab_size
    counts = counts.filter(F.col("ctx").between(1, V) & F.col("tok").between(1, V))
    grid = spark.range(V * V).select(
        ((F.col("id") / V).cast("int") + 1).alias("ctx"), ((F.col("id") % V).cast("int") + 1).alias("tok")
    )
    n_ctx = counts.groupBy("ctx").agg(F.sum("n").alias("n_ctx"))
    # V rows: the total over them is a bounded single-partition step.
    uni = (
        spark.range(1, V + 1).select(F.col("id").cast("int").alias("tok"))
        .join(counts.groupBy("tok").agg(F.sum("n").alias("n_tok")), "tok", "left")
        .select("tok", F.coalesce("n_tok", F.lit(0)).alias("n_tok"))
        .withColumn("N", F.sum("n_tok").over(Window.partitionBy(F.lit(1))))
        .select("tok", ((F.col("n_tok") + k) / (F.col("N") + k * V)).alias("u"))
    )
    p = (
        F.coalesce(F.col("n"), F.lit(0)) + F.lit(alpha) * F.col("u")
    ) / (F.coalesce(F.col("n_ctx"), F.lit(0)) + F.lit(alpha))
    return (
        grid.join(counts, ["ctx", "tok"], "left")
        .join(F.broadcast(n_ctx), "ctx", "left")
        .join(F.broadcast(uni), "tok", "left")
        .select("ctx", "tok", F.log(p).alias("logp"))
    )


def join_model(df: DataFrame, model: DataFrame, on: list[str], model_rows: int, how: str = "inner") -> DataFrame:
    """Join data to a model table: broadcast when its row count is under the bound, else shuffle."""
    m = F.broadcast(model) if model_rows <= BROADCAST_MODEL_ROWS else model
    return df.join(m, on, how)
