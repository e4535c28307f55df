"""P10: next-token alignment of scored sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align_positions(
    df: DataFrame, pad_id: int, ids_col: str = "input_ids", mask_col: str | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per judged position: the distribution at t is judged where ``mask[t+1]``.

    The last position is dropped. ``mask_col`` defaults to ``ids != pad``.
    Output: ``*keep, pos, ctx, next_tok``. Works on ragged ids (no padding).

    The positions come from ``inline(arrays_zip(...))`` over shifted slices,
    so each output row carries only scalars: exploding while keeping the
    array column would copy the whole sequence into every position
    (quadratic in its length).
    """
    ids = F.col(ids_col)
    n = F.size(ids) - 1
    nxt = F.slice(ids, 2, n)
    judged = F.slice(F.col(mask_col), 2, n) if mask_col else F.transform(nxt, lambda x: x != F.lit(pad_id))
    z = F.arrays_zip(
        F.sequence(F.lit(0), n - 1).alias("pos"),
        F.slice(ids, 1, n).alias("ctx"),
        nxt.alias("next_tok"),
        judged.alias("judged"),
    )
    return (
        df.filter(F.size(ids) > 1)
        .select(*keep, F.inline(z))
        .filter(F.col("judged"))
        .select(*keep, F.col("pos").cast("int").alias("pos"), "ctx", "next_tok")
    )
