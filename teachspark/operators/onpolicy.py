"""M3-M7: on-policy sampling from the student, then scoring by the teacher.

Sampling is sequential inside a row and independent across rows, so it is a
single ``mapInPandas`` with no shuffle. The draws are keyed uniforms
``md5(seed:id:step)`` computed JVM-side and handed to the map, so a retried
or re-partitioned task produces the same text. Each step is an inverse-CDF
lookup in token-id order, vectorised over all live rows of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EOS_ID
from ..functions.hashing import keyed_uniform


def student_cdf(model: DataFrame, vocab_size: int, digits: int = 12) -> DataFrame:
    """``(ctx, tok, hi)``: cumulative probability in token-id order, rounded; last entry forced to 1.

    The window is partitioned by context, so each partition is one model row
    (V entries) whatever the data size.
    """
    w = Window.partitionBy("ctx").orderBy("tok").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hi = F.when(F.col("tok") == vocab_size, F.lit(1.0)).otherwise(F.round(F.sum(F.exp("logp")).over(w), digits))
    return model.select("ctx", "tok", hi.alias("hi"))


class CdfSampler:
    """Inverse-CDF sampler over a table student stored as parquet ``(ctx, tok, hi)``."""

    def __init__(self, path: str, vocab_size: int):
        import pyarrow.parquet as pq

        t = pq.read_table(path, columns=["ctx", "tok", "hi"]).to_pandas()
        cdf = np.ones((vocab_size + 1, vocab_size))
        cdf[t["ctx"].to_numpy(), t["tok"].to_numpy() - 1] = t["hi"].to_numpy()
        self.cdf = cdf

    def draw(self, ctx: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Smallest token id whose cumulative probability exceeds ``u``."""
        out = np.empty(len(ctx), dtype=np.int64)
        for c in np.unique(ctx):
            at = ctx == c
            out[at] = np.searchsorted(self.cdf[c], u[at], side="right") + 1
        return out


def with_uniforms(df: DataFrame, seed: int, id_col: str, budget_col: str, out_col: str = "u") -> DataFrame:
    """Array of ``budget`` keyed uniforms per row (step s uses ``md5(seed:id:s)``)."""
    steps = F.when(F.col(budget_col) > 0, F.sequence(F.lit(1), F.col(budget_col))).otherwise(
        F.array().cast("array<int>")
    )
    return df.withColumn(out_col, F.transform(steps, lambda s: keyed_uniform(seed, F.col(id_col), s)))


def sample_continuations(
    df: DataFrame,
    sampler: Callable[[], CdfSampler],
    seed: int,
    id_col: str = "id",
    ids_col: str = "input_ids",
    budget_col: str = "budget",
    keep: tuple[str, ...] = (),
    eos_id: int = EOS_ID,
    stop_at_eos: bool = True,
) -> DataFrame:
    """M3: temperature-1 draws from the student until EOS (kept) or the budget.

    Output ``id, *keep, new_ids array<int>, n_new int, finished boolean``.
    ``stop_at_eos=False`` keeps drawing to the budget (the reference's raw
    draws before finished rows are cut; see :func:`truncate_after_eos`).
    """
    src = with_uniforms(df, seed, id_col, budget_col).select(
        id_col, *keep, F.element_at(ids_col, -1).alias("__last"), budget_col, "u"
    )
    fields = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in (id_col, *keep))
    schema += ", new_ids array<int>, n_new int, finished boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        smp = sampler()
        for pdf in batches:
            n = len(pdf)
            budget = pdf[budget_col].to_numpy().astype(np.int64)
            kmax = int(budget.max()) if n else 0
            U = np.zeros((n, kmax))
            for i, u in enumerate(pdf["u"]):
                U[i, : len(u)] = u
            ctx = pdf["__last"].to_numpy().astype(np.int64)
            toks = np.zeros((n, kmax), dtype=np.int32)
            taken = np.zeros(n, dtype=np.int64)
            live = budget > 0
            for s in range(kmax):
                idx = np.nonzero(live & (s < budget))[0]
                if idx.size == 0:
                    break
                t = smp.draw(ctx[idx], U[idx, s])
                toks[idx, s] = t
                taken[idx] += 1
                ctx[idx] = t
                if stop_at_eos:
                    live[idx] &= t != eos_id
            out = pdf[[id_col, *keep]].copy()
            out["new_ids"] = [toks[i, : taken[i]] for i in range(n)]
            out["n_new"] = taken.astype(np.int32)
            out["finished"] = [bool((toks[i, : taken[i]] == eos_id).any()) for i in range(n)]
            yield out

    return src.mapInPandas(run, schema)
