"""M1/M2: scoring sequences with a teacher and a student.

* Table models (native): a position's scores are a join on its context
  token; the model table is bounded by the vocabulary.
* Plug-in models: ``mapInPandas`` over whole sequences. Each Python worker
  builds the scorers once (``factory()``), scores a batch of sequences and
  emits per-position scalars only, so the [positions x V] logits never leave
  the worker (score and divergence are fused in one map).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .table_lm import join_model


def score_next(positions: DataFrame, model: DataFrame, model_rows: int, out_col: str) -> DataFrame:
    """Log-probability the model gives the actual next token, per position."""
    m = model.select("ctx", F.col("tok").alias("next_tok"), F.col("logp").alias(out_col))
    return join_model(positions, m, ["ctx", "next_tok"], model_rows)


class Scorer:
    """Plug point: ``logits(list of id arrays) -> list of [len, V] arrays`` over ids 1..V."""

    def logits(self, seqs: list[np.ndarray]) -> list[np.ndarray]:  # pragma: no cover - interface
        raise NotImplementedError


class TableScorer(Scorer):
    """A table model as a scorer; loaded from parquet on shared storage, once per worker."""

    def __init__(self, path: str, vocab_size: int):
        import pyarrow.parquet as pq

        t = pq.read_table(path, columns=["ctx", "tok", "logp"]).to_pandas()
        mat = np.full((vocab_size + 1, vocab_size), -np.inf)
        mat[t["ctx"].to_numpy(), t["tok"].to_numpy() - 1] = t["logp"].to_numpy()
        self.mat = mat

    def logits(self, seqs):
        return [self.mat[np.asarray(s, dtype=np.int64)] for s in seqs]


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z.astype(np.float64)
    m = z.max(axis=-1, keepdims=True)
    return z - (m + np.log(np.exp(z - m).sum(axis=-1, keepdims=True)))


def position_divergences(lp: np.ndarray, lq: np.ndarray) -> dict[str, np.ndarray]:
    """Per-row KL(P||S), KL(S||P) and the reference JSD for log-prob matrices."""
    P, S = np.exp(lp), np.exp(lq)
    lm = np.log(0.5 * P + 0.5 * S)
    M = np.exp(lm)
    return {
        "kl_ts": (P * (lp - lq)).sum(-1),
        "kl_st": (S * (lq - lp)).sum(-1),
        "jsd_ref": 0.5 * (M * (lm - lp)).sum(-1) + 0.25 * (M * (lm - lq)).sum(-1),
    }


def score_pair_mapped(
    df: DataFrame,
    teacher: Callable[[], Scorer],
    student: Callable[[], Scorer],
    pad_id: int,
    keep: tuple[str, ...],
    ids_col: str = "input_ids",
    positions_at_once: int = 4096,
) -> DataFrame:
    """Fused M1 + M2 + A2-A4 per judged position, via one Arrow map.

    Output ``*keep, pos, ctx, kl_ts, kl_st, jsd_ref``; positions judged where
    ``ids[t+1] != pad`` (P10). A worker scores sequences until they have
    ``positions_at_once`` positions, emits their rows and goes on, so it holds
    that many (or one sequence's) rows of logits a model, whatever the batch.
    """
    key_fields = [f for f in df.schema.fields if f.name in keep]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in key_fields)
    schema += ", pos int, ctx int, kl_ts double, kl_st double, jsd_ref double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, s = teacher(), student()
        for pdf in batches:
            all_seqs = [np.asarray(x, dtype=np.int64) for x in pdf[ids_col]]
            begin = 0
            while begin < len(all_seqs):
                end, size = begin, 0
                while end < len(all_seqs) and (end == begin or size + len(all_seqs[end]) <= positions_at_once):
                    size += len(all_seqs[end])
                    end += 1
                yield from judge(t, s, pdf.iloc[begin:end], all_seqs[begin:end])
                begin = end

    def judge(t: Scorer, s: Scorer, pdf: pd.DataFrame, seqs: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        tl, sl = t.logits(seqs), s.logits(seqs)
        out = []
        for i, ids in enumerate(seqs):
            if len(ids) < 2:
                continue
            judged = np.nonzero(ids[1:] != pad_id)[0]
            if judged.size == 0:
                continue
            d = position_divergences(_log_softmax(tl[i][judged]), _log_softmax(sl[i][judged]))
            part = pd.DataFrame({"pos": judged.astype(np.int32), "ctx": ids[judged].astype(np.int32), **d})
            for k in keep:
                part.insert(0, k, pdf[k].iloc[i])
            out.append(part)
        if out:
            yield pd.concat(out, ignore_index=True)

    return df.select(*keep, ids_col).mapInPandas(run, schema)
