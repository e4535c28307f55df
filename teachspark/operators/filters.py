"""Length filters and batch/step limits (all native, pushable when stored)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TOKENIZE_MAX_LENGTH


def filter_prompt_length(df: DataFrame, max_seq_len: int, count_col: str = "n_tokens") -> DataFrame:
    """keep prompts whose untruncated token count is strictly below the limit."""
    return df.filter(F.col(count_col) < max_seq_len)


def filter_example_length(
    df: DataFrame, model_max_length: int, count_col: str = "n_tokens", trunc: int = TOKENIZE_MAX_LENGTH
) -> DataFrame:
    """keep examples with ``min(n, trunc) < model_max_length``.

    The count is taken after truncation, so a limit above ``trunc`` keeps all rows.
    """
    return df.filter(F.least(F.col(count_col), F.lit(trunc)) < model_max_length)


def skip_batches(df: DataFrame, k: int | None, batch_col: str = "batch_no") -> DataFrame:
    """drop the first ``k`` batches of every epoch (they still count as steps)."""
    return df if not k else df.filter(F.col(batch_col) >= k)


def limit_batches(df: DataFrame, cap: int | None, inclusive: bool = True, batch_col: str = "batch_no") -> DataFrame:
    """evaluation cap. The reference stops on ``i > cap``, so cap+1 batches are judged."""
    if cap is None:
        return df
    return df.filter(F.col(batch_col) <= cap) if inclusive else df.filter(F.col(batch_col) < cap)


def limit_steps(df: DataFrame, max_steps: int | None, step_col: str = "step") -> DataFrame:
    """the loop stops once completed steps reach ``max_steps``."""
    return df if max_steps is None else df.filter(F.col(step_col) < max_steps)
