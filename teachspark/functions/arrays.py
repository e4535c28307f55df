"""Token-array expressions: counts, masks, truncation, budgets (all native)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FILL_ID, IGNORE_INDEX


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def token_count(ids: Column | str, pad_id: int) -> Column:
    """Number of non-pad ids."""
    return F.size(F.filter(_c(ids), lambda x: x != F.lit(pad_id)))


def mask_source(ids: Column | str, source_len: Column | str | int, train_on_inputs: bool = False) -> Column:
    """labels = ids with the first ``source_len`` entries set to IGNORE_INDEX."""
    ids = _c(ids)
    if train_on_inputs:
        return ids
    n = F.lit(source_len) if isinstance(source_len, int) else _c(source_len)
    return F.transform(ids, lambda x, i: F.when(i < n, F.lit(IGNORE_INDEX)).otherwise(x))


def attention_mask(ids: Column | str, pad_id: int) -> Column:
    """True where the id is not the pad id."""
    return F.transform(_c(ids), lambda x: x != F.lit(pad_id))


def truncate_ids(ids: Column | str, n: int | Column) -> Column:
    """Keep the first ``n`` ids."""
    return F.slice(_c(ids), 1, n if isinstance(n, Column) else F.lit(n))


def pad_right(ids: Column | str, width: Column, value: int) -> Column:
    """Right-pad an array to ``width`` with ``value`` (B5 collate)."""
    ids = _c(ids)
    return F.concat(ids, F.array_repeat(F.lit(value), width - F.size(ids)))


def generation_budget(length: Column | str, max_tokens: int) -> Column:
    """M4: tokens the sampler may add; zero when the prompt already fills the budget."""
    return F.greatest(F.lit(0), F.lit(max_tokens) - _c(length))


def truncate_after_eos(ids: Column | str, eos_id: int) -> Column:
    """M5: cut after the first EOS, keeping the EOS itself."""
    ids = _c(ids)
    p = F.array_position(ids, eos_id)
    return F.when(p > 0, F.slice(ids, 1, p.cast("int"))).otherwise(ids)


def onpolicy_mask(prompt_mask: Column | str, n_new: Column | str, ids: Column | str) -> Column:
    """M6: prompt mask, then ones for the new tokens, AND id <> FILL_ID."""
    full = F.concat(_c(prompt_mask), F.array_repeat(F.lit(True), _c(n_new)))
    return F.zip_with(full, _c(ids), lambda m, x: m & (x != F.lit(FILL_ID)))
