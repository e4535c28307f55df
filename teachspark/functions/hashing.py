"""Keyed draws: ``md5(seed ':' key)`` so results survive retries and re-partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_48 = 281474976710656.0


def keyed_md5(seed: int, *keys: Column | str) -> Column:
    """Hex md5 of ``seed:key1:key2...`` (keys cast to string)."""
    parts: list[Column] = [F.lit(str(seed))]
    for k in keys:
        col = F.col(k) if isinstance(k, str) else k
        parts += [F.lit(":"), col.cast("string")]
    return F.md5(F.concat(*parts))


def keyed_uniform(seed: int, *keys: Column | str) -> Column:
    """Uniform in [0, 1) from the first 12 hex digits (48 bits) of the keyed md5."""
    h = keyed_md5(seed, *keys)
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("bigint") / F.lit(TWO_48)


def fraction_threshold(frac: float) -> str:
    """8-hex-digit threshold: a hash prefix below it falls in a ``frac`` share."""
    if not 0.0 <= frac <= 1.0:
        raise ValueError("fraction must be within [0, 1]")
    return format(min(math.ceil(frac * 2**32), 2**32 - 1), "08x")
