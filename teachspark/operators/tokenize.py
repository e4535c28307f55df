"""P5: tokenisation.

Two paths:

* built-in: a regex word splitter plus a fitted vocabulary. Splitting is
  ``regexp_extract_all`` and the lookup is a literal map, so the whole thing
  is one native projection (whole-stage codegen, no Python, no shuffle).
  The vocabulary is fitted by a distributed count and a top-k, and only the
  k winning words reach the driver.
* plug-in: any Python tokenizer object behind an Arrow iterator UDF; the
  object is built once per Python worker, never per batch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BOS_ID, EOS_ID, FIRST_WORD_ID, TOKEN_PATTERN, TOKENIZE_MAX_LENGTH, UNK_ID

# A lookup table of more words belongs in a plug-in tokenizer instead.
MAX_LITERAL_VOCAB = 1 << 20
# Average words per hash bucket of the literal lookup table.
WORDS_PER_BUCKET = 4


def words(text: Column | str, pattern: str = TOKEN_PATTERN) -> Column:
    """Regex word split: every whole match (group 0), in order."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(t, F.lit(pattern), 0)


@dataclass(frozen=True)
class Vocabulary:
    """Words in id order: ``words[i]`` has id ``FIRST_WORD_ID + i``."""

    words: tuple[str, ...]
    pattern: str = TOKEN_PATTERN

    @property
    def model_size(self) -> int:
        """Largest id; the model vocabulary is ids 1..model_size."""
        return len(self.words) + FIRST_WORD_ID - 1

    @property
    def n_buckets(self) -> int:
        return max(1, len(self.words) // WORDS_PER_BUCKET)

    @cached_property
    def _index(self) -> dict[str, int]:
        return {w: FIRST_WORD_ID + i for i, w in enumerate(self.words)}

    @cached_property
    def _bucket_of(self) -> tuple[int, ...]:
        """Bucket of each word under Spark's own ``pmod(hash(word), B)`` (a job over the k words)."""
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        if spark is None or not self.words:
            raise RuntimeError("an active SparkSession is needed to place vocabulary words in buckets")
        df = spark.createDataFrame([(i, w) for i, w in enumerate(self.words)], "i int, w string")
        rows = df.select("i", F.pmod(F.hash("w"), F.lit(self.n_buckets)).alias("b")).collect()
        out = [0] * len(self.words)
        for r in rows:
            out[r["i"]] = r["b"]
        return tuple(out)

    def lookup(self) -> tuple[Column, Column] | None:
        """``(bucket expression factory input, literal array of per-bucket maps)``.

        A Spark map lookup scans its keys linearly, so one big map costs
        O(vocabulary) per token. The words are spread over ``B`` small maps
        by Spark's ``hash``; a token reads ``maps[pmod(hash(token), B)]``,
        a constant-time array index into a folded literal, then a scan of
        a few keys.
        """
        if not self.words:
            return None
        members: list[dict[str, int]] = [{} for _ in range(self.n_buckets)]
        for i, b in enumerate(self._bucket_of):
            members[b][self.words[i]] = FIRST_WORD_ID + i
        # One JSON text, which the optimizer parses and folds once: the plan has a single literal whatever the size.
        return F.lit(self.n_buckets), F.from_json(F.lit(json.dumps(members, ensure_ascii=False)), "array<map<string,int>>")

    def ids(self, text: Column | str, add_bos: bool = False) -> Column:
        """Untruncated id array for a text column (native expression)."""
        lk = self.lookup()
        if lk is None:
            out = F.transform(words(text, self.pattern), lambda w: F.lit(UNK_ID))
        else:
            nb, maps = lk
            out = F.transform(
                words(text, self.pattern),
                lambda w: F.coalesce(F.element_at(F.get(maps, F.pmod(F.hash(w), nb)), w), F.lit(UNK_ID)),
            )
        if add_bos:
            out = F.concat(F.array(F.lit(BOS_ID)), out)
        return out

    def encode(self, text: str, add_bos: bool = False) -> list[int]:
        """Pure-Python twin of :meth:`ids` (tests and plug-in parity)."""
        index = self._index
        out = [index.get(w, UNK_ID) for w in re.findall(self.pattern, text or "")]
        return ([BOS_ID] + out) if add_bos else out


def fit_vocabulary(texts: DataFrame, text_col: str, n_words: int, pattern: str = TOKEN_PATTERN) -> Vocabulary:
    """Top ``n_words`` words by (count desc, word asc).

    The count is a partial + final hash aggregate (a hot word collapses to one
    row per map task before the shuffle); the top-k is a bounded
    TakeOrderedAndProject, so only ``n_words`` rows reach the driver.
    """
    if n_words > MAX_LITERAL_VOCAB:
        raise ValueError(f"built-in vocabulary capped at {MAX_LITERAL_VOCAB} words; plug in a tokenizer")
    counts = (
        texts.select(F.explode(words(text_col, pattern)).alias("word"))
        .groupBy("word")
        .count()
    )
    top = counts.orderBy(F.desc("count"), F.asc("word")).limit(n_words).collect()
    return Vocabulary(tuple(r["word"] for r in top), pattern)


def tokenize(
    df: DataFrame,
    text_col: str,
    vocab: Vocabulary,
    out_col: str = "input_ids",
    max_length: int | None = TOKENIZE_MAX_LENGTH,
    add_bos: bool = False,
    count_col: str | None = None,
) -> DataFrame:
    """P5 (built-in): add ``out_col`` (truncated to ``max_length``) and optionally the untruncated count."""
    tmp = f"__{out_col}_full"
    df = df.withColumn(tmp, vocab.ids(text_col, add_bos))
    if count_col:
        df = df.withColumn(count_col, F.size(tmp))
    ids = F.slice(tmp, 1, max_length) if max_length else F.col(tmp)
    return df.withColumn(out_col, ids).drop(tmp)


class PluginTokenizer:
    """Interface for plugged-in tokenizers: ``encode_batch`` is the only call."""

    pad_id: int = EOS_ID

    def encode_batch(self, texts: list[str]) -> list[list[int]]:  # pragma: no cover - interface
        raise NotImplementedError


def tokenize_with(
    df: DataFrame,
    text_col: str,
    factory: Callable[[], PluginTokenizer],
    out_col: str = "input_ids",
    max_length: int | None = TOKENIZE_MAX_LENGTH,
) -> DataFrame:
    """P5 (plug-in): Arrow-batched iterator UDF; ``factory()`` runs once per Python worker."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = factory()
        for texts in batches:
            ids = tok.encode_batch(texts.fillna("").tolist())
            if max_length:
                ids = [x[:max_length] for x in ids]
            yield pd.Series(ids)

    return df.withColumn(out_col, _encode(F.col(text_col)))
