"""M3 and M7 with models that read whole prefixes: ragged decoding and fused judging.

A model keeps a state per row (a transformer its cached keys and values, the
table model below its last two ids). Decoding is one Arrow map over rows
dealt evenly to tasks: rows are taken in micro-batches of bounded ``rows x V``, and the
active set shrinks as rows reach the end mark or their budget, so no row draws
for another that still runs. Judging samples, scores the text with both
models and reduces it to sums in the same pass: neither logits nor sampled
positions leave a worker, only ``(n, sums)`` per batch, which merge.

Draws are keyed uniforms (see :mod:`.onpolicy`), so a retried task repeats them.

A table model's counts are a written table with a row per context. Workers read it from the folder
all executors share, once each, into arrays of the least width; the driver never holds it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BOS_ID, EOS_ID, FILL_ID
from ..session import shared_path
from .onpolicy import with_uniforms
from .scoring import _log_softmax, position_divergences

#: Logits (rows x V) that a worker holds a model.
CELLS = 1 << 20
#: Observed rows that a table model may bring to each worker.
MODEL_ROWS = 20_000_000
#: Digits to which cumulative probabilities are rounded, so that draws don't hang on the order of a sum.
DIGITS = 12


class PrefixModel:
    """Plug point: next-token logits over ids 1..V given whole prefixes.

    ``start`` reads prompts and returns a state of one entry a row; ``next_logits`` gives ``[rows, V]``;
    ``push`` appends a token to each row; ``take`` keeps some rows. ``score`` gives the logits of a
    sequence's positions ``begin..end-1``, each after the ids up to and including that position.
    """

    vocab_size: int

    def start(self, seqs: list[np.ndarray]):  # pragma: no cover - interface
        raise NotImplementedError

    def next_logits(self, state) -> np.ndarray:  # pragma: no cover - interface
        raise NotImplementedError

    def push(self, state, tokens: np.ndarray):  # pragma: no cover - interface
        raise NotImplementedError

    def take(self, state, rows: np.ndarray):
        return state[rows]

    def score(self, seq: np.ndarray, begin: int, end: int) -> np.ndarray:  # pragma: no cover - interface
        raise NotImplementedError


class _Counts:
    """Counts of successors by context key: those of ``keys[i]`` are ``tok`` and ``n`` from ``starts[i]`` to ``ends[i]``."""

    def __init__(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, totals: np.ndarray, tok: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.starts, self.ends, self.totals = keys[order], starts[order], ends[order], totals[order]
        self.tok, self.n = tok, n

    def onto(self, probs: np.ndarray, key: np.ndarray, alpha: float) -> np.ndarray:
        """``(n(key, v) + alpha * probs) / (n(key) + alpha)`` by row; rows of unknown keys keep their probabilities."""
        if not len(self.keys):
            return probs
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        rows = np.flatnonzero(self.keys[at] == key)
        at = at[rows]
        size = self.ends[at] - self.starts[at]
        flat = np.repeat(self.starts[at], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        probs = probs.copy()
        probs[rows] *= alpha
        probs[np.repeat(rows, size), self.tok[flat] - 1] += self.n[flat]
        probs[rows] /= (self.totals[at] + alpha)[:, None]
        return probs


class BackoffModel(PrefixModel):
    """P(v | a, b) from counts after two ids, smoothed by those after one id, and those by single counts."""

    def __init__(self, u: np.ndarray, pairs: _Counts, triples: _Counts, alpha2: float, alpha3: float) -> None:
        self.u, self.pairs, self.triples, self.alpha2, self.alpha3 = u, pairs, triples, alpha2, alpha3
        self.vocab_size = len(u)

    def _logits(self, state: np.ndarray) -> np.ndarray:
        probs = self.pairs.onto(np.repeat(self.u[None], len(state), 0), state[:, 1], self.alpha2)
        return np.log(self.triples.onto(probs, state[:, 0] * (self.vocab_size + 1) + state[:, 1], self.alpha3))

    def start(self, seqs):
        return np.array([[s[-2] if len(s) > 1 else BOS_ID, s[-1] if len(s) else BOS_ID] for s in seqs], np.int64).reshape(-1, 2)

    def next_logits(self, state):
        return self._logits(state)

    def push(self, state, tokens):
        return np.column_stack([state[:, 1], tokens])

    def score(self, seq, begin, end):
        before = np.concatenate(([BOS_ID], seq))[begin:end]
        return self._logits(np.column_stack([before, seq[begin:end]]))


def triple_counts(seqs: DataFrame, vocab_size: int, ids_col: str = "input_ids") -> DataFrame:
    """``(a, b, v, n)``: how often ``v`` follows ``a, b`` (``a = 0``: ``b`` comes first) in every whole sequence, begin and end marks included."""
    V = vocab_size
    s = F.concat(F.array(F.lit(BOS_ID)), F.col(ids_col), F.array(F.lit(EOS_ID)))
    n = F.size("s") - 1
    before = F.concat(F.array(F.lit(0)), F.slice("s", 1, n - 1))
    triples = F.arrays_zip(before.alias("a"), F.slice("s", 1, n).alias("b"), F.slice("s", 2, n).alias("v"))
    counts = seqs.where(F.col(ids_col).isNotNull()).select(s.alias("s")).select(F.inline(triples)).groupBy("a", "b", "v").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("b").between(1, V) & F.col("v").between(1, V))


def context_rows(triples: DataFrame, vocab_size: int) -> DataFrame:
    """``(key, tok, n)``: a row per context with its successors (at most V) and their counts; ``key`` is ``b`` after one id, ``a * (V + 1) + b`` after two.

    ``triples`` (a written table) is counted first: more than ``MODEL_ROWS`` are refused, such a model needs a
    plug-in that loads its own files.
    """
    if triples.count() > MODEL_ROWS:
        raise ValueError(f"more than {MODEL_ROWS} different triples: plug in a model that loads its own files")
    pairs = triples.groupBy("b", "v").agg(F.sum("n").alias("n")).select(F.lit(0).alias("a"), "b", "v", "n")
    key = F.col("a").cast("long") * (vocab_size + 1) + F.col("b")
    rows = triples.where("a > 0").unionByName(pairs).groupBy(key.alias("key")).agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("seen"))
    return rows.select("key", F.col("seen.v").alias("tok"), F.col("seen.n").alias("n"))


def load_backoff(path: str, vocab_size: int, alpha2: float, alpha3: float, k: float = 1.0) -> BackoffModel:
    """The model of a table that :func:`context_rows` wrote, read file by file."""
    from pyarrow import dataset

    keys, sizes, tok, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.uint8)]
    for part in dataset.dataset(path, format="parquet").get_fragments():
        for rows in part.to_table(columns=["key", "tok", "n"], use_threads=False).to_batches():
            keys.append(rows["key"].to_numpy())
            sizes.append(rows["tok"].value_lengths().to_numpy().astype(np.int64))
            tok.append(rows["tok"].flatten().to_numpy().astype(np.min_scalar_type(vocab_size)))
            seen = rows["n"].flatten().to_numpy()
            n.append(seen.astype(np.min_scalar_type(seen.max(initial=0))))
    keys, sizes, tok, n = (np.concatenate(x) for x in (keys, sizes, tok, n))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    totals = np.add.reduceat(n, starts, dtype=np.float64) if len(keys) else np.zeros(0)
    one = keys <= vocab_size  # contexts of one id; the others are of two
    pairs, triples = (_Counts(keys[x], starts[x], ends[x], totals[x], tok, n) for x in (one, ~one))
    single = np.repeat(one, sizes)
    u = float(k) + np.bincount(tok[single].astype(np.int64) - 1, n[single], vocab_size)
    return BackoffModel(u / u.sum(), pairs, triples, alpha2, alpha3)


def fit_backoff(seqs: DataFrame, vocab_size: int, alpha2: float, alpha3: float, k: float = 1.0, ids_col: str = "input_ids") -> BackoffModel:
    """The model of all triples of every whole sequence, loaded where this is called; :func:`stored` loads a written one in the workers."""
    spark, root = seqs.sparkSession, shared_path(seqs.sparkSession, f"backoff-{uuid.uuid4().hex}")
    triple_counts(seqs, vocab_size, ids_col).write.parquet(f"{root}/triples")
    context_rows(spark.read.parquet(f"{root}/triples"), vocab_size).write.parquet(f"{root}/contexts")
    return load_backoff(f"{root}/contexts", vocab_size, alpha2, alpha3, k)


@lru_cache(maxsize=2)
def _held(path: str, vocab_size: int, alpha2: float, alpha3: float, k: float) -> BackoffModel:
    """A worker keeps the teacher and the student that it loaded last."""
    return load_backoff(path, vocab_size, alpha2, alpha3, k)


def stored(path: str, vocab_size: int, alpha2: float, alpha3: float, k: float = 1.0) -> Callable[[], PrefixModel]:
    """A factory that loads the model of a written table in each worker, once."""
    return lambda: _held(path, vocab_size, alpha2, alpha3, k)


def shared(spark, model: PrefixModel) -> Callable[[], PrefixModel]:
    """A factory that hands each worker the broadcast model."""
    held = spark.sparkContext.broadcast(model)
    return lambda: held.value


def draw(logits: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Smallest id whose cumulative probability (in id order, rounded; the last is 1) exceeds ``u``."""
    high = np.round(np.cumsum(np.exp(_log_softmax(logits)), axis=1), DIGITS)
    high[:, -1] = 1.0
    return (high <= u[:, None]).sum(1) + 1


def decode(model: PrefixModel, prompts: list[np.ndarray], uniforms: list[np.ndarray], eos_id: int = EOS_ID, stop_at_eos: bool = True, cells: int = CELLS) -> list[np.ndarray]:
    """New ids of each prompt: at most as many as it has uniforms; a row leaves the active set when it ends."""
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(prompts)
    at_once = max(1, cells // model.vocab_size)
    # Rows of like budgets share a micro-batch; the result doesn't depend on it.
    order = np.argsort([-len(u) for u in uniforms], kind="stable")
    for begin in range(0, len(order), at_once):
        rows = np.array([i for i in order[begin : begin + at_once] if len(uniforms[i])], np.int64)
        if not len(rows):
            continue
        state = model.start([prompts[i] for i in rows])
        taken: dict[int, list[int]] = {int(i): [] for i in rows}
        step = 0
        while len(rows):
            tokens = draw(model.next_logits(state), np.array([uniforms[i][step] for i in rows]))
            for i, t in zip(rows.tolist(), tokens.tolist(), strict=True):
                taken[i].append(t)
            step += 1
            alive = np.array([len(uniforms[i]) > step for i in rows])
            if stop_at_eos:
                alive &= tokens != eos_id
            state = model.push(model.take(state, np.flatnonzero(alive)), tokens[alive])
            rows = rows[alive]
        for i, ids in taken.items():
            out[i] = np.array(ids, np.int32)
    return out


def _source(df: DataFrame, seed: int, id_col: str, ids_col: str, budget_col: str, keep: tuple[str, ...]) -> tuple[DataFrame, str]:
    # A small file may hold the prompts of hours of decoding: rows are dealt evenly, whatever the files.
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    src = with_uniforms(dealt, seed, id_col, budget_col).select(id_col, *keep, F.col(ids_col).alias("__ids"), "u")
    fields = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    return src, ", ".join(f"{c} {fields[c]}" for c in (id_col, *keep))


def sample_prefix_model(
    df: DataFrame,
    model: Callable[[], PrefixModel],
    seed: int,
    id_col: str = "id",
    ids_col: str = "input_ids",
    budget_col: str = "budget",
    keep: tuple[str, ...] = (),
    eos_id: int = EOS_ID,
    stop_at_eos: bool = True,
    cells: int = CELLS,
) -> DataFrame:
    """M3: ``id, *keep, new_ids, n_new, finished``; ``budget_col`` is a row's or its batch's budget (M4)."""
    src, schema = _source(df, seed, id_col, ids_col, budget_col, keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model()
        for pdf in batches:
            new = decode(m, [np.asarray(x, np.int64) for x in pdf["__ids"]], [np.asarray(x, float) for x in pdf["u"]], eos_id, stop_at_eos, cells)
            out = pdf[[id_col, *keep]].copy()
            out["new_ids"], out["n_new"], out["finished"] = new, [len(x) for x in new], [bool((x == eos_id).any()) for x in new]
            yield out

    return src.mapInPandas(run, schema + ", new_ids array<int>, n_new int, finished boolean")


def judged_positions(prompt: np.ndarray, full: np.ndarray, pad_id: int, scope: str = "all") -> np.ndarray:
    """M6: positions t whose next id is judged: the prompt's mask (not padding), then every new id, never FILL_ID.

    ``scope='generated'`` keeps the positions whose next id is new.
    """
    if scope not in ("all", "generated"):
        raise ValueError(f"unknown scope {scope!r}")
    mask = np.ones(len(full), bool)
    mask[: len(prompt)] = prompt != pad_id if scope == "all" else False
    return np.flatnonzero((mask & (full != FILL_ID))[1:])


SUMS = ("kl_ts", "kl_st", "jsd_ref")


def onpolicy_score_mapped(
    df: DataFrame,
    teacher: Callable[[], PrefixModel],
    student: Callable[[], PrefixModel],
    seed: int,
    by: tuple[str, ...],
    pad_id: int,
    scope: str = "all",
    id_col: str = "id",
    ids_col: str = "input_ids",
    budget_col: str = "budget",
    eos_id: int = EOS_ID,
    cells: int = CELLS,
) -> DataFrame:
    """M3, M6, M7 and A2-A4 in one map, then A6: ``*by, n_positions, kl_ts, kl_st, jsd_ref`` (means over judged positions).

    A worker emits a row of sums per batch key and Arrow batch; those are added up by key.
    """
    src, schema = _source(df, seed, id_col, ids_col, budget_col, by)

    def judge(t: PrefixModel, s: PrefixModel, full: np.ndarray, judged: np.ndarray) -> np.ndarray:
        total, width = np.zeros(len(SUMS)), max(1, cells // max(t.vocab_size, s.vocab_size))
        for begin in range(0, len(full) - 1, width):
            end = min(begin + width, len(full) - 1)
            rows = judged[(judged >= begin) & (judged < end)] - begin
            if len(rows):
                d = position_divergences(_log_softmax(t.score(full, begin, end)[rows]), _log_softmax(s.score(full, begin, end)[rows]))
                total += [d[c].sum() for c in SUMS]
        return total

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, s = teacher(), student()
        for pdf in batches:
            prompts = [np.asarray(x, np.int64) for x in pdf["__ids"]]
            rows = []
            for prompt, new in zip(prompts, decode(s, prompts, [np.asarray(x, float) for x in pdf["u"]], eos_id, True, cells), strict=True):
                full = np.concatenate([prompt, new]).astype(np.int64)
                judged = judged_positions(prompt, full, pad_id, scope)
                rows.append((len(judged), *judge(t, s, full, judged)))
            out = pdf[list(by)].copy()
            out[["n", *SUMS]] = np.array(rows, float).reshape(-1, 1 + len(SUMS))
            merged = out.groupby(list(by), dropna=False, as_index=False).sum()
            merged["n"] = merged["n"].astype("int64")
            yield merged

    fields = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in by)
    parts = src.mapInPandas(run, f"{fields}, n long, " + ", ".join(f"{c} double" for c in SUMS))
    total = F.sum("n")
    return parts.groupBy(*by).agg(total.alias("n_positions"), *[(F.sum(c) / total).alias(c) for c in SUMS]).where("n_positions > 0")
