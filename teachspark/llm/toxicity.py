"""Operator 6: toxicity by multiple-instance learning.

A document is a bag of sentences; it is toxic if at least one of them is. Each sentence has a
probability (logistic over the lexicon words in it), and a document's is their noisy-or,
``1 - prod(1 - p)``. Only documents carry labels; the likelihood of these labels trains the
sentence weights, which then also say where the offending sentences are.

The fit sees at most ``SAMPLE`` labelled rows (those with the least hash of their id, so any run
takes the same), of which Spark counts words and finds the lexicon; what reaches the driver is the
lexicon (``LEXICON`` words) and, for each sampled document, the lexicon words of its sentences, two
bytes each; the fit spreads them out piece by piece.
Scoring covers every document and is one map without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut

#: Labelled rows that the fit may use, and words of the lexicon.
SAMPLE, LEXICON = 20_000, 2_000
#: A feature enters the lexicon if its likelihood ratio against the labels is this high and it is in so many different texts of the sample.
SIGNIFICANT, LEAST_DOCUMENTS = 15.0, 4
#: Steps, rate and pull towards the prior of the fit.
STEPS, RATE, DECAY = 400, 0.2, 2e-5
#: A document is predicted toxic from this score on; a sentence offends from this probability on.
THRESHOLD, OFFENDING = 0.3, 0.25

#: A sentence runs from its first letter to the next full stop, mark or line end.
SENTENCE = re.compile(r"[^\W\d_][^.!?\n]*")
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of longer words that are features too: inflected forms share them.
STEMS = (4, 5, 6)
#: Words whose features a scorer remembers.
REMEMBERED = 300_000


def word_features(word: str) -> list[str]:
    """A word (lower case) and, marked by a hyphen, its beginnings."""
    return [word, *[word[:k] + "-" for k in STEMS if len(word) > k]]


def lower(text: str) -> str:
    """Lower case without changing any offset."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def sentence_features(text: str, lexicon: dict[str, int], memory: dict[str, list[int]]) -> tuple[int, list[tuple[int, int, list[int]]]]:
    """How many sentences there are, and ``(start, end, sorted lexicon ids)`` of those that have lexicon words."""
    text = lower(text)
    if len(memory) > REMEMBERED:
        memory.clear()
    hits = {}
    for w in set(WORD.findall(text)):
        if (ids := memory.get(w)) is None:
            ids = memory[w] = [lexicon[f] for f in word_features(w) if f in lexicon]
        if ids:
            hits[w] = ids
    if not hits:
        return len(SENTENCE.findall(text)), []
    count, out = 0, []
    for m in SENTENCE.finditer(text):
        count += 1
        if found := {i for w in WORD.findall(m.group()) if w in hits for i in hits[w]}:
            out.append((m.start(), m.end(), sorted(found)))
    return count, out


@dataclass
class Model:
    """Lexicon, weights and bias; without any toxic or any clean example every score is 0."""

    lexicon: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -np.inf
    memory: dict[str, list[int]] = field(default_factory=dict)

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or of the document's sentences, and its offending sentences as ``(start, end, probability)``."""
        count, found = sentence_features(text or "", self.lexicon, self.memory)
        quiet = np.logaddexp(0, self.bias)  # -log(1 - p) of a sentence without lexicon words
        total, worst = max(0, count - len(found)) * quiet, []
        for start, end, ids in found:
            z = self.bias + self.weights[ids].sum()
            total += np.logaddexp(0, z)
            if (p := 1 / (1 + np.exp(-z))) >= OFFENDING:
                worst.append((start, end, float(p)))
        return float(-np.expm1(-total)), worst


#: Lexicon ids of the sample that a step of the fit spreads out at a time (or one document's).
PIECE = 1 << 20


def pack(found: list[list[int]]) -> bytes:
    """Sentences' lexicon ids, each plus one in two bytes, a zero after each sentence. Bytes compare as the lists do."""
    return np.array([x for ids in found for x in (*[i + 1 for i in ids], 0)], ">u2").tobytes()


def fit_noisy_or(counts: list[int], bags: list[bytes], labels: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias that make the labels likely. A bag is a document's sentence count and the word ids of those sentences that have any (see :func:`pack`).

    Weights begin at, and are drawn towards, ``prior``: what else is in a bag may explain its label
    without a word, which says nothing against the word.
    """
    words = len(prior)
    codes = np.frombuffer(b"".join(bags), ">u2").astype(np.uint16)
    ends = np.flatnonzero(codes == 0)
    sizes, flat = np.diff(ends, prepend=-1) - 1, codes[codes > 0] - np.uint16(1)
    found = np.diff(np.searchsorted(ends, np.cumsum([len(b) // 2 for b in bags])), prepend=0)
    plain = np.maximum(0, np.array(counts) - found).astype(float)
    # Pieces of whole bags, so that memory follows the piece: its bags, sentences and word ids from .. to.
    sentences, ids = np.append(0, np.cumsum(found)), np.append(0, np.cumsum(sizes))
    edges = np.append(np.flatnonzero(np.diff(ids[sentences[:-1]] // PIECE, prepend=-1)), len(bags))
    pieces = [(slice(i, j), slice(sentences[i], sentences[j]), slice(ids[sentences[i]], ids[sentences[j]])) for i, j in zip(edges[:-1], edges[1:], strict=True)]

    def spread(own: slice, mine: slice, at: slice) -> tuple:
        return own, np.repeat(np.arange(own.stop - own.start), found[own]), np.repeat(np.arange(mine.stop - mine.start), sizes[mine]), flat[at].astype(np.int64)

    whole = [spread(*pieces[0])] if len(pieces) == 1 else None
    y = labels.astype(float)
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    start = np.log(share / max(1.0, (plain.sum() + len(sizes)) / len(bags)))
    theta = np.append(prior, start)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        grad = np.zeros_like(theta)
        for own, owner, sentence, word in whole or (spread(*p) for p in pieces):
            z = theta[-1] + np.bincount(sentence, theta[word], len(owner))
            total = np.bincount(owner, np.logaddexp(0, z), own.stop - own.start) + plain[own] * np.logaddexp(0, theta[-1])
            total = np.maximum(total, 1e-9)
            # d(-log likelihood) / d total: 1 for clean bags, -1 / (e^total - 1) for toxic ones.
            pull = np.where(y[own] > 0, -1 / np.expm1(np.minimum(total, 50)), 1.0)
            part = pull[owner] / (1 + np.exp(-z))
            grad += np.append(np.bincount(word, part[sentence], words), part.sum() + (pull * plain[own]).sum() / (1 + np.exp(-theta[-1])))
        grad /= len(bags)
        grad[:-1] += DECAY * (theta[:-1] - prior)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on documents (doc_id, text) whose label row (doc_id, toxic; a grade above 0 is toxic) is not null and not held out.

    Rows repeated in either table count as often as they match. Fewer than one example of each
    class gives the model that scores everything 0.
    """
    bounded_batches(docs.sparkSession)
    rows = labels.select("doc_id", (F.col("toxic").cast("int") > 0).cast("int").alias("toxic")).where("toxic is not null and doc_id is not null").where(~held_out("doc_id"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    examples = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null"), "toxic-sample")
    seen = examples.groupBy("toxic").count().collect()
    n = {1: 0, 0: 0} | {int(r["toxic"] > 0): r["count"] for r in seen}
    if not n[1] or not n[0]:
        return Model()
    different = examples.dropDuplicates(["toxic", "text"])
    n = n | {int(r["toxic"] > 0): r["count"] for r in different.groupBy("toxic").count().collect()}

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
                found = {f for w in set(WORD.findall(lower(text))) for f in word_features(w)}
                yield pd.DataFrame({"toxic": np.full(len(found), toxic, "int32"), "word": list(found)})

    words = different.select("toxic", "text").mapInPandas(features, "toxic int, word string")
    df = words.groupBy("word").agg(F.count_if(F.col("toxic") > 0).alias("a"), F.count_if(F.col("toxic") <= 0).alias("b"))
    term = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    a, b, t = F.col("a"), F.col("b"), F.lit(float(n[1] + n[0]))
    rest = t - a - b
    ratio = 2 * (term(a, (a + b) * n[1] / t) + term(b, (a + b) * n[0] / t) + term(n[1] - a, rest * n[1] / t) + term(n[0] - b, rest * n[0] / t))
    odds = F.log((a + 0.5) * (n[0] - b + 0.5) / ((b + 0.5) * (n[1] - a + 0.5)))
    best = df.where(a + b >= LEAST_DOCUMENTS).select("word", odds.alias("odds"), F.round(ratio, 6).alias("ratio")).where(F.col("ratio") >= SIGNIFICANT)
    chosen_words = best.orderBy(F.desc("ratio"), "word").limit(LEXICON).collect()
    lexicon = {r["word"]: i for i, r in enumerate(chosen_words)}
    prior = np.clip([r["odds"] for r in chosen_words], -2.0, 6.0) / 2

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict[str, list[int]] = {}
        for batch in batches:
            found = [sentence_features(t, lexicon, memory) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"].astype("int32"), "n": [c for c, _ in found], "ids": [pack([ids for _, _, ids in s]) for _, s in found]})

    got = examples.select("toxic", "text").mapInPandas(bags, "toxic int, n long, ids binary").collect()
    got.sort(key=lambda r: (r["toxic"], r["n"], r["ids"]))  # sums don't depend on the order rows came in
    weights, bias = fit_noisy_or([r["n"] for r in got], [r["ids"] for r in got], np.array([r["toxic"] > 0 for r in got]), prior)
    return Model(lexicon, weights, bias)


def held_out(doc_id: str):
    """Rows kept for testing: crc32 of the id as text leaves 2 by 4 (a null id isn't held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Adds a struct ``toxicity`` to every row: score, predicted, and the offending sentences (offsets in characters).

    Null and empty texts score 0. A column named ``toxicity`` is replaced; the others stay.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<score:double,predicted:int,offending:array<struct<start:int,stop:int,probability:double>>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for texts in batches:
            rows = [model.score(t if isinstance(t, str) else None) for t in texts]
            yield pd.DataFrame(
                {"score": [s for s, _ in rows], "predicted": np.array([s >= threshold for s, _ in rows], "int32"), "offending": [[{"start": i, "stop": j, "probability": p} for i, j, p in w] for _, w in rows]}
            )

    return docs.withColumn("toxicity", score(F.col("text")))
