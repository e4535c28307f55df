"""Plans and queries over whole tables: sparse models, all-step gradients, prefix-model sampling and judging.

Both models are fitted on whole tables: the teacher on documents and conversations, the student on
conversations; they differ in corpus and smoothing. The sparse models share the teacher's back-off.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PINS, TOKENIZE_MAX_LENGTH, Pins
from ..functions.arrays import generation_budget
from ..operators import batching as B
from ..operators import divergence as AD
from ..operators import metrics as MT
from ..operators import prefix_models as PM
from ..operators import sparse_lm as SL
from ..operators import train as TR
from ..operators.filters import limit_batches
from ..operators.prompts import build_examples
from ..operators.tokenize import Vocabulary, tokenize
from ..session import shared_path
from ..sources import payloads as PA
from ..sources import store as ST
from ..sources.instructions import read_instructions
from ..sources.tables import table
from . import stages as PL
from .queries import csv, r6, r9

#: The large vocabulary, and the small one under which a dense oracle can compare.
LARGE = replace(PINS, n_words=32_000)
SMALL = PINS


def corpora(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    conversations = table(spark, sf_dir, "conversations").select("text")
    return table(spark, sf_dir, "documents").select("text").unionByName(conversations), conversations


def vocabulary_table(spark: SparkSession, sf_dir: str, pins: Pins) -> DataFrame:
    return PL.materialized(spark, "whole_vocabulary", sf_dir, pins, lambda: SL.vocabulary_table(corpora(spark, sf_dir)[0], pins.n_words))


def sparse_models(spark: SparkSession, sf_dir: str, pins: Pins) -> tuple[SL.SparseLM, SL.SparseLM]:
    vocab = vocabulary_table(spark, sf_dir, pins)
    teacher, student = (
        PL.materialized(spark, f"whole_pairs_{name}", sf_dir, pins, lambda texts=texts: SL.pair_counts(texts, vocab, pins.n_words))
        for name, texts in zip(("teacher", "student"), corpora(spark, sf_dir), strict=True)
    )
    u = PL.materialized(spark, "whole_unigram", sf_dir, pins, lambda: SL.unigram(teacher, pins.vocab_size, pins.unigram_k))
    return SL.fit(teacher, u, pins.vocab_size, pins.teacher_alpha), SL.fit(student, u, pins.vocab_size, pins.student_alpha)


def sparse_divergence(spark: SparkSession, sf_dir: str, pins: Pins) -> DataFrame:
    return PL.materialized(spark, "whole_divergence", sf_dir, pins, lambda: SL.context_divergence(*sparse_models(spark, sf_dir, pins)))


def word_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1, P4, F2 and B2-B4 over whole words, before any vocabulary numbers them."""

    def examples() -> DataFrame:
        ins = B.split_train_test(PL.instructions(spark, sf_dir), "id", seed=PINS.seed)
        ex = build_examples(ins, PINS.template, keep=("split",)).select("id", "split", SL.split_words("example").alias("words"))
        return ex.where(F.least(F.size("words"), F.lit(TOKENIZE_MAX_LENGTH)) < PINS.model_max_length)

    rows = PL.materialized(spark, "word_examples", sf_dir, PINS, examples)
    return PL.materialized(spark, "word_batches", sf_dir, PINS, lambda: PL.shard_and_batch(rows, PINS))


def word_positions(batches: DataFrame, vocab: DataFrame, pins: Pins, keep: list[str]) -> DataFrame:
    """P10: a row per word with a next one, its id as ``ctx``."""
    n = F.size("words") - 1
    rows = batches.where(F.size("words") > 1).select(*keep, F.explode(F.slice("words", 1, n)).alias("w"))
    return SL.number_words(rows, vocab, pins.n_words, {"w": "ctx"})


def train_positions(spark: SparkSession, sf_dir: str, pins: Pins) -> DataFrame:
    """Positions of every optimizer step of all epochs."""
    b = word_batches(spark, sf_dir).where("split = 'train'")
    n = b.where(~F.col("is_pad")).count()
    steps = B.epochs(b, pins.epochs, B.batches_per_epoch(n, pins.world_size, pins.batch_size))
    return word_positions(steps, vocabulary_table(spark, sf_dir, pins), pins, ["step", "rank"])


def backoff_models(spark: SparkSession, sf_dir: str, pins: Pins = PINS) -> tuple[Callable, Callable]:
    """Factories of the teacher and the student that read two ids back; workers load their written counts."""
    out = []
    for name, texts, alpha in zip(("teacher", "student"), corpora(spark, sf_dir), (pins.teacher_alpha, pins.student_alpha), strict=True):
        seqs = PL._corpus_ids(spark, sf_dir, texts.where("text is not null"), pins)
        triples = PL.materialized(spark, f"whole_triples_{name}", sf_dir, pins, lambda seqs=seqs: PM.triple_counts(seqs, pins.vocab_size))
        path = PL.materialized_path(spark, f"whole_contexts_{name}", sf_dir, pins, lambda triples=triples: PM.context_rows(triples, pins.vocab_size))
        out.append(PM.stored(path, pins.vocab_size, alpha, alpha, pins.unigram_k))
    return out[0], out[1]


def onpolicy_batches(spark: SparkSession, sf_dir: str, scope: str, budget: str, pins: Pins = PINS) -> DataFrame:
    """M3 -> M6 -> M7 -> A6 with the prefix models, in one map over the online batches."""
    teacher, student = backoff_models(spark, sf_dir, pins)
    rows = PL.online_batches(spark, sf_dir, pins)
    return PM.onpolicy_score_mapped(rows, teacher, student, pins.seed, ("rank", "batch_no"), PL.PAD_ID, scope, budget_col=budget)


# ---- queries ----------------------------------------------------------------------


def q_sparse_lm(spark, sf):
    models = zip(("teacher", "student"), sparse_models(spark, sf, LARGE), strict=True)
    parts = [m.summary().select(F.lit(name).alias("model"), "ctx", "n_ctx", F.col("n_pairs").cast("long").alias("n_pairs"), r6("lam").alias("lam"), r6("entropy").alias("entropy")) for name, m in models]
    return parts[0].unionByName(parts[1])


def q_sparse_divergence(spark, sf):
    """Closed-form remainders at the small vocabulary, where the oracle compares all V * V entries."""
    d = sparse_divergence(spark, sf, SMALL)
    return d.select("ctx", *[r6(c).alias(c) for c in ("kl_ts", "kl_st", "jsd_ref", "gap2")])


def q_evaluate_sparse(spark, sf):
    pos = word_positions(word_batches(spark, sf), vocabulary_table(spark, sf, LARGE), LARGE, PL.BATCH_KEYS)
    means = SL.batch_means(pos, sparse_divergence(spark, sf, LARGE), LARGE.vocab_size, PL.BATCH_KEYS)
    return AD.evaluate(means, by=["split"]).select("split", "metric", r6("value").alias("value"), "n_batches")


def q_gradient_steps(spark, sf):
    """T2 of every step: the sparse rows' lengths by (step, context), unseen tokens from the null row."""
    teacher, student = sparse_models(spark, sf, SMALL)
    w = SL.step_weights(train_positions(spark, sf, SMALL), PINS.world_size)
    rows = SL.step_gradients(w, teacher, student).join(SL.bounded(teacher.back_off, SMALL.vocab_size), "tok", "left")
    seen = F.col("tok").isNotNull()
    by = rows.groupBy("step", "ctx").agg(
        F.sum(F.when(seen, F.col("g") * F.col("g"))).alias("g2"), F.sum(F.when(seen, F.abs("g"))).alias("g1"), F.sum("u").alias("mass"), F.sum(F.col("u") * F.col("u")).alias("mass2"), F.max(F.when(~seen, F.col("g"))).alias("rest")
    ).fillna(0.0)
    u2 = teacher.back_off.agg(F.sum(F.col("u") * F.col("u")).alias("u2"))
    l2 = F.sqrt(F.greatest(F.lit(0.0), F.col("g2") + F.col("rest") * F.col("rest") * (F.col("u2") - F.col("mass2"))))
    l1 = F.col("g1") + F.abs("rest") * (1 - F.col("mass"))
    return by.join(F.broadcast(u2)).select("step", "ctx", r9(l2).alias("l2"), r9(l1).alias("l1"))


def q_gradient_norms(spark, sf):
    """T2 + T3 of every step without a gradient row: loss, norm and clip factor."""
    w = SL.step_weights(train_positions(spark, sf, SMALL), PINS.world_size)
    n = SL.step_norms(w, sparse_divergence(spark, sf, SMALL), SMALL.vocab_size)
    return n.select("step", r9("loss").alias("loss"), r9("grad_norm").alias("grad_norm"), r9(TR.clip_factor(F.col("grad_norm"), 0.005)).alias("clip_factor"))


def q_sample_prefix_model(spark, sf):
    rows = PL.filtered_prompts(spark, sf).withColumn("budget", generation_budget("n_tokens", PINS.max_tokens))
    s = PM.sample_prefix_model(rows, backoff_models(spark, sf)[1], PINS.seed)
    return s.select("id", F.col("n_new").cast("long").alias("n_new"), csv("new_ids").alias("new_ids"))


def _onpolicy(scope, budget):
    def q(spark, sf):
        b = onpolicy_batches(spark, sf, scope, budget)
        return b.select("rank", "batch_no", "n_positions", *[r6(c).alias(c) for c in AD.DIVERGENCES])

    return q


q_onpolicy_score_mapped = _onpolicy("all", "budget_batch")
q_onpolicy_score_generated = _onpolicy("generated", "budget")


def q_evaluate_onpolicy(spark, sf):
    """A7 on policy: batches 0..cap of each rank, the mean of its batch means, then the mean over ranks under ``val/``."""
    b = limit_batches(onpolicy_batches(spark, sf, "all", "budget_batch"), PINS.eval_cap)
    by_rank = AD.evaluate(b, by=["rank"]).withColumn("step", F.lit(0).cast("long"))
    m = MT.rank_mean(by_rank)
    return m.select(MT.prefix_metric("val", "metric").alias("name"), r6("value").alias("value"), "n_ranks")


def q_tokenize_large(spark, sf):
    """P5 with 32,000 words fitted on whole tables: every whole document's ids, in order, as a digest."""
    rows = vocabulary_table(spark, sf, LARGE).orderBy("tok").collect()  # at most n_words
    docs = table(spark, sf, "documents").select("doc_id", "text")
    t = tokenize(docs, "text", Vocabulary(tuple(r["word"] for r in rows)), "ids", max_length=None)
    return t.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(csv("ids").cast("binary")).alias("ids_md5"))


def q_instructions_without_id(spark, sf):
    """S1 from a raw table that has no ids."""
    path = shared_path(spark, f"instructions-raw-{uuid.uuid4().hex}")
    PL.instructions(spark, sf).drop("id").write.parquet(path)
    return read_instructions(spark, path)


def q_ordered_index(spark, sf):
    """B2 in id order over many range partitions, ids repeated (each order as often as it has lines)."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    idx = B.ordered_index(lines, "l_orderkey", n_buckets=64)
    return idx.groupBy("l_orderkey").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("n"))


# ---- payloads, logs, snapshots ---------------------------------------------------


def payload_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent embeddings as the stored logits of a teacher (row k) and a student (row k + 1), eight positions an id."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("logits"))
    key = lambda k: (F.expr(f"cast(floor({k} / 8) as long)").alias("id"), F.expr(f"cast(pmod({k}, 8) as int)").alias("pos"), "logits")
    name = uuid.uuid4().hex
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sides = [
        PA.store_payload(rows, f"payload_{side}_{name}", shared_path(spark, f"payload-{side}-{name}"), buckets)
        for side, rows in (("teacher", e.select(*key("vec_id"))), ("student", e.select(*key("(vec_id - 1)"))))
    ]
    return PA.paired(*sides)


def q_scores_divergence(spark, sf):
    """S4 into A1-A6: a batch an id."""
    b = AD.batch_divergence(PA.judged(payload_pairs(spark, sf)), ["id"])
    return b.select("id", "n_positions", *[r6(c).alias(c) for c in AD.DIVERGENCES])


def q_scores_rejects(spark, sf):
    r = PA.rejects(payload_pairs(spark, sf))
    return r.select("reason", F.col("n_positions").cast("long").alias("n_positions"))


def q_metrics_log(spark, sf):
    """Every event as a metric, one commit a run (event type); each commit is tried twice and counts once."""
    root = shared_path(spark, f"metrics-log-{uuid.uuid4().hex}")
    events = table(spark, sf, "events")
    rows = MT.metrics_from_events(events).select(F.col("metric").alias("run_id"), "step", "rank", F.lit("train").alias("phase"), F.lit("value").alias("metric"), "value")
    for (run,) in rows.select("run_id").distinct().collect():
        for _ in range(2):
            ST.log_metrics(rows.where(F.col("run_id").eqNullSafe(F.lit(run))), root, run, "all")
    log = ST.read_log(spark, root)
    return log.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("step").alias("last_step"), r6(F.avg("value")).alias("mean_value"))


def q_snapshot_log(spark, sf):
    """The student's pair counts as snapshots of two steps and the final one, each committed twice; read back by the manifest."""
    root = shared_path(spark, f"snapshots-{uuid.uuid4().hex}")
    pairs = sparse_models(spark, sf, SMALL)[1].pairs
    for step in (1, 2, "final", 1, 2, "final"):
        ST.commit_snapshot(pairs, root, step)
    parts = [
        spark.read.parquet(r["path"]).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n")).select(F.lit(r["step"]).cast("long").alias("step"), F.lit(r["is_final"]).alias("is_final"), "n_rows", "n")
        for r in ST.read_commits(spark, root).collect()
    ]
    return reduce(DataFrame.unionByName, parts)


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)}
