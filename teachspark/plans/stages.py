"""End-to-end data plans over the driver's tables, with the fixture pins.

Every function takes ``(spark, sf_dir)`` and returns a lazy DataFrame; the
few scalars they need (vocabulary words, per-split counts) come from small
bounded jobs.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EOS_ID, PINS, Pins
from ..functions.arrays import mask_source, token_count
from ..operators import batching as B
from ..operators.filters import filter_example_length
from ..operators.prompts import build_examples, build_prompts
from ..operators.tokenize import Vocabulary, fit_vocabulary, tokenize
from ..sources.instructions import instructions_from_conversations, split_rejects
from ..sources.tables import table

PAD_ID = EOS_ID  # the reference sets pad = eos


def materialized_path(spark: SparkSession, name: str, sf_dir: str, pins: Pins, build) -> str:
    """Path of a derived table written once per fingerprint in the shared folder.

    The fingerprint covers the table name, the input folder (file names,
    sizes, times), the parameters and the package code, so a change to any
    of them rebuilds. Later queries read the table back instead of
    recomputing; the write also cuts lineage, so a lost executor re-reads a
    file instead of replaying the whole derivation.
    """
    from ..session import CODE_FINGERPRINT, derived_path, input_signature
    from ..sources.store import fingerprint, prepared_path

    params = {
        "name": name, "sf": sf_dir, "inputs": input_signature(spark, sf_dir), "pins": repr(pins), "code": CODE_FINGERPRINT,
    }
    path = derived_path(spark, f"{name}-{fingerprint(params)[:16]}")
    return prepared_path(spark, path, build, params, split_col=None)


def materialized(spark: SparkSession, name: str, sf_dir: str, pins: Pins, build) -> DataFrame:
    return spark.read.parquet(materialized_path(spark, name, sf_dir, pins, build))


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 adapter: instruction rows from ``conversations`` that can form an example (the others: :func:`rejects`)."""
    return split_rejects(instructions_from_conversations(table(spark, sf_dir, "conversations")))[0]


def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction rows without an instruction or an output."""
    return split_rejects(instructions_from_conversations(table(spark, sf_dir, "conversations")))[1]


@lru_cache(maxsize=16)
def _vocab(spark: SparkSession, sf_dir: str, n_words: int, signature: str) -> Vocabulary:
    """Kept per state of the input files (``signature``), so rewritten input is fitted anew."""
    return fit_vocabulary(table(spark, sf_dir, "conversations"), "text", n_words)


def vocabulary(spark: SparkSession, sf_dir: str, pins: Pins = PINS) -> Vocabulary:
    """Top-``n_words`` vocabulary fitted on every conversation text."""
    from ..session import input_signature

    return _vocab(spark, sf_dir, pins.n_words, repr(input_signature(spark, sf_dir)))


def prompts(spark: SparkSession, sf_dir: str, pins: Pins = PINS) -> DataFrame:
    """P3 + P5: ``(id, text, input_ids, n_tokens)``; ids untruncated (F1 counts them whole)."""
    vocab = vocabulary(spark, sf_dir, pins)
    p = build_prompts(instructions(spark, sf_dir), pins.template)
    return tokenize(p, "text", vocab, "input_ids", max_length=None, add_bos=pins.add_bos, count_col="n_tokens")


def filtered_prompts(spark: SparkSession, sf_dir: str, pins: Pins = PINS) -> DataFrame:
    """F1 applied to :func:`prompts`."""
    return prompts(spark, sf_dir, pins).filter(F.col("n_tokens") < pins.prompt_limit)


def examples(spark: SparkSession, sf_dir: str, pins: Pins = PINS) -> DataFrame:
    """Offline examples: B1 split (before filtering) -> P4 -> P5 (both texts) -> F2 -> P6/P7.

    Test rows get source labels masked, train rows keep them (train_on_inputs).
    Written once per fingerprint: the index builders below pass over it
    several times, and tokenising is the expensive part.
    """
    return materialized(spark, "examples", sf_dir, pins, lambda: _examples(spark, sf_dir, pins))


def _examples(spark: SparkSession, sf_dir: str, pins: Pins) -> DataFrame:
    vocab = vocabulary(spark, sf_dir, pins)
    ins = B.split_train_test(instructions(spark, sf_dir), "id", seed=pins.seed)
    ex = build_examples(ins, pins.template, keep=("split",))
    ex = tokenize(ex, "source", vocab, "source_ids", add_bos=pins.add_bos)
    ex = tokenize(ex, "example", vocab, "input_ids", add_bos=pins.add_bos)
    ex = ex.withColumn("n_tokens", F.size("input_ids"))
    ex = filter_example_length(ex, pins.model_max_length)
    ex = ex.withColumn("source_len", token_count("source_ids", PAD_ID))
    labels = F.when(F.col("split") == "test", mask_source("input_ids", "source_len")).otherwise(F.col("input_ids"))
    return ex.select("id", "split", "input_ids", labels.alias("labels"), "n_tokens", "source_len")


def split_counts(df: DataFrame, split_col: str = "split") -> dict[str, int]:
    """Rows per split (one small aggregate; a handful of rows reach the driver)."""
    return {r[split_col]: r["count"] for r in df.groupBy(split_col).count().collect()}


def shard_and_batch(df: DataFrame, pins: Pins = PINS, shuffle_splits: tuple[str, ...] = ("train",)) -> DataFrame:
    """B2-B4 per split: seeded shuffle for train, id order for the rest, then shard and batch."""
    counts = split_counts(df)
    parts = []
    for split, n in sorted(counts.items()):
        part = df.filter(F.col("split") == split)
        if split in shuffle_splits:
            part = B.shuffle_index(part, "id", pins.seed)
        else:
            part = B.ordered_index(part, "id", n=n)
        part = B.shard(part, pins.world_size, n=n)
        parts.append(B.assign_batches(part, pins.batch_size))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def batched_examples(spark: SparkSession, sf_dir: str, pins: Pins = PINS) -> DataFrame:
    """B2-B4 over the offline examples, materialised once per fingerprint."""
    return materialized(spark, "batched_examples", sf_dir, pins, lambda: shard_and_batch(examples(spark, sf_dir, pins), pins))


# ---- table models, positions, divergences -----------------------------------

from ..functions import divergence as DV  # noqa: E402
from ..operators import divergence as AD  # noqa: E402
from ..operators.positions import align_positions  # noqa: E402
from ..operators.table_lm import bigram_counts, fit_table_lm  # noqa: E402


def model_rows(pins: Pins = PINS) -> int:
    return pins.vocab_size * pins.vocab_size


def _corpus_ids(spark: SparkSession, sf_dir: str, texts: DataFrame, pins: Pins) -> DataFrame:
    vocab = vocabulary(spark, sf_dir, pins)
    return tokenize(texts, "text", vocab, "input_ids", max_length=None, add_bos=False)


def _counts(spark: SparkSession, sf_dir: str, name: str, texts: DataFrame, pins: Pins) -> DataFrame:
    """Bigram counts of whole texts, written once: the fit reads them three times, the texts are split once."""
    return materialized(spark, name, sf_dir, pins, lambda: bigram_counts(_corpus_ids(spark, sf_dir, texts, pins)))


def teacher_lm(spark: SparkSession, sf_dir: str, pins: Pins = PINS) -> DataFrame:
    """Teacher: English documents plus every conversation turn, smoothing ``teacher_alpha``."""
    return materialized(spark, "teacher_lm", sf_dir, pins, lambda: _teacher_lm(spark, sf_dir, pins))


def student_lm(spark: SparkSession, sf_dir: str, pins: Pins = PINS) -> DataFrame:
    """Student: conversation turns of even ``conv_id``, smoothing ``student_alpha``."""
    return materialized(spark, "student_lm", sf_dir, pins, lambda: _student_lm(spark, sf_dir, pins))


def _teacher_lm(spark: SparkSession, sf_dir: str, pins: Pins) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(F.col("lang") == "en").select("text")
    conv = table(spark, sf_dir, "conversations").select("text")
    counts = _counts(spark, sf_dir, "teacher_counts", docs.unionByName(conv), pins)
    return fit_table_lm(spark, counts, pins.vocab_size, pins.teacher_alpha, pins.unigram_k)


def _student_lm(spark: SparkSession, sf_dir: str, pins: Pins) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").filter(F.col("conv_id") % 2 == 0).select("text")
    counts = _counts(spark, sf_dir, "student_counts", conv, pins)
    return fit_table_lm(spark, counts, pins.vocab_size, pins.student_alpha, pins.unigram_k)


def context_divergence(spark: SparkSession, sf_dir: str, pins: Pins = PINS) -> DataFrame:
    return AD.context_divergence(teacher_lm(spark, sf_dir, pins), student_lm(spark, sf_dir, pins), pins.jsd_beta)


BATCH_KEYS = ["split", "rank", "batch_no"]


def offline_positions(spark: SparkSession, sf_dir: str, pins: Pins = PINS) -> DataFrame:
    """P10 over the batched offline examples: ``id, split, rank, batch_no, pos, ctx, next_tok``."""
    return align_positions(batched_examples(spark, sf_dir, pins), PAD_ID, keep=("id", *BATCH_KEYS))


def offline_batch_divergence(spark: SparkSession, sf_dir: str, pins: Pins = PINS) -> DataFrame:
    """A6 for the offline path with table models, pre-aggregated on the context."""
    return AD.batch_divergence_by_context(
        offline_positions(spark, sf_dir, pins), context_divergence(spark, sf_dir, pins), BATCH_KEYS
    )


def embedding_log_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 over ``embeddings`` used as stand-in logits: ``(vec_id, lp array<double>)``."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.select("vec_id", DV.log_softmax("embedding").alias("lp"))


def embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row k is the teacher, row k+1 the student: ``(pair_id, lp, lq)`` by an equi-join on the id."""
    ls = embedding_log_probs(spark, sf_dir)
    t = ls.select(F.col("vec_id").alias("pair_id"), F.col("lp"))
    s = ls.select((F.col("vec_id") - 1).alias("pair_id"), F.col("lp").alias("lq"))
    return t.join(s, "pair_id")


# ---- on-policy (online) path ----------------------------------------------------

from ..functions.arrays import attention_mask, generation_budget, onpolicy_mask  # noqa: E402
from ..operators import onpolicy as OP  # noqa: E402


def online_batches(spark: SparkSession, sf_dir: str, pins: Pins = PINS) -> DataFrame:
    """F1 prompts in id order (an unshuffled loader), sharded and batched, with budgets.

    ``budget`` is the row-scope budget; ``budget_batch`` uses the longest prompt
    of the batch, as padded batches do. Materialised once per fingerprint.
    """
    return materialized(spark, "online_batches", sf_dir, pins, lambda: _online_batches(spark, sf_dir, pins))


def _online_batches(spark: SparkSession, sf_dir: str, pins: Pins) -> DataFrame:
    p = materialized(
        spark, "online_prompts", sf_dir, pins,
        lambda: filtered_prompts(spark, sf_dir, pins).select("id", "input_ids", "n_tokens"),
    )
    n = p.count()
    b = B.assign_batches(B.shard(B.ordered_index(p, "id", n=n), pins.world_size, n=n), pins.batch_size)
    from pyspark.sql import Window

    width = F.max("n_tokens").over(Window.partitionBy("rank", "batch_no"))
    return b.withColumn("budget", generation_budget("n_tokens", pins.max_tokens)).withColumn(
        "budget_batch", generation_budget(width, pins.max_tokens)
    )


def student_cdf_path(spark: SparkSession, sf_dir: str, pins: Pins = PINS) -> str:
    """The student's CDF table in the shared folder; sampler workers load it once each."""
    return materialized_path(
        spark, "student_cdf", sf_dir, pins, lambda: OP.student_cdf(student_lm(spark, sf_dir, pins), pins.vocab_size)
    )


def teacher_lm_path(spark: SparkSession, sf_dir: str, pins: Pins = PINS) -> str:
    return materialized_path(spark, "teacher_lm", sf_dir, pins, lambda: _teacher_lm(spark, sf_dir, pins))


def student_lm_path(spark: SparkSession, sf_dir: str, pins: Pins = PINS) -> str:
    return materialized_path(spark, "student_lm", sf_dir, pins, lambda: _student_lm(spark, sf_dir, pins))


def train_epochs(spark: SparkSession, sf_dir: str, pins: Pins = PINS) -> DataFrame:
    """B6 over the shuffled, sharded, batched train split (rows, not positions)."""
    b = batched_examples(spark, sf_dir, pins).filter(F.col("split") == "train")
    n = b.filter(~F.col("is_pad")).count()
    return B.epochs(b, pins.epochs, B.batches_per_epoch(n, pins.world_size, pins.batch_size)).withColumn(
        "epoch", F.col("epoch").cast("int")
    )


def sampled(spark: SparkSession, sf_dir: str, pins: Pins = PINS, stop_at_eos: bool = True, batched: bool = True) -> DataFrame:
    """M3 over the online prompts: ``id, [rank, batch_no, is_pad,] input_ids, new_ids, n_new, finished``."""
    if batched:
        src = online_batches(spark, sf_dir, pins)
        keep = ("rank", "batch_no", "is_pad", "input_ids")
    else:
        src = filtered_prompts(spark, sf_dir, pins).withColumn("budget", generation_budget("n_tokens", pins.max_tokens))
        keep = ("input_ids",)
    path = student_cdf_path(spark, sf_dir, pins)
    V = pins.vocab_size
    return OP.sample_continuations(
        src, lambda: OP.CdfSampler(path, V), pins.seed, keep=keep, stop_at_eos=stop_at_eos
    )


def onpolicy_sequences(spark: SparkSession, sf_dir: str, pins: Pins = PINS) -> DataFrame:
    """Prompt + sampled ids with the M6 mask (ragged prompts: the prompt mask is all true)."""
    s = sampled(spark, sf_dir, pins)
    full = F.concat("input_ids", "new_ids")
    return s.withColumn("full_ids", full).withColumn(
        "mask", onpolicy_mask(attention_mask("input_ids", PAD_ID), "n_new", "full_ids")
    )


def onpolicy_batch_divergence(spark: SparkSession, sf_dir: str, pins: Pins = PINS) -> DataFrame:
    """M7 + A6: teacher and student judge the sampled text, pre-aggregated on the context."""
    seqs = onpolicy_sequences(spark, sf_dir, pins)
    pos = align_positions(seqs, PAD_ID, ids_col="full_ids", mask_col="mask", keep=("id", "rank", "batch_no"))
    return AD.batch_divergence_by_context(pos, context_divergence(spark, sf_dir, pins), ["rank", "batch_no"])
