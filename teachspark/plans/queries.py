"""Registered queries: one ``(spark, sf_dir) -> DataFrame`` per operator key.

Array outputs are rendered as comma-joined strings and doubles are rounded
to 6 places (plus 0.0 against negative zero) so that results hash the same
as the SQL oracle in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PINS
from ..functions.arrays import truncate_ids
from ..functions.text import render_chat, user_content
from ..operators import batching as B
from ..operators import filters as FL
from ..operators.tokenize import tokenize
from ..sources.tables import table
from . import stages as PL

P = PINS
Query = Callable[[SparkSession, str], DataFrame]


def csv(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.concat_ws(",", c.cast("array<string>"))


def bits(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.concat_ws("", F.transform(c, lambda x: F.when(x, "1").otherwise("0")))


def r6(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), 6) + F.lit(0.0)


# ---- sources / projections / filters --------------------------------------


def q_instructions(spark, sf):
    return PL.instructions(spark, sf).select("id", "instruction", "input", "output")


def q_user_content(spark, sf):
    return PL.instructions(spark, sf).select("id", user_content("instruction", "input").alias("content"))


def q_render_prompt(spark, sf):
    ins = PL.instructions(spark, sf)
    return ins.select("id", render_chat(user_content("instruction", "input"), P.template).alias("text"))


def q_build_prompts(spark, sf):
    return PL.prompts(spark, sf).select("id", "text", F.col("n_tokens").cast("long").alias("n_tokens"))


def q_build_examples(spark, sf):
    from ..operators.prompts import build_examples

    return build_examples(PL.instructions(spark, sf), P.template)


def q_tokenize(spark, sf):
    """P5 over every whole document: full count and id checksum, ids truncated to 2048."""
    vocab = PL.vocabulary(spark, sf)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    t = tokenize(docs, "text", vocab, "all_ids", max_length=None, add_bos=P.add_bos)
    return t.select(
        "doc_id",
        F.size("all_ids").cast("long").alias("n_tokens"),
        F.aggregate("all_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"),
        csv(F.slice("all_ids", 1, 2048)).alias("ids"),
    )


def q_tokenize_plugin(spark, sf):
    """P5 through the plug-in path: a Python tokenizer in an Arrow iterator UDF, same output."""
    from ..operators.tokenize import PluginTokenizer, tokenize_with

    vocab = PL.vocabulary(spark, sf)

    class RegexWords(PluginTokenizer):
        def encode_batch(self, texts):
            return [vocab.encode(t, P.add_bos) for t in texts]

    docs = table(spark, sf, "documents").select("doc_id", "text")
    t = tokenize_with(docs, "text", RegexWords, "all_ids", max_length=None)
    return t.select(
        "doc_id",
        F.size("all_ids").cast("long").alias("n_tokens"),
        F.aggregate("all_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"),
        csv(F.slice("all_ids", 1, 2048)).alias("ids"),
    )


def q_filter_prompt_length(spark, sf):
    f = FL.filter_prompt_length(PL.prompts(spark, sf), P.prompt_limit)
    return f.select("id", F.col("n_tokens").cast("long").alias("n_tokens"))


def q_truncate_ids(spark, sf):
    return PL.prompts(spark, sf).select("id", csv(truncate_ids("input_ids", P.truncate_len)).alias("ids"))


def q_instruction_rejects(spark, sf):
    """Rows of the adapter that can't form an example, counted by reason."""
    count = lambda c: F.count_if(F.col(c).isNull()).cast("long")
    return PL.rejects(spark, sf).agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"), count("instruction").alias("no_instruction"), count("output").alias("no_output")
    )


def q_filter_example_length(spark, sf):
    return PL.examples(spark, sf).select("id", "split", F.col("n_tokens").cast("long").alias("n_tokens"))


def q_token_count(spark, sf):
    return PL.examples(spark, sf).select("id", F.col("source_len").cast("long").alias("source_len"))


def q_mask_source(spark, sf):
    return PL.examples(spark, sf).select("id", "split", csv("labels").alias("labels"))


# ---- split / shuffle / shard / batch ----------------------------------------


def q_split_hash(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return B.split_train_test(docs, "doc_id", seed=P.seed)


def q_split_exact(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return B.split_train_test(docs, "doc_id", seed=P.seed, exact=True)


def q_shuffle_index(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return B.shuffle_index(docs, "doc_id", P.seed)


def q_shard(spark, sf):
    b = PL.batched_examples(spark, sf)
    return b.select("id", "split", "idx", "rank", "slot", "is_pad")


def q_assign_batches(spark, sf):
    b = PL.batched_examples(spark, sf)
    return b.select("id", "split", "rank", "batch_no", "pos_in_batch", "is_pad")


def _collated(spark, sf):
    return B.collate(PL.batched_examples(spark, sf), PL.PAD_ID, keys=("split", "rank", "batch_no"))


def q_collate_rows(spark, sf):
    c = _collated(spark, sf)
    return c.select(
        "id", "split", "rank", "batch_no", "pos_in_batch", "width",
        csv("input_ids").alias("input_ids"), csv("labels").alias("labels"), bits("attention_mask").alias("attention_mask"),
    )


def q_attention_mask(spark, sf):
    c = _collated(spark, sf)
    return c.select(
        "id", "split", "rank", "batch_no", "pos_in_batch", bits("attention_mask").alias("attention_mask"),
        F.size(F.filter("attention_mask", lambda x: x)).cast("long").alias("n_attended"),
    )


def q_collate_batches(spark, sf):
    c = _collated(spark, sf).withColumn("ids_csv", csv("input_ids"))
    g = B.collate_batches(c, keys=("split", "rank", "batch_no"), cols=("ids_csv", "width"))
    return g.select(
        "split", "rank", "batch_no", F.col("n_rows").cast("long").alias("n_rows"),
        F.array_max(F.transform("rows", lambda r: r["width"])).alias("width"),
        F.concat_ws(";", F.transform("rows", lambda r: r["ids_csv"])).alias("input_ids"),
    )


def _epochs(spark, sf):
    return PL.train_epochs(spark, sf)


def q_epochs(spark, sf):
    return _epochs(spark, sf).select("id", "rank", "batch_no", "pos_in_batch", "epoch", "step")


def q_skip_batches(spark, sf):
    return FL.skip_batches(_epochs(spark, sf), P.skip_batches).select("id", "rank", "batch_no", "epoch", "step")


def q_limit_eval_batches(spark, sf):
    b = FL.limit_batches(PL.batched_examples(spark, sf), P.eval_cap)
    return b.select("id", "split", "rank", "batch_no")


def q_limit_steps(spark, sf):
    return FL.limit_steps(_epochs(spark, sf), P.max_steps).select("id", "rank", "epoch", "step")


# ---- divergences on dense logits (embeddings as stand-in logits) --------------

from ..functions import divergence as DV  # noqa: E402
from ..operators import divergence as AD  # noqa: E402
from ..operators import scoring as SC  # noqa: E402


def q_log_softmax(spark, sf):
    ls = PL.embedding_log_probs(spark, sf)
    return ls.select("vec_id", F.posexplode("lp").alias("pos", "v")).select(
        "vec_id", F.col("pos").cast("int").alias("pos"), r6("v").alias("value")
    )


def _pair_metric(fn):
    def q(spark, sf):
        pr = PL.embedding_pairs(spark, sf)
        return pr.select("pair_id", r6(fn(F.col("lp"), F.col("lq"))).alias("value"))

    return q


q_kl_teacher_student = _pair_metric(DV.kl_teacher_student)
q_kl_student_teacher = _pair_metric(DV.kl_student_teacher)
q_jsd_reference = _pair_metric(DV.jsd_reference)
q_jsd_beta = _pair_metric(lambda a, b: DV.jsd_beta(a, b, P.jsd_beta))


def q_batch_divergence(spark, sf):
    """A6 on dense pairs: rank = pair mod world, batch = (pair div world) div batch."""
    pr = PL.embedding_pairs(spark, sf)
    pos = pr.select(
        (F.col("pair_id") % P.world_size).cast("int").alias("rank"),
        ((F.col("pair_id") / P.world_size).cast("long") / P.batch_size).cast("long").alias("batch_no"),
        DV.kl_teacher_student("lp", "lq").alias("kl_ts"),
        DV.kl_student_teacher("lp", "lq").alias("kl_st"),
        DV.jsd_reference("lp", "lq").alias("jsd_ref"),
    )
    b = AD.batch_divergence(pos, ["rank", "batch_no"])
    return b.select("rank", "batch_no", "n_positions", *[r6(c).alias(c) for c in AD.DIVERGENCES])


# ---- table models, positions, scoring, evaluation -----------------------------


def q_table_lm(spark, sf):
    t = PL.teacher_lm(spark, sf).withColumn("model", F.lit("teacher"))
    s = PL.student_lm(spark, sf).withColumn("model", F.lit("student"))
    return t.unionByName(s).select("model", "ctx", "tok", r6("logp").alias("logp"))


def q_align_positions(spark, sf):
    return PL.offline_positions(spark, sf)


def q_score_teacher(spark, sf):
    pos = PL.offline_positions(spark, sf)
    sc = SC.score_next(pos, PL.teacher_lm(spark, sf), PL.model_rows(), "logp")
    return sc.select("id", "split", "rank", "batch_no", "pos", r6("logp").alias("teacher_logp"))


def q_score_pair(spark, sf):
    pos = PL.offline_positions(spark, sf)
    sc = SC.score_next(pos, PL.teacher_lm(spark, sf), PL.model_rows(), "tl")
    sc = SC.score_next(sc, PL.student_lm(spark, sf), PL.model_rows(), "sl")
    cd = PL.context_divergence(spark, sf).select("ctx", *AD.DIVERGENCES)
    sc = sc.join(F.broadcast(cd), "ctx")
    return sc.select(
        "id", "split", "pos", r6("tl").alias("teacher_logp"), r6("sl").alias("student_logp"),
        *[r6(c).alias(c) for c in AD.DIVERGENCES],
    )


def q_score_pair_mapped(spark, sf):
    V = P.vocab_size
    tpath, spath = PL.teacher_lm_path(spark, sf), PL.student_lm_path(spark, sf)
    out = SC.score_pair_mapped(
        PL.batched_examples(spark, sf),
        lambda: SC.TableScorer(tpath, V),
        lambda: SC.TableScorer(spath, V),
        PL.PAD_ID,
        keep=("id", "split"),
    )
    return out.select("id", "split", "pos", *[r6(c).alias(c) for c in AD.DIVERGENCES])


def q_offline_batch_divergence(spark, sf):
    b = PL.offline_batch_divergence(spark, sf)
    return b.select(*PL.BATCH_KEYS, "n_positions", *[r6(c).alias(c) for c in AD.DIVERGENCES])


def _evaluate(weighted):
    def q(spark, sf):
        ev = AD.evaluate(PL.offline_batch_divergence(spark, sf), by=["split"], weighted=weighted)
        return ev.select("split", "metric", r6("value").alias("value"), "n_batches")

    return q


q_evaluate_mean_of_means = _evaluate(False)
q_evaluate_weighted = _evaluate(True)


# ---- on-policy ---------------------------------------------------------------------

from ..functions.arrays import truncate_after_eos  # noqa: E402


def q_generation_budget(spark, sf):
    b = PL.online_batches(spark, sf)
    return b.select("id", "rank", "batch_no", "is_pad", F.col("budget").cast("int").alias("budget"),
                    F.col("budget_batch").cast("int").alias("budget_batch"))


def q_sample_continuations(spark, sf):
    s = PL.sampled(spark, sf, batched=False)
    return s.select("id", F.col("n_new").cast("long").alias("n_new"), csv("new_ids").alias("new_ids"))


def q_truncate_after_eos(spark, sf):
    raw = PL.sampled(spark, sf, stop_at_eos=False, batched=False)
    t = raw.withColumn("new_ids", truncate_after_eos("new_ids", PL.PAD_ID))
    return t.select("id", F.size("new_ids").cast("long").alias("n_new"), csv("new_ids").alias("new_ids"))


def q_onpolicy_mask(spark, sf):
    s = PL.onpolicy_sequences(spark, sf)
    return s.select("id", "rank", "batch_no", "is_pad", F.size("full_ids").cast("long").alias("n_total"),
                    bits("mask").alias("mask"))


def q_onpolicy_divergence(spark, sf):
    b = PL.onpolicy_batch_divergence(spark, sf)
    return b.select("rank", "batch_no", "n_positions", *[r6(c).alias(c) for c in AD.DIVERGENCES])


def q_generation_stats(spark, sf):
    g = MT.generation_stats(PL.sampled(spark, sf))
    return g.withColumn("completed_share", r6("completed_share"))


# ---- metrics and snapshots ---------------------------------------------------------

from ..operators import metrics as MT  # noqa: E402
from ..operators import snapshots as SN  # noqa: E402


def _events_metrics(spark, sf):
    return MT.metrics_from_events(table(spark, sf, "events"))


def q_rank_mean(spark, sf):
    m = MT.rank_mean(_events_metrics(spark, sf))
    return m.select("step", "metric", r6("value").alias("value"), "n_ranks")


def q_prefix_metric(spark, sf):
    m = MT.rank_mean(_events_metrics(spark, sf))
    return m.select("step", MT.prefix_metric("train", "metric").alias("name"), r6("value").alias("value"))


def q_latest_snapshot(spark, sf):
    return SN.latest_snapshot(SN.manifest_from_events(table(spark, sf, "events")))


def q_expired_snapshots(spark, sf):
    return SN.expired_snapshots(SN.manifest_from_events(table(spark, sf, "events"))).select("run_id", "step", "path")


# ---- training a table student ---------------------------------------------------------

from ..operators import train as TR  # noqa: E402


def r9(col):
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), 9) + F.lit(0.0)


def _train_positions(spark, sf):
    """Judged positions of the train split with their epoch step."""
    return PL.align_positions(PL.train_epochs(spark, sf), PL.PAD_ID, keep=("rank", "batch_no", "epoch", "step"))


def _step0_gradient(spark, sf, loss):
    pos = _train_positions(spark, sf).filter(F.col("step") == 0)
    W = TR.init_student(PL.student_lm(spark, sf))
    g = TR.gradient(W, PL.teacher_lm(spark, sf), TR.context_weights(pos, P.world_size), loss)
    return W, g


def _gradient_query(loss):
    def q(spark, sf):
        _, g = _step0_gradient(spark, sf, loss)
        return g.select("ctx", "tok", r9("g").alias("grad"))

    return q


q_gradient_rkl = _gradient_query("rkl")
q_gradient_jsd = _gradient_query("jsd")


def q_clip_gradient(spark, sf):
    _, g = _step0_gradient(spark, sf, "rkl")
    n = F.sqrt(F.sum(F.col("g") * F.col("g")))
    out = g.agg(n.alias("grad_norm"), F.sum("loss_term").alias("loss"))
    factor = TR.clip_factor(F.col("grad_norm"))
    return out.select(r9("grad_norm").alias("grad_norm"), r9(factor).alias("clip_factor"), r9("loss").alias("loss"))


def q_clip_gradient_tight(spark, sf):
    """T3 at a limit that every gradient here exceeds, and the norm after scaling."""
    _, g = _step0_gradient(spark, sf, "rkl")
    limit = 0.005
    out = g.agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("grad_norm"))
    factor = TR.clip_factor(F.col("grad_norm"), limit)
    return out.select(r9("grad_norm").alias("grad_norm"), r9(factor).alias("clip_factor"), r9(F.col("grad_norm") * factor).alias("clipped_norm"))


def q_adamw_step(spark, sf):
    W, g = _step0_gradient(spark, sf, "rkl")
    W1 = TR.adamw(W, g, P.learning_rate, P.weight_decay, 1, TR.clip_factor(TR.grad_norm(g)))
    return W1.select("ctx", "tok", r9("logit").alias("logit"), r9("m").alias("m"), F.round("v", 15).alias("v"))


def q_lr_schedule(spark, sf):
    steps = PL.train_epochs(spark, sf).select("step").distinct()
    lr = TR.lr_at(F.col("step"), P.learning_rate, P.warmup_steps, "constant_with_warmup")
    return steps.select(F.col("step").cast("long").alias("step"), r9(lr).alias("lr"))


def q_distill_loss_curve(spark, sf):
    cfg = TR.DistillConfig(
        steps=P.train_steps, learning_rate=P.learning_rate, weight_decay=P.weight_decay,
        warmup_steps=P.warmup_steps, schedule="constant_with_warmup", loss="rkl", world_size=P.world_size,
    )
    W0 = TR.init_student(PL.student_lm(spark, sf))
    _, curve = TR.distill(spark, W0, PL.teacher_lm(spark, sf), _train_positions(spark, sf), cfg)
    return curve


# ---- stores and streaming ---------------------------------------------------------------


def _run_dir(spark, sf, name):
    from ..session import shared_path

    from ..session import input_signature
    from ..sources.store import fingerprint

    return shared_path(spark, name, fingerprint({"sf": sf, "pins": repr(P), "inputs": input_signature(spark, sf)})[:16])


def q_prepared_roundtrip(spark, sf):
    """S2 + S3: build the examples once per parameter fingerprint, read them back by split."""
    from ..sources.store import prepared_or_build, read_prepared

    path = _run_dir(spark, sf, "prepared")
    from ..session import input_signature

    params = {"sf": sf, "pins": repr(P), "inputs": input_signature(spark, sf)}
    prepared_or_build(spark, path, lambda: PL.examples(spark, sf), params)
    parts = [read_prepared(spark, path, s, params) for s in ("train", "test")]
    df = parts[0].unionByName(parts[1])
    return df.groupBy("split").agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"),
        F.sum("n_tokens").cast("long").alias("n_tokens"),
        F.sum("id").cast("long").alias("id_sum"),
    )


def q_stream_prepare(spark, sf):
    """P1-P5, F1, B1 as a Structured Streaming query (availableNow) over instruction rows."""
    import uuid

    from ..streaming.prepare import prepare_prompts, read_instruction_stream, run_available_now

    root = _run_dir(spark, sf, "stream") + f"/{uuid.uuid4().hex}"
    PL.instructions(spark, sf).write.mode("overwrite").parquet(f"{root}/source")
    stream = prepare_prompts(read_instruction_stream(spark, f"{root}/source"), PL.vocabulary(spark, sf), P)
    run_available_now(stream.select("id", "split", "n_tokens"), f"{root}/sink", f"{root}/checkpoint")
    out = spark.read.parquet(f"{root}/sink")
    return out.select("id", "split", F.col("n_tokens").cast("long").alias("n_tokens"))


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)
}
