"""Sparse models against dense grids in numpy."""

import math

import numpy as np
import pytest

from teachspark.operators import sparse_lm as SL

TEXTS = ["the cat sat on the mat", "the dog sat", "a cat and a dog and a cow", None, "", "cat cat cat"]


@pytest.fixture(scope="module")
def models(spark):
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    vocab = SL.vocabulary_table(texts, 6)
    pairs = SL.pair_counts(texts, vocab, 6)
    some = SL.pair_counts(texts.where("text like 'the%' or text is null"), vocab, 6)
    u = SL.unigram(pairs, 9)
    return SL.fit(pairs, u, 9, 2.0), SL.fit(some, u, 9, 5.0), vocab


def dense(model):
    V, counts = model.vocab_size, np.zeros((model.vocab_size + 1, model.vocab_size))
    for r in model.pairs.collect():
        counts[r["ctx"], r["tok"] - 1] += r["n"]
    u = np.array([r["u"] for r in model.back_off.orderBy("tok").collect()])
    assert math.isclose(u.sum(), 1) and len(u) == V
    return (counts + model.alpha * u) / (counts.sum(1, keepdims=True) + model.alpha), u


def test_vocabulary_is_ranked_by_count_then_word(models):
    words = [r["word"] for r in models[2].orderBy("tok").collect()]
    assert words == ["cat", "a", "the", "and", "dog", "sat"] and models[2].agg({"tok": "min"}).first()[0] == 4


def test_counts_hold_marks_and_unknown_words(models):
    pairs = {(r["ctx"], r["tok"]): r["n"] for r in models[0].pairs.collect()}
    assert pairs[1, 2] == 1  # the empty text; the null one counts nothing
    assert pairs[4, 4] == 2 and pairs[6, 3] == 1 and sum(n for (c, _), n in pairs.items() if c == 1) == 5


def test_divergence_and_entropy_equal_the_dense_grid(models):
    teacher, student, _ = models
    (P, _), (S, _) = dense(teacher), dense(student)
    M = (P + S) / 2
    for r in SL.context_divergence(teacher, student).collect():
        p, s, m = P[r["ctx"]], S[r["ctx"]], M[r["ctx"]]
        assert math.isclose(r["kl_ts"], (p * np.log(p / s)).sum(), abs_tol=1e-12)
        assert math.isclose(r["kl_st"], (s * np.log(s / p)).sum(), abs_tol=1e-12)
        assert math.isclose(r["jsd_ref"], (0.5 * m * np.log(m / p) + 0.25 * m * np.log(m / s)).sum(), abs_tol=1e-12)
        assert math.isclose(r["gap2"], ((s - p) ** 2).sum(), abs_tol=1e-12)
    for r in teacher.summary().collect():
        assert math.isclose(r["entropy"], -(P[r["ctx"]] * np.log(P[r["ctx"]])).sum(), abs_tol=1e-12)


def test_scores_of_pairs_seen_and_unseen(spark, models):
    P, _ = dense(models[0])
    rows = spark.createDataFrame([(c, t) for c in range(1, 10) for t in range(1, 10)], "ctx int, tok int")
    got = models[0].scored(rows).collect()
    assert len(got) == 81 and all(math.isclose(r["logp"], math.log(P[r["ctx"], r["tok"] - 1]), abs_tol=1e-12) for r in got)


def test_gradients_of_every_step(spark, models):
    teacher, student, _ = models
    positions = [(0, 0, 4), (0, 0, 4), (0, 0, 5), (0, 1, 6), (1, 0, 9), (1, 1, 1), (1, 1, 8)]
    w = SL.step_weights(spark.createDataFrame(positions, "step int, rank int, ctx int"), 2)
    weights = {(r["step"], r["ctx"]): r["w"] for r in w.collect()}
    assert math.isclose(weights[0, 4], 1 / 3) and math.isclose(sum(weights.values()), 2)
    (P, u), (S, _) = dense(teacher), dense(student)
    full = {k: np.zeros(9) for k in weights}
    seen = {k: np.zeros(9, bool) for k in weights}
    rest = {}
    for r in SL.step_gradients(w, teacher, student).collect():
        k = r["step"], r["ctx"]
        if r["tok"] is None:
            rest[k] = r["g"]
        else:
            assert not seen[k][r["tok"] - 1]
            full[k][r["tok"] - 1], seen[k][r["tok"] - 1] = r["g"], True
    assert set(rest) == set(weights)
    norms = {r["step"]: r for r in SL.step_norms(w, SL.context_divergence(teacher, student), 9).collect()}
    for k, g in full.items():
        g = np.where(seen[k], g, rest[k] * u)
        assert np.allclose(g, weights[k] * (S[k[1]] - P[k[1]]), atol=1e-12)
        full[k] = g
    for step in (0, 1):
        want = math.sqrt(sum((g**2).sum() for k, g in full.items() if k[0] == step))
        assert math.isclose(norms[step]["grad_norm"], want, abs_tol=1e-12)


def test_batch_means_keep_unseen_contexts(spark, models):
    positions = spark.createDataFrame([(0, 4), (0, 4), (0, 3), (1, 777)], "batch_no int, ctx int")
    d = SL.context_divergence(*models[:2])
    kl = {r["ctx"]: r["kl_ts"] for r in d.collect()}
    got = {r["batch_no"]: r for r in SL.batch_means(positions, d, 9, ["batch_no"]).collect()}
    assert math.isclose(got[0]["kl_ts"], (2 * kl[4] + kl[3]) / 3) and got[1]["kl_ts"] == 0 and got[1]["n_positions"] == 1


def test_no_table_is_multiplied_out(spark, models):
    """The plan joins pairs on (ctx, tok): nothing of V * V rows, no nested loop but over one row."""
    plan = SL.context_divergence(*models[:2])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Range (1, 82" not in plan


def test_words_are_numbered_before_pairs_are_counted(spark, monkeypatch):
    """No pair of words is shuffled, and the counts are those of numbering afterwards."""
    texts = spark.createDataFrame([(t,) for t in [*TEXTS, 'say "hi" \\ to the cat', "été 12 12!", "  "]], "text string")
    vocab = SL.vocabulary_table(texts, 12)
    got = SL.pair_counts(texts, vocab, 12)
    assert "w1" not in got._jdf.queryExecution().executedPlan().toString()
    rows = sorted(map(tuple, got.collect()))
    monkeypatch.setattr(SL, "LITERAL_WORDS", 0)
    later = SL.pair_counts(texts, vocab, 12)
    assert "w1" in later._jdf.queryExecution().executedPlan().toString()
    assert rows == sorted(map(tuple, later.collect())) and got.schema.simpleString() == later.schema.simpleString()
    # Ids that don't run from the first word's on are taken as they are.
    monkeypatch.setattr(SL, "LITERAL_WORDS", 100)
    odd = vocab.withColumn("tok", (vocab["tok"] * 2).cast("int"))
    assert {r["tok"] for r in SL.pair_counts(texts, odd, 12).collect()} <= {2, 3, *range(8, 32, 2)}
