"""Prefix models: decoding row by row in plain Python, and judging in one map."""

import math

import numpy as np
import pytest

from teachspark.operators import prefix_models as PM
from teachspark.operators.scoring import _log_softmax, position_divergences

V, EOS = 7, 2
SEQS = [[4, 5, 6, 4, 5], [5, 5, 6], [], [4], [7, 6, 5, 4, 4, 4, 7], [4, 5, 7]]


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(s,) for s in SEQS] + [(None,)], "input_ids array<int>")
    return PM.fit_backoff(df, V, 1.5, 0.5)


def plain(a, b):
    """P(. | a, b) from the sequences by the definition."""
    wrapped = [[1, *s, 2] for s in SEQS]
    u = np.ones(V)
    two, three = np.zeros(V), np.zeros(V)
    for s in wrapped:
        for i in range(len(s) - 1):
            u[s[i + 1] - 1] += 1
            if s[i] == b:
                two[s[i + 1] - 1] += 1
                if i and s[i - 1] == a:
                    three[s[i + 1] - 1] += 1
    p2 = (two + 1.5 * u / u.sum()) / (two.sum() + 1.5)
    return (three + 0.5 * p2) / (three.sum() + 0.5)


def test_model_equals_the_definition(model):
    for a in range(1, V + 1):
        for b in range(1, V + 1):
            assert np.allclose(np.exp(model.next_logits(np.array([[a, b]]))[0]), plain(a, b), atol=1e-12)
    seq = np.array([4, 5, 6, 4])
    assert np.allclose(np.exp(model.score(seq, 1, 3)), [plain(4, 5), plain(5, 6)])
    assert np.allclose(np.exp(model.score(seq, 0, 1)), [plain(1, 4)])


def one_by_one(prompt, u, stop=True):
    ids, out = list(prompt), []
    for x in u:
        p = plain(ids[-2] if len(ids) > 1 else 1, ids[-1] if ids else 1)
        high = np.round(np.cumsum(p), 12)
        high[-1] = 1
        t = int(np.argmax(high > x)) + 1
        out.append(t)
        ids.append(t)
        if stop and t == EOS:
            break
    return out


@pytest.mark.parametrize("cells", [1, 3 * V, 1 << 20])
@pytest.mark.parametrize("stop", [True, False])
def test_active_sets_and_micro_batches_change_nothing(model, cells, stop):
    rng = np.random.default_rng(0)
    prompts = [np.array(p) for p in ([4], [4, 5], [7, 7, 7], [5], [6, 4], [])]
    uniforms = [rng.random(n) for n in (9, 0, 30, 1, 17, 4)]
    got = PM.decode(model, prompts, uniforms, EOS, stop, cells)
    assert [g.tolist() for g in got] == [one_by_one(p, u, stop) for p, u in zip(prompts, uniforms, strict=True)]


def test_sampling_does_not_hang_on_partitions(spark, model):
    rows = [(i, SEQS[i % 6], [3, 0, 12, 40][i % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, input_ids array<int>, budget int")
    run = lambda n: sorted((r["id"], tuple(r["new_ids"]), r["n_new"], r["finished"]) for r in PM.sample_prefix_model(df.repartition(n), PM.shared(spark, model), 7).collect())
    got = run(1)
    assert got == run(6) and len(got) == 40
    for (i, new, n, finished), (_, _, budget) in zip(got, rows, strict=True):
        assert n == len(new) <= budget and finished == (EOS in new) and (EOS not in new[:-1])


def test_rows_of_one_file_are_dealt_to_many_tasks(spark, model):
    df = spark.createDataFrame([(i, i % 2, SEQS[i % 6], 3) for i in range(64)], "id long, rank int, input_ids array<int>, budget int").coalesce(1)
    parts = PM.sample_prefix_model(df, PM.shared(spark, model), 7, keep=("rank",)).rdd.glom().map(len).collect()
    assert sum(parts) == 64 and max(parts) < 64 / 2


def test_judged_positions():
    full = np.array([4, 2, 5, 6, 0, 2])
    assert PM.judged_positions(full[:3], full, 2).tolist() == [1, 2, 4]  # a padding id in the prompt and a filler are not judged
    assert PM.judged_positions(full[:3], full, 2, "generated").tolist() == [2, 4]
    with pytest.raises(ValueError):
        PM.judged_positions(full[:3], full, 2, "none")


@pytest.mark.parametrize("scope", ["all", "generated"])
def test_fused_judging_equals_separate_steps(spark, model, scope):
    flat = PM.BackoffModel(model.u, model.pairs, model.triples, 20.0, 3.0)
    rows = [(i, i % 2, i // 4, SEQS[i % 6], [3, 0, 12, 40][i % 4]) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, rank int, batch_no int, input_ids array<int>, budget int")
    sampled = {r["id"]: r["new_ids"] for r in PM.sample_prefix_model(df, PM.shared(spark, flat), 7).collect()}
    want = {}
    for i, rank, batch, prompt, _ in rows:
        full = np.array([*prompt, *sampled[i]], np.int64)
        for t in PM.judged_positions(np.array(prompt, np.int64), full, 2, scope):
            d = position_divergences(*(_log_softmax(m.score(full, t, t + 1)) for m in (model, flat)))
            want.setdefault((rank, batch), []).append([d[c][0] for c in PM.SUMS])
    for cells in (V, 1 << 20):
        got = PM.onpolicy_score_mapped(df.repartition(3), PM.shared(spark, model), PM.shared(spark, flat), 7, ("rank", "batch_no"), 2, scope, cells=cells).collect()
        assert {(r["rank"], r["batch_no"]): r["n_positions"] for r in got} == {k: len(v) for k, v in want.items()}
        for r in got:
            assert np.allclose([r[c] for c in PM.SUMS], np.mean(want[r["rank"], r["batch_no"]], 0), atol=1e-10)


def test_a_model_too_large_to_broadcast_is_refused(spark, monkeypatch):
    monkeypatch.setattr(PM, "MODEL_ROWS", 3)
    with pytest.raises(ValueError, match="plug in"):
        PM.fit_backoff(spark.createDataFrame([(s,) for s in SEQS], "input_ids array<int>"), V, 1.0, 1.0)


def test_workers_load_the_written_counts(spark, model, tmp_path):
    df = spark.createDataFrame([(s,) for s in SEQS] + [(None,)], "input_ids array<int>")
    PM.triple_counts(df, V).write.parquet(f"{tmp_path}/triples")
    PM.context_rows(spark.read.parquet(f"{tmp_path}/triples"), V).repartition(5).write.parquet(f"{tmp_path}/contexts")
    stored = PM.stored(f"file://{tmp_path}/contexts", V, 1.5, 0.5)
    contexts = np.array([[a, b] for a in range(V + 1) for b in range(1, V + 1)])
    assert (stored().next_logits(contexts) == model.next_logits(contexts)).all() and (stored().u == model.u).all()
    rows = [(i, SEQS[i % 6], [3, 0, 12, 40][i % 4]) for i in range(40)]
    prompts = spark.createDataFrame(rows, "id long, input_ids array<int>, budget int")
    run = lambda m: sorted((r["id"], tuple(r["new_ids"])) for r in PM.sample_prefix_model(prompts, m, 7).collect())
    assert run(stored) == run(PM.shared(spark, model))
    PM.context_rows(PM.triple_counts(df.limit(0), V), V).write.parquet(f"{tmp_path}/none")
    assert np.allclose(np.exp(PM.load_backoff(f"{tmp_path}/none", V, 1.5, 0.5).next_logits(np.array([[4, 5]]))), 1 / V)


def test_models_of_whole_tables_never_reach_the_driver(spark, monkeypatch):
    from pyspark import SparkContext
    from pyspark.sql import DataFrame

    from teachspark.plans import whole

    def refused(*_):
        raise AssertionError("counts on the driver")

    monkeypatch.setattr(DataFrame, "toPandas", refused)
    monkeypatch.setattr(SparkContext, "broadcast", refused)
    for model in whole.backoff_models(spark, "/root/testdata/sf0.001"):
        assert np.allclose(np.exp(model().next_logits(np.array([[5, 6], [1, 4], [0, 3]]))).sum(1), 1)


def test_draws_follow_the_distribution():
    logits = np.log(np.array([[0.1, 0.2, 0.7]])).repeat(4, 0)
    assert PM.draw(logits, np.array([0.05, 0.1, 0.299, 0.999999])).tolist() == [1, 2, 2, 3]
    assert math.isclose(float(np.exp(_log_softmax(logits)).sum()), 4)
