"""Divergence properties and roll-ups."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from teachspark.functions import divergence as DV
from teachspark.operators import divergence as AD
from teachspark.operators.scoring import _log_softmax, position_divergences

vec = st.lists(st.floats(-20, 20, allow_nan=False, allow_infinity=False), min_size=2, max_size=12)


def _row(spark, a, b):
    df = spark.createDataFrame([(list(map(float, a)), list(map(float, b)))], "a array<double>, b array<double>")
    lp, lq = DV.log_softmax("a"), DV.log_softmax("b")
    return df.select(
        DV.kl_teacher_student(lp, lq).alias("kts"), DV.kl_student_teacher(lp, lq).alias("kst"),
        DV.jsd_reference(lp, lq).alias("jr"), DV.jsd_beta(lp, lq, 0.5).alias("jb"),
        DV.jsd_beta(lq, lp, 0.5).alias("jb_sw"), lp.alias("lp"),
    ).first()


@settings(max_examples=15, deadline=None)
@given(st.data())
def test_divergence_properties(spark, data):
    a = data.draw(vec)
    b = data.draw(st.lists(st.floats(-20, 20, allow_nan=False), min_size=len(a), max_size=len(a)))
    r = _row(spark, a, b)
    assert r["kts"] >= -1e-12 and r["kst"] >= -1e-12 and r["jr"] >= -1e-12
    assert abs(r["jb"] - r["jb_sw"]) < 1e-9 and r["jb"] <= math.log(2) + 1e-12
    ref = position_divergences(_log_softmax(np.array([a])), _log_softmax(np.array([b])))
    assert abs(r["kts"] - ref["kl_ts"][0]) < 1e-9 and abs(r["jr"] - ref["jsd_ref"][0]) < 1e-9


@settings(max_examples=10, deadline=None)
@given(vec, st.floats(-100, 100))
def test_log_softmax_shift_invariant(spark, a, c):
    r1 = _row(spark, a, a)["lp"]
    r2 = _row(spark, [x + c for x in a], a)["lp"]
    assert np.allclose(r1, r2, atol=1e-9) and abs(sum(math.exp(x) for x in r1) - 1) < 1e-9


def test_equal_and_one_hot_logits(spark):
    r = _row(spark, [0.3, -1.0, 2.0], [0.3, -1.0, 2.0])
    assert abs(r["kts"]) < 1e-12 and abs(r["kst"]) < 1e-12 and abs(r["jr"]) < 1e-12
    r = _row(spark, [50.0, -50.0, -50.0], [-50.0, 50.0, -50.0])
    assert all(math.isfinite(r[k]) for k in ("kts", "kst", "jr", "jb"))
    assert abs(r["kts"] - 100.0) < 1e-6


def test_reference_jsd_is_not_textbook(spark):
    r = _row(spark, [1.0, 0.0, -1.0], [0.0, 0.5, 2.0])
    assert abs(r["jr"] - r["jb"]) > 1e-4


def test_mean_of_means_vs_weighted(spark):
    # batch 0 has 1 position with divergence 1.0, batch 1 has 9 with 0.0
    rows = [(0, 1.0)] + [(1, 0.0)] * 9
    pos = spark.createDataFrame(rows, "batch_no int, kl_ts double").withColumn("kl_st", F.col("kl_ts")).withColumn(
        "jsd_ref", F.col("kl_ts"))
    b = AD.batch_divergence(pos, ["batch_no"])
    mm = {r["metric"]: r["value"] for r in AD.evaluate(b).collect()}
    wm = {r["metric"]: r["value"] for r in AD.evaluate(b, weighted=True).collect()}
    assert abs(mm["reverse_kl"] - 0.5) < 1e-12 and abs(wm["weighted_reverse_kl"] - 0.1) < 1e-12


def test_preaggregated_equals_direct(spark):
    pos = spark.createDataFrame([(0, 5), (0, 5), (0, 6), (1, 6)], "batch_no int, ctx int")
    cd = spark.createDataFrame([(5, 0.2, 0.3, 0.1), (6, 0.4, 0.1, 0.05)], "ctx int, kl_ts double, kl_st double, jsd_ref double")
    pre = {r["batch_no"]: r["kl_ts"] for r in AD.batch_divergence_by_context(pos, cd, ["batch_no"]).collect()}
    direct = {r["batch_no"]: r["kl_ts"] for r in AD.batch_divergence(pos.join(cd, "ctx"), ["batch_no"]).collect()}
    assert all(abs(pre[k] - direct[k]) < 1e-12 for k in direct)
