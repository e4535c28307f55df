"""S2-S6 round trips and the streaming path."""

import os

from pyspark.sql import functions as F

from teachspark.sources import store as ST
from teachspark.streaming.prepare import prepare_prompts, read_instruction_stream, run_available_now
from teachspark.operators.tokenize import Vocabulary


def test_prepared_or_build_rebuilds_on_new_params(spark, tmp_path):
    path = str(tmp_path / "prep")
    calls = []

    def build(n):
        def f():
            calls.append(n)
            return spark.range(n).withColumn("split", F.when(F.col("id") < 2, "test").otherwise("train"))
        return f

    assert ST.prepared_or_build(spark, path, build(5), {"n": 5}).count() == 5
    assert ST.prepared_or_build(spark, path, build(5), {"n": 5}).count() == 5
    assert ST.prepared_or_build(spark, path, build(7), {"n": 7}).count() == 7
    assert calls == [5, 7]
    assert ST.read_prepared(spark, path, "test").count() == 2


def test_metrics_append_and_snapshots(spark, tmp_path):
    path = str(tmp_path / "metrics")
    row = [("run1", 1, 0, "train", "rkl", 0.5)]
    schema = "run_id string, step long, rank int, phase string, metric string, value double"
    ST.append_metrics(spark.createDataFrame(row, schema), path)
    ST.append_metrics(spark.createDataFrame(row, schema), path)
    assert spark.read.parquet(path).count() == 2
    root = str(tmp_path / "snap")
    W = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0)], "ctx int, tok int, logit double, m double, v double")
    ST.write_snapshot(W, root, 10)
    ST.write_snapshot(W, root, "final")
    man = ST.read_manifest(spark, root)
    assert man.count() == 2 and man.filter("is_final").count() == 1
    assert ST.read_snapshot(spark, ST.snapshot_path(root, 10)).count() == 1
    assert os.path.isdir(ST.snapshot_path(root, "final"))


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"do thing {i}", "" if i % 2 else "more", f"out {i}") for i in range(30)]
    rows.append((99, " ".join(["w"] * 80), "", "x"))  # too long for F1
    df = spark.createDataFrame(rows, "id long, instruction string, input string, output string")
    src = str(tmp_path / "src")
    df.write.parquet(src)
    vocab = Vocabulary(("do", "thing", "out"))
    cols = ("id", "split", "n_tokens", "n_real", "input_ids", "attention_mask")
    run_available_now(
        prepare_prompts(read_instruction_stream(spark, src), vocab).select(*cols),
        str(tmp_path / "sink"), str(tmp_path / "ckpt"),
    )
    def rows(d):
        return sorted((r["id"], r["split"], r["n_tokens"], r["n_real"], tuple(r["input_ids"]), tuple(r["attention_mask"]))
                      for r in d.select(*cols).collect())

    streamed = rows(spark.read.parquet(str(tmp_path / "sink")))
    batch = rows(prepare_prompts(df, vocab))
    assert streamed == batch and len(batch) == 30
