"""Publishing: concurrent writers, dead writers, retried commits; payloads that don't fit together."""

import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from teachspark.operators import train as TR
from teachspark.sources import payloads as PA
from teachspark.sources import publish as PB
from teachspark.sources import store as ST


def folders(tmp_path):
    return sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("data-"))


def test_create_once_has_one_winner(spark, tmp_path):
    path, won = f"file://{tmp_path}/p/x", []
    threads = [threading.Thread(target=lambda i=i: won.append((PB.create_once(spark, path, f"text {i}"), i))) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    winners = [i for ok, i in won if ok]
    assert len(winners) == 1 and PB.read_text(spark, path) == f"text {winners[0]}"
    assert [p.name for p in (tmp_path / "p").iterdir()] == ["x"] and PB.read_text(spark, path + "y") is None


def test_two_writers_of_one_name(spark, tmp_path):
    """Both write their data before either publishes; both then read the winner's."""
    gate, got = threading.Barrier(2), []

    def writer(i):
        def write(folder):
            spark.range(i + 3).write.parquet(folder)
            gate.wait(60)

        got.append(PB.publish(spark, str(tmp_path), "t", write, {"writer": i}))

    threads = [threading.Thread(target=writer, args=(i,)) for i in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert got[0] == got[1] and len(folders(tmp_path)) == 1
    assert spark.read.parquet(got[0].folder).count() == got[0].note["writer"] + 3


def test_a_writer_that_dies_leaves_nothing_to_read(spark, tmp_path):
    root = str(tmp_path)

    def half(folder):
        spark.range(5).write.parquet(folder)
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        PB.publish(spark, root, "t", half)
    assert PB.published(spark, root, "t") is None and len(folders(tmp_path)) == 1
    done = PB.publish_table(spark.range(7), root, "t")
    assert spark.read.parquet(done.folder).count() == 7
    assert PB.sweep(spark, root) == []  # too young
    assert len(PB.sweep(spark, root, older_than_s=-60)) == 1 and folders(tmp_path) == [done.folder.rsplit("/", 1)[1]]


def test_prepared_data_of_each_parameters(spark, tmp_path):
    path = str(tmp_path)
    rows = lambda n: lambda: spark.range(n).withColumn("split", F.lit("train"))
    for n in (3, 4, 3):
        assert ST.prepared_or_build(spark, path, rows(n), {"n": n}).count() == n
    assert ST.read_prepared(spark, path, params={"n": 3}).count() == 3 and ST.read_prepared(spark, path, "train").count() == 4
    with pytest.raises(FileNotFoundError):
        ST.read_prepared(spark, path, params={"n": 5})


def test_metrics_count_once_however_often_they_are_logged(spark, tmp_path):
    root, schema = str(tmp_path), "run_id string, step long, rank int, phase string, metric string, value double"
    assert ST.read_log(spark, root).count() == 0
    row = lambda step, v: spark.createDataFrame([("r", step, 0, "train", "rkl", v)], schema)
    assert ST.log_metrics(row(1, 0.5), root, "r", 1) and not ST.log_metrics(row(1, 0.7), root, "r", 1)
    assert ST.log_metrics(row(2, 0.25), root, "r", 2) and ST.log_metrics(row(1, 9.0), root, "other", 1)
    assert sorted(r["value"] for r in ST.read_log(spark, root).collect()) == [0.25, 0.5, 9.0]
    spark.range(1).write.parquet(f"{root}/data-dead")  # an attempt that died
    assert ST.read_log(spark, root).count() == 3


def test_the_loop_logs_and_commits_its_final_parameters(spark, tmp_path):
    W = spark.createDataFrame([(1, t, 0.1 * t, 0.0, 0.0) for t in (1, 2)], "ctx int, tok int, logit double, m double, v double")
    teacher = spark.createDataFrame([(1, 1, math.log(0.3)), (1, 2, math.log(0.7))], "ctx int, tok int, logp double")
    pos = spark.createDataFrame([(s, r, 1) for s in range(3) for r in range(2)], "step int, rank int, ctx int")
    work = tmp_path / "work"
    run = lambda: TR.distill(spark, W, teacher, pos, TR.DistillConfig(steps=3, learning_rate=0.1), str(tmp_path / "snap"), work_dir=str(work), log_root=str(tmp_path / "log"), run_id="a")
    final, curve = run()
    log = ST.read_log(spark, str(tmp_path / "log"))
    assert log.count() == 9 and {r["step"] for r in log.collect()} == {0, 1, 2}
    commits = ST.read_commits(spark, str(tmp_path / "snap")).collect()
    assert [(c["run_id"], c["step"], c["is_final"]) for c in commits] == [("a", None, True)]
    assert sorted(map(tuple, spark.read.parquet(commits[0]["path"]).collect())) == sorted(map(tuple, final.collect()))
    assert not any(p.name.startswith(("grad-", "teacher", "positions")) for p in work.iterdir())


PAYLOAD = "id long, pos int, logits array<double>"


@pytest.fixture(scope="module")
def payloads(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    rows = lambda: [(i, p, rng.normal(size=5).tolist()) for i in range(30) for p in range(4)]
    teacher, student = rows(), rows()
    plain = {(i, p): (a, b) for (i, p, a), (_, _, b) in zip(teacher, student, strict=True) if i < 25}
    teacher = [r for r in teacher if r[0] != 25] + [(26, 0, [1.0] * 5), (None, 1, [1.0])]
    student = [r for r in student if r[0] != 27]
    student = [(i, p, v[:4] if i == 28 else [math.nan, *v[1:]] if i == 29 else v) for i, p, v in student]
    root = tmp_path_factory.mktemp("payloads")
    made = [PA.store_payload(spark.createDataFrame(r, PAYLOAD).repartition(3), f"test_payload_{n}", f"{root}/{n}", 8) for n, r in (("t", teacher), ("s", student))]
    yield plain, PA.paired(*made)
    for n in "ts":
        spark.sql(f"DROP TABLE test_payload_{n}")


def test_payloads_are_judged_or_counted_with_a_reason(payloads):
    plain, pairs = payloads
    assert {r["reason"]: r["n_positions"] for r in PA.rejects(pairs).collect()} == {"no_teacher": 4, "no_student": 5, "repeated": 1, "length": 4, "logits": 4}
    plain = plain | {}
    got = {(r["id"], r["pos"]): r for r in PA.judged(pairs).collect()}
    assert set(got) == set(plain) | {(26, p) for p in (1, 2, 3)}
    for k, (a, b) in plain.items():
        p, s = (np.exp(x) / np.exp(x).sum() for x in (np.array(a), np.array(b)))
        m = (p + s) / 2
        assert math.isclose(got[k]["kl_ts"], (p * np.log(p / s)).sum(), abs_tol=1e-12)
        assert math.isclose(got[k]["kl_st"], (s * np.log(s / p)).sum(), abs_tol=1e-12)
        assert math.isclose(got[k]["jsd_ref"], (0.5 * m * np.log(m / p) + 0.25 * m * np.log(m / s)).sum(), abs_tol=1e-12)


def test_payloads_join_bucket_by_bucket(payloads):
    plan = payloads[1]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
