"""Split, index, shard, batch, collate, epochs."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from teachspark.functions.hashing import keyed_md5
from teachspark.operators import batching as B
from teachspark.operators import filters as FL


def ids(spark, n, parts=4):
    return spark.range(n, numPartitions=parts).select(F.col("id"))


def test_split_disjoint_complete(spark):
    df = B.split_train_test(ids(spark, 5000), frac=0.1)
    c = dict(df.groupBy("split").count().collect())
    assert c["train"] + c["test"] == 5000 and 350 < c["test"] < 650


def test_split_exact_count_and_lowest_hashes(spark):
    df = B.split_train_test(ids(spark, 997), frac=0.05, exact=True)
    test = {r[0] for r in df.filter("split = 'test'").select("id").collect()}
    assert len(test) == 50
    h = ids(spark, 997).select("id", keyed_md5(42, "id").alias("h")).orderBy("h", "id").limit(50)
    assert test == {r[0] for r in h.collect()}


def test_shuffle_index_equals_global_row_number(spark):
    df = ids(spark, 3000, parts=7)
    got = dict(B.shuffle_index(df).select("id", "idx").collect())
    ref = df.select("id", (F.row_number().over(Window.orderBy(keyed_md5(42, "id"), "id")) - 1).alias("r"))
    assert got == dict(ref.collect())


def test_ordered_index_is_id_order(spark):
    df = spark.createDataFrame([(i * 7 + (i % 3),) for i in range(500)], "id long")
    got = B.ordered_index(df, "id", n_buckets=16).orderBy("idx").select("id").collect()
    assert [r[0] for r in got] == sorted(r[0] for r in df.collect())


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_partition_invariance(spark, parts):
    base = ids(spark, 301, parts=parts)
    out = B.assign_batches(B.shard(B.shuffle_index(base), 2), 8)
    got = sorted(tuple(r) for r in out.select("id", "rank", "batch_no", "pos_in_batch", "is_pad").collect())
    ref = ids(spark, 301, parts=1)
    ref = B.assign_batches(B.shard(B.shuffle_index(ref), 2), 8)
    assert got == sorted(tuple(r) for r in ref.select("id", "rank", "batch_no", "pos_in_batch", "is_pad").collect())


def test_shard_top_up_and_short_last_batch(spark):
    df = spark.createDataFrame([(i, i) for i in range(7)], "id long, idx long")
    out = B.assign_batches(B.shard(df, 2), 3).collect()
    per_rank = {}
    for r in out:
        per_rank.setdefault(r["rank"], []).append(r)
    assert len(per_rank[0]) == len(per_rank[1]) == 4
    pad = [r for r in out if r["is_pad"]]
    assert len(pad) == 1 and pad[0]["id"] == 0 and pad[0]["idx"] == 7 and pad[0]["rank"] == 1
    sizes = sorted((r["rank"], r["batch_no"]) for r in out)
    assert sizes.count((0, 0)) == 3 and sizes.count((0, 1)) == 1  # short last batch kept


def test_shard_more_ranks_than_rows(spark):
    df = spark.createDataFrame([(0, 0), (1, 1)], "id long, idx long")
    out = B.shard(df, 5).collect()
    assert len(out) == 5 and sorted(r["rank"] for r in out) == [0, 1, 2, 3, 4]


def test_shard_drop_last(spark):
    df = spark.createDataFrame([(i, i) for i in range(7)], "id long, idx long")
    assert B.shard(df, 2, pad=False).count() == 6


def test_collate_pads_and_masks(spark):
    df = spark.createDataFrame(
        [(0, 0, 0, [5, 6, 7], [-100, 6, 7]), (0, 0, 1, [5], [5])],
        "rank int, batch_no long, pos_in_batch int, input_ids array<int>, labels array<int>",
    )
    rows = {r["pos_in_batch"]: r for r in B.collate(df, pad_id=2).collect()}
    assert list(rows[1]["input_ids"]) == [5, 2, 2] and list(rows[1]["labels"]) == [5, -100, -100]
    assert list(rows[1]["attention_mask"]) == [True, False, False] and rows[0]["width"] == 3
    g = B.collate_batches(B.collate(df, pad_id=2), cols=("input_ids",)).first()
    assert g["n_rows"] == 2 and [list(x["input_ids"]) for x in g["rows"]] == [[5, 6, 7], [5, 2, 2]]


def test_epochs_skip_and_limits(spark):
    df = spark.createDataFrame([(b,) for b in range(3)], "batch_no long")
    e = B.epochs(df, 2, 3)
    assert sorted(r["step"] for r in e.collect()) == [0, 1, 2, 3, 4, 5]
    assert sorted(r["step"] for r in FL.skip_batches(e, 1).collect()) == [1, 2, 4, 5]
    assert sorted(r["batch_no"] for r in FL.limit_batches(df, 1).collect()) == [0, 1]  # cap+1 batches
    assert sorted(r["batch_no"] for r in FL.limit_batches(df, 1, inclusive=False).collect()) == [0]
    assert sorted(r["step"] for r in FL.limit_steps(e, 4).collect()) == [0, 1, 2, 3]


def test_exact_split_refines_the_prefix_until_few_rows_are_sorted(spark, monkeypatch):
    monkeypatch.setattr(B, "SORTED_ROWS", 1)
    monkeypatch.setattr(B, "RADIX_DIGITS", 1)
    df = ids(spark, 997)
    want = {r["id"]: r["split"] for r in B.split_train_test(df, frac=0.05, exact=True).collect()}
    assert sum(s == "test" for s in want.values()) == 50
    monkeypatch.undo()
    assert want == {r["id"]: r["split"] for r in B.split_train_test(df, frac=0.05, exact=True).collect()}
    prefix, need = B._boundary(df.select(B.keyed_md5(B.DEFAULT_SEED, "id").alias("__h")), 0.05)
    assert len(prefix) == 3 and need >= 1
    assert B.split_train_test(df.limit(0), frac=0.05, exact=True).count() == 0


def test_ordered_index_spreads_a_repeated_id(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("row"))
    out = B.ordered_index(df, "k", n_buckets=12)
    rows = out.collect()
    assert sorted(r["idx"] for r in rows) == list(range(3000)) and out.columns == ["k", "row", "idx"]
    assert [r["k"] for r in sorted(rows, key=lambda r: r["idx"])] == sorted(r["k"] for r in rows)
