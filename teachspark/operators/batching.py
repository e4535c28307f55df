"""Split, shuffle index, shard, batch, collate, epochs.

No global window anywhere: a dense index over a data-sized table is built
from per-bucket counts (a few thousand rows, the only thing broadcast) plus a
``row_number`` inside each bucket, so the sort is spread over all buckets.
All draws are keyed md5 hashes, so a retried or re-partitioned task draws
the same values.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_SEED, IGNORE_INDEX, TEST_FRACTION
from ..functions.arrays import pad_right
from ..functions.hashing import fraction_threshold, keyed_md5

MAX_BUCKETS = 1 << 16  # bound on anything broadcast by the index builders
RADIX_DIGITS = 3       # hex digits that a pass of the exact split counts
SORTED_ROWS = 100_000  # rows that the exact split sorts at most


def split_train_test(
    df: DataFrame,
    id_col: str = "id",
    frac: float = TEST_FRACTION,
    seed: int = DEFAULT_SEED,
    exact: bool = False,
    out_col: str = "split",
) -> DataFrame:
    """B1: seeded train/test split.

    Default: stateless, row-local test on the md5 prefix (works on streams).
    ``exact=True``: exactly ``ceil(frac * n)`` rows with the lowest (hash, id)
    go to test; found by refining the hash prefix until its bucket is small
    (:func:`_boundary`), then applied as a stateless comparison, with no join
    and no global sort.
    """
    h = keyed_md5(seed, id_col)
    if not exact:
        return df.withColumn(
            out_col, F.when(F.substring(h, 1, 8) < fraction_threshold(frac), "test").otherwise("train")
        )
    work = df.withColumn("__h", h)
    prefix, need = _boundary(work.select("__h"), frac)
    if not need:
        return df.withColumn(out_col, F.lit("train"))
    last = (
        work.filter(F.col("__h").startswith(prefix))
        .select("__h", F.col(id_col).alias("__id"))
        .orderBy("__h", "__id")
        .limit(need)
        .agg(F.max(F.struct("__h", "__id")).alias("m"))
        .collect()[0]["m"]
    )
    is_test = (F.col("__h") < F.lit(last["__h"])) | (
        (F.col("__h") == F.lit(last["__h"])) & (F.col(id_col) <= F.lit(last["__id"]))
    )
    return work.withColumn(out_col, F.when(is_test, "test").otherwise("train")).drop("__h")


def _boundary(hashes: DataFrame, frac: float) -> tuple[str, int]:
    """The prefix of the hash at which ``ceil(frac * n)`` rows in hash order end, and how many of them lie under it.

    Radix selection: each pass counts the next ``RADIX_DIGITS`` hex digits under the prefix so far (at most 4,096 counts),
    until no more than ``SORTED_ROWS`` rows share the prefix, or the hash is used up: then they are one id's repeats.
    """
    prefix, need = "", None
    while True:
        under = hashes.filter(F.col("__h").startswith(prefix)) if prefix else hashes
        digits = len(prefix) + RADIX_DIGITS
        hist = under.groupBy(F.substring("__h", 1, digits).alias("b")).count().orderBy("b").collect()
        if need is None:
            need = math.ceil(frac * sum(r["count"] for r in hist))
            if not need:
                return prefix, 0
        for r in hist:
            if need <= r["count"]:
                break
            need -= r["count"]
        prefix = r["b"]
        if r["count"] <= SORTED_ROWS or len(prefix) >= 32:
            return prefix, need


def _dense_index(df: DataFrame, bucket: Column, order: list[Column], out_col: str, wide: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """idx = (rows in earlier buckets) + rank inside the bucket - 1.

    ``keys`` holds what ``bucket`` needs and no more, so that counting doesn't evaluate the rest of the rows.
    """
    work = df.withColumn("__b", bucket)
    counts = (work if keys is None else keys.withColumn("__b", bucket)).groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    # One row a bucket: its running sum is the only single-partition step, a
    # ``rows_per_bucket``-th of the rows.
    offsets = counts.select(
        "__b",
        (F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).alias("__off"),
    ).select("__b", F.coalesce("__off", F.lit(0)).alias("__off"))
    w = Window.partitionBy("__b").orderBy(*order)
    return (
        work.join(offsets if wide else F.broadcast(offsets), "__b")
        .withColumn(out_col, (F.col("__off") + F.row_number().over(w) - 1).cast("long"))
        .drop("__b", "__off")
    )


def shuffle_index(
    df: DataFrame, id_col: str = "id", seed: int = DEFAULT_SEED, out_col: str = "idx", bucket_digits: int | None = None,
    n: int | None = None, rows_per_bucket: int = 100_000,
) -> DataFrame:
    """B2: dense 0-based index in seeded random order: ``order by md5(seed:id), id``.

    Buckets are the first ``bucket_digits`` hex digits of the hash (uniform for
    unique ids), so no bucket is hot. Without ``bucket_digits`` their number
    follows the row count (about ``rows_per_bucket`` rows each, 4,096 buckets
    at least); more than ``MAX_BUCKETS`` are numbered without a broadcast.
    """
    if bucket_digits is None:
        n = df.count() if n is None else n
        bucket_digits = max(3, math.ceil(math.log(max(1, n / rows_per_bucket), 16)))
    h = keyed_md5(seed, id_col)
    work = df.withColumn("__h", h)
    keys = df.select(h.alias("__h"))
    out = _dense_index(
        work, F.substring("__h", 1, bucket_digits), [F.col("__h"), F.col(id_col)], out_col, 16**bucket_digits > MAX_BUCKETS, keys
    )
    return out.drop("__h")


def ordered_index(
    df: DataFrame, id_col: str = "id", out_col: str = "idx", n: int | None = None, rows_per_bucket: int = 200_000,
    n_buckets: int | None = None,
) -> DataFrame:
    """B2 with ``shuffle=False``: dense index in id order.

    Range partitions, split at sampled ids, keep buckets balanced even when ids
    cluster; rows of one id are told apart by a hash of the row, so a repeated
    id spreads over partitions too. The partitioned rows are written to the
    shared folder (a second sampling would split elsewhere); a running sum of
    the partitions' counts gives their offsets. Their number follows the row
    count (about ``rows_per_bucket`` rows each); a table that fits one bucket
    is sorted at once.
    """
    if n_buckets is None:
        n = df.count() if n is None else n
        n_buckets = math.ceil(n / rows_per_bucket) if n else 1
    if n_buckets <= 1:
        # One bucket of at most ``rows_per_bucket`` rows: its offset is 0, so no count job.
        w = Window.partitionBy(F.lit(0)).orderBy(F.col(id_col))
        return df.withColumn(out_col, (F.row_number().over(w) - 1).cast("long"))
    from ..session import shared_path

    spark = df.sparkSession
    hashed = [c for c, kind in df.dtypes if "map<" not in kind]
    dealt = df.withColumn("__tie", F.xxhash64(*hashed)).repartitionByRange(n_buckets, F.col(id_col), F.col("__tie"))
    path = shared_path(spark, f"ordered-index-{uuid.uuid4().hex}")
    dealt.withColumn("__rb", F.spark_partition_id()).write.parquet(path)
    work = spark.read.parquet(path)
    out = _dense_index(work, F.col("__rb"), [F.col(id_col), F.col("__tie")], out_col, n_buckets > MAX_BUCKETS, work.select("__rb"))
    return out.drop("__rb", "__tie")


def shard(
    df: DataFrame, world_size: int, idx_col: str = "idx", pad: bool = True, n: int | None = None
) -> DataFrame:
    """Round-robin ranks, ``rank = idx mod world``.

    With ``pad`` the list is topped up from its head so every rank gets the
    same count (as a distributed sampler does); otherwise the tail is dropped.
    Adds ``rank``, ``slot`` (position on the rank) and ``is_pad``.
    """
    n = df.count() if n is None else n
    if n == 0:
        base = df
    elif pad:
        total = math.ceil(n / world_size) * world_size
        pad_n = total - n
        base = df.withColumn("is_pad", F.lit(False))
        if pad_n:
            copies = math.ceil(pad_n / n)
            extra = (
                df.filter(F.col(idx_col) < pad_n)
                .withColumn("__c", F.explode(F.sequence(F.lit(1), F.lit(copies))))
                .withColumn(idx_col, F.col(idx_col) + F.col("__c") * F.lit(n))
                .filter(F.col(idx_col) < total)
                .drop("__c")
                .withColumn("is_pad", F.lit(True))
            )
            base = base.unionByName(extra)
    else:
        total = (n // world_size) * world_size
        base = df.filter(F.col(idx_col) < total).withColumn("is_pad", F.lit(False))
    if "is_pad" not in base.columns:
        base = base.withColumn("is_pad", F.lit(False))
    return base.withColumn("rank", (F.col(idx_col) % world_size).cast("int")).withColumn(
        "slot", (F.col(idx_col) / world_size).cast("long")
    )


def assign_batches(df: DataFrame, batch_size: int, slot_col: str = "slot") -> DataFrame:
    """Fixed-size batches per rank; the last short batch is kept."""
    return df.withColumn("batch_no", (F.col(slot_col) / batch_size).cast("long")).withColumn(
        "pos_in_batch", (F.col(slot_col) % batch_size).cast("int")
    )


def batches_per_epoch(n: int, world_size: int, batch_size: int, pad: bool = True) -> int:
    per_rank = math.ceil(n / world_size) if pad else n // world_size
    return math.ceil(per_rank / batch_size)


def epochs(df: DataFrame, n_epochs: int, per_epoch: int, batch_col: str = "batch_no") -> DataFrame:
    """The same order every epoch (no per-epoch reseed) with a running step number."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n_epochs - 1)))).withColumn(
        "step", (F.col("epoch") * per_epoch + F.col(batch_col)).cast("long")
    )


def collate(
    df: DataFrame,
    pad_id: int,
    keys: tuple[str, ...] = ("rank", "batch_no"),
    ids_col: str = "input_ids",
    labels_col: str | None = "labels",
) -> DataFrame:
    """B5 (row form): right-pad to the longest row of the batch; mask from padded ids.

    The window is partitioned by the batch keys, so each partition holds at
    most ``batch_size`` rows however skewed the data.
    """
    width = F.max(F.size(ids_col)).over(Window.partitionBy(*keys))
    out = df.withColumn("width", width.cast("int")).withColumn(ids_col, pad_right(ids_col, F.col("width"), pad_id))
    if labels_col:
        out = out.withColumn(labels_col, pad_right(labels_col, F.col("width"), IGNORE_INDEX))
    return out.withColumn("attention_mask", F.transform(ids_col, lambda x: x != F.lit(pad_id)))


def collate_batches(df: DataFrame, keys: tuple[str, ...] = ("rank", "batch_no"), cols: tuple[str, ...] = ()) -> DataFrame:
    """B5 (batch form): one row per batch, rows ordered by ``pos_in_batch``.

    A group is one batch, so ``collect_list`` is bounded by the batch size.
    """
    payload = F.struct(F.col("pos_in_batch"), *[F.col(c) for c in cols])
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sort_array(F.collect_list(payload)).alias("rows"),
    )
