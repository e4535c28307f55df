"""Helpers the corpus operators share: written intermediate tables, components, workers' cache."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder all executors share (``spark.checkpoint.dir``)."""
    return shared_path(spark, f"{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends at files that outlive executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut` that no later step reads."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def worker_cache(owner: object = None) -> dict:
    """A dict that lives as long as the Python worker (functions are unpickled anew for each task).

    It holds what one ``owner`` (a job's token, or any value compared by ``==``) has put there: when
    another owner asks, what the last one left is let go, so a worker's memory doesn't grow from job to job.
    """
    module = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache"))
    if module.__dict__.get("owner") != owner:
        module.__dict__.update(owner=owner, values={})
    return module.__dict__.setdefault("values", {})


#: Rows and bytes of a batch sent to a Python worker. Spark's own limits (10,000 rows, 64 MB) let a few tasks of long texts fill an executor.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to the above, unless they are lower."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        digits = "".join(c for c in spark.conf.get(key) if c.isdigit())
        if not digits or not 0 < int(digits) <= most:
            spark.conf.set(key, str(most))


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """Connected components of ``edges`` as ``(node, component)``, component being the least node reachable.

    Alternates the large-star and small-star joins until no edge changes: O(log n) rounds, each an
    aggregation by node with map-side combine and a join, so a hub's edges are never gathered. Each
    round's edges are written to the shared folder. Nodes without an edge don't appear.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    mark = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u is tied to u's least neighbour
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, name)
        # small star: u and its smaller neighbours are tied to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        new = cut(small, name)
        before, mark = mark, new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if before == mark:
            return new.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
                new.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        forget(e)
        forget(large)
        e = new
