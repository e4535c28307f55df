"""Prepared data, score payloads, metric log and snapshots on shared storage.

Only Spark readers and writers are used, so paths may be on any
Hadoop-compatible file system the cluster mounts.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .publish import pointers, publish_table, published


def fingerprint(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()


def write_prepared(df: DataFrame, path: str, split_col: str = "split") -> None:
    """S3: one directory per split, so reads of one split prune the others."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)


def read_prepared(spark: SparkSession, path: str, split: str | None = None, params: dict | None = None) -> DataFrame:
    """The prepared data of ``params``, by default what was published last; a plain table is read as it is."""
    if params is not None:
        found = published(spark, path, fingerprint(params))
        if found is None:
            raise FileNotFoundError(f"nothing is published under {path} for these parameters")
        folder = found.folder
    else:
        every = pointers(spark, path)
        folder = every[-1].folder if every else path
    df = spark.read.parquet(folder)
    return df if split is None else df.filter(F.col("split") == split)


def prepared_path(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], params: dict, split_col: str | None = "split"
) -> str:
    """The folder of the prepared data of ``params``, built and published if there is none.

    Unlike a bare directory-exists test, changed parameters get data of their own, a half-written folder
    is never seen, and of writers that build the same data at once the first to publish wins
    (see :mod:`.publish`). With ``split_col=None`` the table is written unpartitioned.
    """
    name = fingerprint(params)
    found = published(spark, path, name) or publish_table(build(), path, name, partition_by=split_col)
    return found.folder


def prepared_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], params: dict, split_col: str | None = "split"
) -> DataFrame:
    return spark.read.parquet(prepared_path(spark, path, build, params, split_col))


def read_scores(spark: SparkSession, path: str, cols: tuple[str, ...] = ("id", "pos", "logits")) -> DataFrame:
    """Score payloads computed elsewhere; only the named columns are read."""
    return spark.read.parquet(path).select(*cols)


def append_metrics(df: DataFrame, path: str) -> None:
    """Append ``(run_id, step, rank, phase, metric, value)`` rows, one folder per run."""
    df.select("run_id", "step", "rank", "phase", "metric", "value").write.mode("append").partitionBy("run_id").parquet(path)


def snapshot_path(root: str, step: int | str) -> str:
    return f"{root}/step-{step}"


def write_snapshot(W: DataFrame, root: str, step: int | str, run_id: str = "run") -> str:
    """Parameters of one step as parquet plus a manifest row (written after the data)."""
    path = snapshot_path(root, step)
    W.write.mode("overwrite").parquet(path)
    is_final = step == "final"
    spark = W.sparkSession
    row = [(run_id, None if is_final else int(step), is_final, path)]
    spark.createDataFrame(row, "run_id string, step long, is_final boolean, path string").coalesce(1).write.mode(
        "append"
    ).parquet(f"{root}/_manifest")
    return path


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/_manifest")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


METRICS = ["run_id", "step", "rank", "phase", "metric", "value"]


def log_metrics(df: DataFrame, root: str, run_id: str, step: int | str) -> bool:
    """S5, exactly once: the rows of one (run, step), written by whichever attempt publishes first.

    A retried or concurrent attempt changes nothing and gets False; rows of an attempt that died are in
    no published folder. ``step`` may be any name of a commit, for runs that log several steps at once.
    """
    name = fingerprint({"run": run_id, "step": step})
    if published(df.sparkSession, root, name):
        return False
    mine = uuid.uuid4().hex
    done = publish_table(df.select(*METRICS), root, name, note={"run_id": run_id, "step": step, "attempt": mine})
    return done.note["attempt"] == mine


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all published commits; an empty table before the first."""
    folders = [p.folder for p in pointers(spark, root)]
    schema = "run_id string, step long, rank int, phase string, metric string, value double"
    return spark.read.parquet(*folders) if folders else spark.createDataFrame([], schema)


def commit_snapshot(W: DataFrame, root: str, step: int | str, run_id: str = "run") -> str:
    """S6, exactly once: parameters of a step (or 'final'); a second attempt gets the first one's folder."""
    is_final = step == "final"
    note = {"run_id": run_id, "step": None if is_final else int(step), "is_final": is_final}
    return publish_table(W, root, f"{run_id}-step-{step}", note=note).folder


def read_commits(spark: SparkSession, root: str) -> DataFrame:
    """The manifest of published snapshots: ``run_id, step, is_final, path``."""
    rows = [(p.note["run_id"], p.note["step"], p.note["is_final"], p.folder) for p in pointers(spark, root)]
    return spark.createDataFrame(rows, "run_id string, step long, is_final boolean, path string")
