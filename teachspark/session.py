"""Session helpers: a local builder for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session used by tests and the bench (never on a cluster)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("teachspark")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    A cluster sets it; only when it is unset and the master is local (tests)
    do we pick a scratch folder ourselves. On any other master an unset
    folder is an error: a driver's own folder is not the executors'.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share (master {master!r})")
        path = tempfile.mkdtemp(prefix="teachspark-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    try:
        spark.sparkContext.setCheckpointDir(path)
    except Exception:  # noqa: BLE001 - sessions without a SparkContext (Spark Connect)
        pass
    return path


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (for written intermediate tables)."""
    return os.path.join(ensure_checkpoint_dir(spark), *parts)


NAMESPACE_CONF = "spark.teachspark.namespace"


def derived_path(spark: SparkSession, *parts: str) -> str:
    """Where fingerprinted derived tables live: shared by all jobs of a namespace.

    The default namespace lets any job reuse a table whose fingerprint
    matches; a benchmark sets its own namespace to start cold.
    """
    ns = spark.conf.get(NAMESPACE_CONF, None) or "derived"
    return shared_path(spark, ns, *parts)


def _code_fingerprint() -> str:
    root = os.path.dirname(os.path.abspath(__file__))
    h = hashlib.sha256()
    for dirpath, _, files in sorted(os.walk(root)):
        if os.path.relpath(dirpath, root).split(os.sep)[0] == "llm":  # nothing here derives from it
            continue
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(dirpath, f), "rb") as fh:
                    h.update(f.encode() + b"\0" + fh.read())
    return h.hexdigest()[:16]


CODE_FINGERPRINT = _code_fingerprint()


def input_signature(spark: SparkSession, path: str) -> list:
    """Names, sizes and modification times of the files under an input folder, on any file system Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return [path]
    root, out = system.resolvePath(folder).toUri().getPath(), []
    files = system.listFiles(folder, True)
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toUri().getPath().removeprefix(root), f.getLen(), f.getModificationTime()))
    return sorted(out)
