"""Publishing a written table under a name, once: a folder of its own, then a pointer made by create-if-absent.

A writer writes to a folder that no one else knows and then creates the pointer file, complete at
its first instant. Of several writers one succeeds; the others delete their folders and read the
winner's. A writer that dies leaves a folder without a pointer, which no reader sees and
:func:`sweep` deletes. Readers go through pointers only, so none ever sees half a table.

The pointer is a hard link on local file systems and a rename without overwriting elsewhere, which
must be atomic there (as on HDFS); object stores need conditional writes behind their connector.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

POINTERS = "_published"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _write(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` holding ``text`` unless it exists; of any number of callers one gets True."""
    target, fs = _path(spark, path)
    fs.mkdirs(target.getParent())
    draft = f"{target.getParent().toString()}/.{uuid.uuid4().hex}"
    _write(spark, draft, text)
    try:
        source, _ = _path(spark, draft)
        if fs.getUri().getScheme() == "file":
            local = lambda q: spark._jvm.java.nio.file.Path.of(spark._jvm.java.net.URI.create(f"file://{q.toUri().getRawPath()}"))
            try:
                spark._jvm.java.nio.file.Files.createLink(local(target), local(source))
            except Exception:
                if fs.exists(target):
                    return False
                raise
            return True
        return not fs.exists(target) and bool(fs.rename(source, target))
    finally:
        delete(spark, draft)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if there is none."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


@dataclass(frozen=True)
class Pointer:
    name: str
    folder: str
    made_ms: int
    note: dict


def pointers(spark: SparkSession, root: str) -> list[Pointer]:
    """All pointers under ``root``, oldest first."""
    p, fs = _path(spark, f"{root}/{POINTERS}")
    if not fs.exists(p):
        return []
    out = []
    for f in fs.listStatus(p):
        name = f.getPath().getName()
        if not name.startswith(".") and (text := read_text(spark, f.getPath().toString())):
            held = json.loads(text)
            out.append(Pointer(name, f"{root}/{held['folder']}", held["made_ms"], held["note"]))
    return sorted(out, key=lambda x: (x.made_ms, x.name))


def published(spark: SparkSession, root: str, name: str) -> Pointer | None:
    """The pointer ``name``, if it was published."""
    text = read_text(spark, f"{root}/{POINTERS}/{name}")
    if text is None:
        return None
    held = json.loads(text)
    return Pointer(name, f"{root}/{held['folder']}", held["made_ms"], held["note"])


def publish(spark: SparkSession, root: str, name: str, write: Callable[[str], None], note: dict | None = None) -> Pointer:
    """Let ``write(folder)`` write a table and publish it as ``name``; a table published before stays and is returned."""
    if found := published(spark, root, name):
        return found
    folder = f"data-{uuid.uuid4().hex}"
    write(f"{root}/{folder}")
    text = json.dumps({"folder": folder, "made_ms": int(time.time() * 1000), "note": note or {}}, sort_keys=True)
    if not create_once(spark, f"{root}/{POINTERS}/{name}", text):
        delete(spark, f"{root}/{folder}")
    return published(spark, root, name)


def publish_table(df: DataFrame, root: str, name: str, partition_by: str | None = None, note: dict | None = None) -> Pointer:
    def write(folder: str) -> None:
        w = df.write
        (w.partitionBy(partition_by) if partition_by else w).parquet(folder)

    return publish(df.sparkSession, root, name, write, note)


def sweep(spark: SparkSession, root: str, older_than_s: float = 86_400) -> list[str]:
    """Delete folders that no pointer names and that are older than any write may take; their paths."""
    kept = {x.folder.rsplit("/", 1)[-1] for x in pointers(spark, root)}
    p, fs = _path(spark, root)
    gone = []
    for f in fs.listStatus(p) if fs.exists(p) else ():
        name = f.getPath().getName()
        if f.isDirectory() and name.startswith("data-") and name not in kept and f.getModificationTime() < (time.time() - older_than_s) * 1000:
            delete(spark, f.getPath().toString())
            gone.append(f"{root}/{name}")
    return gone
