"""Session helpers: a local session for tests/bench and the shared folder for
derived tables.

Derived tables (the nested event store built from the driver's flat tables)
are written under ``spark.checkpoint.dir``. On a cluster that setting names a
shared folder and is read from the session; only when it is unset (local
tests) do we fall back to a fresh temporary folder.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_LOCAL_CKPT: str | None = None


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  event_log_dir: str | None = None, app: str = "quarkframe") -> SparkSession:
    """Single-JVM session used by tests and the bench (UI off, AQE on)."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if event_log_dir:
        b = (b.config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", event_log_dir)
             .config("spark.eventLog.compress", "false")
             .config("spark.eventLog.rolling.enabled", "false"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a temporary one only if unset.

    The cluster's ``spark.checkpoint.dir`` comes first: it is the shared base
    folder itself, so derived tables keyed by their inputs are found again by
    later applications. (``getCheckpointDir`` adds a per-application
    subfolder.)"""
    global _LOCAL_CKPT
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = sc.getCheckpointDir()
        except Exception:  # pragma: no cover - older API
            d = None
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: "
                               "a machine-local folder would lose the other executors' part files")
        if _LOCAL_CKPT is None:
            _LOCAL_CKPT = tempfile.mkdtemp(prefix="quarkframe-ckpt-")
        d = _LOCAL_CKPT
        sc.setCheckpointDir(d)
    return d


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """SQL settings for what is run inside; as they were before afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def derived_path(spark: SparkSession, *parts: str) -> str:
    base = checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "quarkframe", *parts])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through Hadoop FS so it works for any shared store."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def delete_on_exit(spark: SparkSession, path: str) -> str:
    """Have ``path`` removed when the driver's JVM ends; returns ``path``."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def publish(spark: SparkSession, tmp: str, path: str, marker: str = "_SUCCESS") -> None:
    """Move a finished folder ``tmp`` to ``path`` (one rename). If another
    application published ``path`` first, keep theirs and drop ``tmp``."""
    jvm = spark.sparkContext._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(tmp), jvm.org.apache.hadoop.fs.Path(path)
    fs = dst.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(dst.getParent())
    if fs.exists(dst) or not fs.rename(src, dst):
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/" + marker)):
            raise RuntimeError(f"could not publish {tmp} to {path}")
        fs.delete(src, True)


def source_fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Identity of input tables: bytes, number of files and time of the last
    change of each path, by two Hadoop-FS calls a table (whatever its number
    of files); keys derived tables so that changed inputs are rebuilt."""
    import hashlib

    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    h = hashlib.sha1()
    for p in sorted(paths):
        jpath = jvm.org.apache.hadoop.fs.Path(p)
        fs = jpath.getFileSystem(conf)
        if not fs.exists(jpath):
            h.update(p.encode())
            continue
        total = fs.getContentSummary(jpath)
        changed = fs.getFileStatus(jpath).getModificationTime()
        h.update(f"{p}:{total.getLength()}:{total.getFileCount()}:{changed}".encode())
    return h.hexdigest()[:16]
