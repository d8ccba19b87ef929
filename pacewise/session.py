"""Session defaults for local work, and the shared folder for written state."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(name: str = "pacewise", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    cpus = 8 if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's checkpoint folder.

    The folder named in ``spark.checkpoint.dir`` is visible to every executor.
    Only where it is unset, as in local tests, a temporary folder stands in.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None) or _stand_in(spark.sparkContext.applicationId, spark.sparkContext.master)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


@cache
def _stand_in(application: str, master: str) -> str:
    """A temporary folder that goes when Python ends. Executors of a cluster would not see it, so there it is refused."""
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share; the master is {master}")
    folder = tempfile.mkdtemp(prefix=f"pacewise-{application}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def reliable(df):
    """Cut the lineage of ``df`` with a checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(spark, "checkpoints"))
    return df.checkpoint(eager=True)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder this library wrote, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none where it does not exist."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file; a reader sees the old or the new content, never a part."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{target.getName()}.{uuid.uuid4().hex[:8]}")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = files.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    files.delete(target, False)
    if not files.rename(draft, target):
        raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    """The content of a small file."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = files.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
