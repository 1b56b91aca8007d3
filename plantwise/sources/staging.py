"""Write a derived table once into the shared folder and reuse it.

Test views rendered from the driver's tables (the messy sheet, for instance) are files in
real life. Staging them as files in the folder the cluster names in
``spark.checkpoint.dir`` makes every consumer scan a real file (splittable, pruned),
cuts lineage, and survives executor loss. The folder name is derived from the identity
(path, size, modification time) of the source files, so a changed source gets a new
stage. Only Hadoop's FileSystem API is used, so the same code works on local disk, HDFS
or an object store.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plantwise.session import shared_dir

STAGE_VERSION = "1"
# Library files whose code decides what a staged table contains: a change to any of them
# gives new stage folders, so a stale stage is never read.
_CODE_DIRS = ("functions", "sources")
_CODE_FILES = ("operators/facts.py", "operators/paging.py")


def code_fingerprint() -> str:
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    files = []
    for d in _CODE_DIRS:
        folder = os.path.join(root, d)
        files += sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".py"))
    files += [os.path.join(root, f) for f in _CODE_FILES]
    h = hashlib.sha1()
    for f in files:
        with open(f, "rb") as fh:
            h.update(fh.read())
    return h.hexdigest()[:12]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p


def path_identity(spark: SparkSession, paths: list[str]) -> str:
    parts = []
    for path in paths:
        fs, p = _fs(spark, path)
        st = fs.getFileStatus(p)
        if st.isDirectory():
            # a table folder: total bytes and file count (one summary call) + folder mtime
            cs = fs.getContentSummary(p)
            parts.append(f"{path}|{cs.getLength()}|{cs.getFileCount()}|{st.getModificationTime()}")
        else:
            parts.append(f"{path}|{st.getLen()}|{st.getModificationTime()}")
    parts.append(code_fingerprint())
    return hashlib.sha1("\n".join(parts).encode()).hexdigest()[:16]


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def stage_folder(spark: SparkSession, name: str, sources: list[str]) -> str:
    """The folder of what is derived from ``sources`` under ``name``."""
    return shared_dir(spark, f"plantwise-stage-v{STAGE_VERSION}/{name}-{path_identity(spark, sources)}")


def stage_once(
    spark: SparkSession,
    name: str,
    sources: list[str],
    build: Callable[[], DataFrame],
    fmt: str = "parquet",
    options: dict[str, str] | None = None,
    files: int | None = None,
    partition_by: list[str] | None = None,
) -> str:
    """Return the path of the staged table, writing it first if it is not there yet."""
    path = stage_folder(spark, name, sources)
    if not exists(spark, path + "/_SUCCESS"):
        df = build()
        if files:
            df = df.repartition(files)
        writer = df.write.mode("overwrite").format(fmt)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        for k, v in (options or {}).items():
            writer = writer.option(k, v)
        writer.save(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new folder under the shared root and read back: what was dealt or numbered by
    task stays as it was if an executor is lost, and lineage ends there."""
    folder = shared_dir(df.sparkSession, f"plantwise-work/{name}-{uuid.uuid4().hex}")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
