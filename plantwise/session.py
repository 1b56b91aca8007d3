"""Session helpers.

A cluster names its shared checkpoint folder in ``spark.checkpoint.dir``; we read it
from the session and only fall back to our own folder where it is unset (tests, local
runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "plantwise",
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session with the defaults the operators assume."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


SHARED_DIR_KEY = "plantwise.shared.dir"


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; only where it is
    unset (tests, local runs) a folder of our own is created and remembered."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not root:
        root = spark.conf.get(SHARED_DIR_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            # a machine-local folder is invisible to executors and lost with the driver
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="plantwise-shared-")
        spark.conf.set(SHARED_DIR_KEY, root)
    return root


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint()`` usable: set the context's checkpoint folder from
    the shared root if the context has none yet."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    sc.setCheckpointDir(shared_root(spark))
    return sc.getCheckpointDir() or shared_root(spark)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A stable sub-folder of the shared root (staged tables, stream sinks and
    checkpoints); unlike ``getCheckpointDir()`` it is the same for every application."""
    return os.path.join(shared_root(spark), name)
