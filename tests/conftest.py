import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from plantwise.session import DEFAULT_CONF, ensure_checkpoint_dir

    builder = SparkSession.builder.master("local[4]").appName("plantwise-tests").config(
        "spark.sql.shuffle.partitions", "4")
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    # a shared folder only where the cluster names none (as in tests)
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("plantwise.shared.dir", tempfile.mkdtemp(prefix="plantwise-test-"))
    ensure_checkpoint_dir(session)
    yield session


@pytest.fixture(scope="session")
def duck_small():
    from tools.oracle_check import duck_connection

    return duck_connection(SF_SMALL)
