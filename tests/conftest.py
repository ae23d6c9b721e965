import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from sluice.session import ENGINE_SETTINGS

    work = tempfile.mkdtemp(prefix="sluice-tests-")
    builder = (
        SparkSession.builder.master("local[*]")
        .appName("sluice-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.warehouse.dir", os.path.join(work, "warehouse"))
    )
    for k, v in ENGINE_SETTINGS.items():
        builder = builder.config(k, v)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(os.path.join(work, "checkpoints"))
    yield session
    session.stop()
