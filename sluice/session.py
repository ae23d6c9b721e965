"""Session settings and the shared work folder.

The caller owns the SparkSession.  ``ensure_settings`` applies the few SQL
settings the engine relies on (UTC session zone, dynamic partition overwrite,
string partition values) without touching anything else, and ``work_root``
resolves the shared folder for staged tables from ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

ENGINE_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Partition values are STRING in every table of the data model.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


TARGET_SHUFFLE_PARTITION_BYTES = 128 * 1024 * 1024
#: Set only where the caller's session doesn't: files come out near this size.
FILE_SIZE_SETTING = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def ensure_settings(spark: SparkSession) -> SparkSession:
    for key, value in ENGINE_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if spark.conf.get(FILE_SIZE_SETTING, None) is None:
        spark.conf.set(FILE_SIZE_SETTING, str(TARGET_SHUFFLE_PARTITION_BYTES))
    return spark


SHUFFLE_SETTING = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_SIZING = threading.Lock()
_wanted: list[int] = []
_original: list[str | None] = []


@contextmanager
def sized_shuffles(spark: SparkSession, input_bytes: int):
    """Raise the initial shuffle partition count to one per 128 MB of input, for a while.

    AQE merges small shuffle partitions at run time but cannot split a
    too-coarse one (skew joins aside), so the starting count must grow with
    the input; it is never lowered.  Runs side by side use the largest count
    any of them wants, and the last one to end restores the caller's setting.
    """
    want = -(-int(input_bytes) // TARGET_SHUFFLE_PARTITION_BYTES)
    with _SIZING:
        if not _wanted:
            _original[:] = [spark.conf.get(SHUFFLE_SETTING, None)]
        _wanted.append(want)
        _apply_size(spark)
    try:
        yield
    finally:
        with _SIZING:
            _wanted.remove(want)
            _apply_size(spark)


def _apply_size(spark: SparkSession) -> None:
    before = _original[0]
    least = int(before or spark.conf.get("spark.sql.shuffle.partitions", "200"))
    if _wanted and max(_wanted) > least:
        spark.conf.set(SHUFFLE_SETTING, str(max(_wanted)))
    elif before is None:
        spark.conf.unset(SHUFFLE_SETTING)
    else:
        spark.conf.set(SHUFFLE_SETTING, before)


def local_frame(spark: SparkSession, rows, schema) -> "DataFrame":
    """A small driver-side table (config rows, one-row counts, bounded key lists).

    Built through Arrow into a JVM-local relation, so reading it needs no
    Python worker.  Only for data whose size is bounded by construction.
    """
    import pandas as pd
    from pyspark.sql import types as T

    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    rows = [tuple(r) for r in rows]
    cols = {f.name: pd.Series([r[i] for r in rows], dtype=object) for i, f in enumerate(st.fields)}
    key = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return spark.createDataFrame(pd.DataFrame(cols, columns=[f.name for f in st.fields]), st)
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def require_local(master: str) -> None:
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"master {master}: set spark.checkpoint.dir to a folder that all executors share")


def work_root(spark: SparkSession) -> str:
    """Shared folder for staged tables and scratch output.

    Uses the cluster's ``spark.checkpoint.dir``.  Only when it is unset in a
    session whose executors are threads of this process (tests) is a private
    folder made and registered; on a cluster each executor would write to a
    disk of its own, so there the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        require_local(spark.sparkContext.master)
        root = tempfile.mkdtemp(prefix="sluice-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A fresh, unique path under the work root (never reused)."""
    return "/".join([work_root(spark), "sluice", *parts, uuid.uuid4().hex])


def build_local_session(app: str = "sluice", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench (local mode, UI off)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SLUICE_DRIVER_MEMORY", "8g"))
    )
    for key, value in ENGINE_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    work_root(spark)
    return spark
