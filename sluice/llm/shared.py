"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()
_made = threading.local()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once an application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="sluice-code-")) / "sluice_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``.  Only where
    that is unset and everything runs in one process (tests) is a temporary
    folder made; a cluster without the setting is refused, because executors
    would then write to disks of their own.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(made := tempfile.mkdtemp(prefix="sluice-llm-"))
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    made().append(path)
    return path


def made() -> list[str]:
    """The scratch paths that this thread's operators have named so far and that are not swept yet."""
    if not hasattr(_made, "paths"):
        _made.paths = []
    return _made.paths


def sweep(spark: SparkSession, begun: int) -> None:
    """Delete all scratch tables named since ``made()`` was ``begun`` long, but the last one.

    For a caller whose last step was to store a result: nothing before it is read again.
    """
    paths = made()
    for path in paths[begun:-1]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    paths[begun:-1] = []


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: rows go to the shared folder, so a lost executor loses none."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Unlike a checkpoint, the files tell the planner their size, so it
    broadcasts the table only if it is in fact small.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """Rename the columns whose names (in any case) an operator uses inside, and how: old name to new.

    Names given out again are put back by ``restored``.
    """
    taken, inner, new = {c.lower() for c in df.columns}, {n.lower() for n in names}, {}
    for c in df.columns:
        if c.lower() in inner:
            name = f"in_{c}"
            while name.lower() in taken | inner:
                name = f"in_{name}"
            taken.add(name.lower())
            new[c] = name
    return (df.withColumnsRenamed(new) if new else df), new


def restored(df: DataFrame, new: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({b: a for a, b in new.items()}) if new else df


def others(df: DataFrame, *taken: str) -> list[str]:
    """Columns of ``df``, quoted, but those whose names (in any case) an operator gives out itself."""
    return [f"`{c}`" for c in df.columns if c.lower() not in {n.lower() for n in taken}]
