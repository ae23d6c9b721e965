"""Partitioned table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.session import ensure_settings


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    partitions: dict[str, str] | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """A9 + A10: a partitioned Parquet table read with its declared schema.

    Partition filters are plain predicates on the partition columns, so
    Catalyst prunes directories (``PartitionFilters`` in the plan) and only
    the requested columns are read (``ReadSchema``).
    """
    ensure_settings(spark)
    df = spark.read.schema(schema).option("basePath", path).parquet(path)
    for col, value in (partitions or {}).items():
        df = df.filter(F.col(col) == F.lit(value))
    return df.select(*columns) if columns else df


def latest_snapshot(df: DataFrame, group: str = "source_id", version: str = "processing_date") -> DataFrame:
    """Rows of the newest snapshot per group (reference data overwritten per run).

    A NULL-safe semi-join against the max version per group: one aggregate
    combined map-side (a group with a third of all rows collapses before the
    shuffle), no window over the rows.  A NULL group is a group, and a group
    whose versions are all NULL keeps its rows.
    """
    newest = df.groupBy(F.col(group).alias("_g")).agg(F.max(version).alias("_v"))
    return df.join(newest, df[group].eqNullSafe(newest["_g"]) & df[version].eqNullSafe(newest["_v"]), "left_semi")
