"""Writers for silver, rejected and audit tables.

* silver / rejected: Snappy Parquet partitioned by ``(processing_date,
  source_id)``, dynamic partition overwrite, so a rerun of one day and source
  replaces exactly that partition;
* audit tables: append only.

Rows are dealt to the writers as they come from the scan, by ``balanced`` or,
for a bucketed table, by ``bucketed``, never by merging partitions: a merge
would pull the scan and the joins before it into as few tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.session import ensure_settings, local_frame
from sluice.sources.files import delete_path


def partition_path(base: str, spec: dict[str, str]) -> str:
    return base.rstrip("/") + "/" + "/".join(f"{k}={v}" for k, v in spec.items())


def balanced(df: DataFrame, partition_cols: list[str] | tuple[str, ...]) -> DataFrame:
    """Deal rows to files of about ``advisoryPartitionSizeInBytes``.

    A rebalance on the partition columns: what comes before runs in all its
    tasks, small shares are merged by adaptive execution, and a partition with
    more than one file's worth is split.
    """
    return df.hint("rebalance", *partition_cols)


def bucketed(df: DataFrame, buckets: int, keys: list[str]) -> DataFrame:
    """Deal rows by a table's bucket expression, so that each bucket is written by one task, as one file."""
    return df.repartition(buckets, *keys)


def table_buckets(spark: SparkSession, table: str) -> tuple[int, list[str]] | None:
    """Bucket count and columns of a catalog table; None if it has no buckets."""
    said = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    n = said.get("Num Buckets")
    return (int(n), [c.strip(" `") for c in said["Bucket Columns"].strip("[]").split(",")]) if n and int(n) > 0 else None


def overwrite_partitions(df: DataFrame, path: str, partition_cols: list[str] | tuple[str, ...]) -> None:
    """Replace only the partitions present in ``df``."""
    ensure_settings(df.sparkSession)
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy(*partition_cols)
        .parquet(path)
    )


def overwrite_table_partitions(df: DataFrame, table: str) -> None:
    """B1 into a catalog table (keeps its bucketing): dynamic partition overwrite by name."""
    ensure_settings(df.sparkSession)
    cols = [f.name for f in df.sparkSession.table(table).schema.fields]
    df.select(*cols).write.insertInto(table, overwrite=True)


#: A write of more than this share of the rows that were read keeps the tasks of the scan.
SHUFFLED_SHARE = 0.5


def dealt_for(df: DataFrame, partition_cols: list[str] | tuple[str, ...], share: float, table: str | None = None) -> DataFrame:
    """Rows dealt for a write by path, or through ``table`` by its buckets if it has any.

    Most rows of a scan make files as large as its splits where they are, and
    to shuffle them would cost as much as to read them.  A smaller ``share``
    would make files as much smaller, so it is balanced, which shuffles half
    of the rows at most.
    """
    spread = table_buckets(df.sparkSession, table) if table else None
    if spread:
        return bucketed(df, *spread)
    return df if share > SHUFFLED_SHARE else balanced(df, partition_cols)


def replace_partition(df: DataFrame, path: str, partition_cols, spec: dict[str, str], rows: int) -> None:
    """Idempotent write of one partition.

    Dynamic overwrite leaves an old partition in place when the new output
    has no row for it, so an empty result drops the partition explicitly.
    """
    if rows > 0:
        overwrite_partitions(df, path, partition_cols)
    else:
        delete_path(df.sparkSession, partition_path(path, spec))


def append(df: DataFrame, path: str, partition_cols=()) -> None:
    """Append-only audit sink."""
    w = df.write.mode("append").option("compression", "snappy")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(path)


def insert_into(df: DataFrame, table: str, overwrite: bool = False) -> None:
    """``INSERT INTO table SELECT ...`` (columns by position)."""
    df.write.insertInto(table, overwrite=overwrite)


def insert_values(spark: SparkSession, table: str, rows: list[tuple], schema) -> None:
    """``INSERT ... VALUES`` as a DataFrame append."""
    local_frame(spark, rows, schema).write.insertInto(table)
