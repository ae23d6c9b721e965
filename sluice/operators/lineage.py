"""Row-count lineage and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.quality import FAILED


def row_counts(verdict: DataFrame) -> DataFrame:
    """G1 + G2: one row -- read, written, rejected, and whether they reconcile."""
    ok = F.size(F.col(FAILED)) == 0
    c = verdict.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(ok).alias("rows_written"),
        F.count_if(~ok).alias("rows_rejected"),
    )
    return c.withColumn("reconciled", F.col("rows_read") == F.col("rows_written") + F.col("rows_rejected"))


def unreconciled(lineage: DataFrame) -> DataFrame:
    """Lineage rows where read != written + rejected (must be empty)."""
    return lineage.filter(F.col("rows_read") != F.col("rows_written") + F.col("rows_rejected"))


def transformation_log(mapping: dict[str, str], rule_ids: list[str], dedup_column: str | None):
    """``{column_mapping_applied, dq_rules_applied, dedup_column}`` as JSON text."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else F.create_map().cast("map<string,string>")
    rules = F.array(*[F.lit(r) for r in rule_ids]) if rule_ids else F.array().cast("array<string>")
    return F.to_json(
        F.struct(
            m.alias("column_mapping_applied"),
            rules.alias("dq_rules_applied"),
            F.lit(dedup_column).cast("string").alias("dedup_column"),
        )
    )


def source_files(df: DataFrame) -> DataFrame:
    """Distinct raw files behind a scan (file-source metadata column)."""
    return df.select(F.col("_metadata.file_path").alias("source_path")).distinct()


def partition_count(silver: DataFrame, processing_date: str, source_id: str) -> DataFrame:
    """Rows re-read from one written partition (partition-pruned count)."""
    return silver.filter((F.col("processing_date") == processing_date) & (F.col("source_id") == source_id)).agg(
        F.count(F.lit(1)).alias("rows_found"))
