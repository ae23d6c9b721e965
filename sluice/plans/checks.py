"""Set-up verification.

Every check is a one-row DataFrame ``(check, expected, actual, ok)``
compared exactly (never by substring), and the checks are unioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.config import has_rule


def check_row(df_one_row: DataFrame, name: str, expected: str, actual: Column) -> DataFrame:
    return df_one_row.select(
        F.lit(name).alias("check"),
        F.lit(expected).alias("expected"),
        actual.cast("string").alias("actual"),
    ).withColumn("ok", F.col("expected") == F.coalesce(F.col("actual"), F.lit("")))


def literal_check(spark: SparkSession, name: str, expected: str, actual: str) -> DataFrame:
    return check_row(spark.range(1), name, expected, F.lit(actual))


def config_checks(config_df: DataFrame, active_expected: int, rule_source: str, rule_id: str,
                  updated_source: str) -> list[DataFrame]:
    """Active-source count, the updated row still there once, a rule present.

    The update is written as a new version of the table and read back.
    """
    from sluice.operators.mutate import commit_snapshot, read_snapshot, update_rows
    from sluice.session import scratch_path

    spark = config_df.sparkSession
    path = scratch_path(spark, "checks")
    commit_snapshot(update_rows(config_df, {"last_modified_at": F.current_timestamp()}, F.col("source_id") == updated_source), path)
    updated = read_snapshot(spark, path, config_df.schema)
    return [
        check_row(config_df.agg(F.count_if(F.col("is_active")).alias("n")), "active_sources", str(active_expected), F.col("n")),
        check_row(updated.agg(F.count_if(F.col("source_id") == updated_source).alias("n")), "row_once_after_update", "1", F.col("n")),
        check_row(has_rule(config_df, rule_id).filter(F.col("source_id") == rule_source).agg(F.max("has_rule").alias("h")),
                  f"rule_{rule_id}_present", "true", F.col("h")),
    ]


def catalog_checks(spark: SparkSession, db: str) -> list[DataFrame]:
    """The config table is MANAGED and the results table EXTERNAL."""
    from sluice.plans.catalog import table_type

    return [
        literal_check(spark, "config_table_managed", "MANAGED", table_type(spark, db, "ingestion_config")),
        literal_check(spark, "results_table_external", "EXTERNAL", table_type(spark, db, "dq_results")),
    ]


def expectations(checks: list[DataFrame]) -> DataFrame:
    """The union of all checks."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def seed_listing(config_df: DataFrame) -> DataFrame:
    """The seeded configs ordered by type and id."""
    return config_df.select("source_id", "source_name", "source_type", "is_active", "created_by", "schema_version").orderBy(
        "source_type", "source_id")
