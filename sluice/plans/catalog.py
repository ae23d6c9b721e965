"""Catalog set-up and inspection.

The config table is MANAGED (dropping it deletes its files); every other
table is EXTERNAL over its own directory (dropping keeps the files).  All
statements are idempotent, so ``create_all`` can run before every job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import schemas
from sluice.plans.ingest import Layout
from sluice.session import local_frame
from sluice.sources.files import make_dirs

# Join keys the silver tables are bucketed on when buckets are asked for: the
# card table and the fraud flags share one bucketing of the transaction id, so
# the fraud -> card join reads co-located buckets without a shuffle.
BUCKET_KEYS = {
    "card_transactions_silver": "transaction_id",
    "fraud_flags_silver": "transaction_ref",
    "merchant_silver": "merchant_id",
    "atm_silver": "withdrawal_id",
}

SILVER_DIRS = {
    "card_transactions_silver": "silver/card_transactions",
    "merchant_silver": "silver/merchant_updates",
    "atm_silver": "silver/atm_withdrawals",
    "fraud_flags_silver": "silver/fraud_flags",
}


def _ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def external_locations(layout: Layout) -> dict[str, str]:
    locs = {
        "schema_registry": layout.registry,
        "dq_results": layout.dq_results,
        "dq_summary": layout.dq_summary,
        "pipeline_lineage": layout.lineage,
    }
    locs.update({t: f"{layout.root}/{d}" for t, d in SILVER_DIRS.items()})
    return locs


def create_external_table(spark: SparkSession, db: str, table: str, location: str, buckets: int | None = None) -> None:
    """``CREATE TABLE IF NOT EXISTS ... USING parquet PARTITIONED BY ... [CLUSTERED BY ...] LOCATION``."""
    make_dirs(spark, location)  # an external table owns its directory even before data lands
    schema = schemas.TABLES[table]
    parts = schemas.PARTITIONS[table]
    part_sql = f" PARTITIONED BY ({', '.join(parts)})" if parts else ""
    bucket_sql = ""
    if buckets and table in BUCKET_KEYS:
        key = BUCKET_KEYS[table]
        bucket_sql = f" CLUSTERED BY ({key}) SORTED BY ({key}) INTO {int(buckets)} BUCKETS"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_ident(db)}.{_ident(table)} ({schemas.ddl(schema)}) USING parquet"
        f"{part_sql}{bucket_sql} LOCATION '{location}' OPTIONS (compression 'snappy')"
    )


def create_all(spark: SparkSession, db: str, layout: Layout, location: str | None = None,
               buckets: int | None = None) -> None:
    """B6 + B7 + B5: database, managed config table, external tables.

    ``location`` places the database (and so its managed tables) outside
    the session's default warehouse.  ``buckets`` buckets the silver tables
    on their join keys (``BUCKET_KEYS``); write them with ``run_source(...,
    silver_table=...)`` so that every write keeps the bucketing.
    """
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {_ident(db)} COMMENT 'Metadata-driven ingestion'{loc}")
    if not spark.catalog.tableExists(f"{db}.ingestion_config"):
        # The config table is ORC with Snappy, as in the data model (Spark's ORC default codec is zstd).
        (local_frame(spark, [], schemas.INGESTION_CONFIG).write.format("orc").option("compression", "snappy")
         .saveAsTable(f"{db}.ingestion_config"))
    for table, loc in external_locations(layout).items():
        create_external_table(spark, db, table, loc, buckets if table in SILVER_DIRS else None)


def refresh_partitions(spark: SparkSession, db: str, table: str) -> None:
    """Register partitions written as files (``MSCK REPAIR TABLE``)."""
    if schemas.PARTITIONS.get(table):
        spark.catalog.recoverPartitions(f"{db}.{table}")
    spark.catalog.refreshTable(f"{db}.{table}")


def drop_database(spark: SparkSession, db: str) -> None:
    """``DROP DATABASE IF EXISTS ... CASCADE``."""
    spark.sql(f"DROP DATABASE IF EXISTS {_ident(db)} CASCADE")


def list_tables(spark: SparkSession, db: str) -> DataFrame:
    """``SHOW TABLES`` as a DataFrame (catalog tables only, no temporary views)."""
    return spark.sql(f"SHOW TABLES IN {_ident(db)}").filter(~F.col("isTemporary"))


def table_type(spark: SparkSession, db: str, table: str) -> str:
    """MANAGED or EXTERNAL, from ``DESCRIBE TABLE EXTENDED``."""
    d = spark.sql(f"DESCRIBE TABLE EXTENDED {_ident(db)}.{_ident(table)}")
    row = d.filter(F.col("col_name") == "Type").select("data_type").first()
    return row[0] if row else "UNKNOWN"
