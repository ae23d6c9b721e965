"""StructTypes of the nine tables of the data model.

Partition columns are listed last and are STRING, as in the table
definitions; readers always pass these schemas explicitly so that Spark
never infers a ``date`` partition type.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, B, I, L, D = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType(), T.DoubleType()
TS, DT = T.TimestampType(), T.DateType()


def _st(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


INGESTION_CONFIG = _st(
    ("source_id", S), ("source_name", S), ("source_type", S),
    ("hdfs_raw_path", S), ("file_format", S), ("delimiter", S), ("has_header", B),
    ("date_column", S), ("date_format", S), ("primary_key_column", S),
    ("target_table", S), ("hdfs_silver_path", S), ("hdfs_rejected_path", S),
    ("dq_rules_json", S), ("column_mapping_json", S),
    ("is_active", B), ("created_at", TS), ("created_by", S), ("last_modified_at", TS), ("schema_version", I),
    # Settings that the pipeline needs beyond the 20 columns of the data model.
    ("file_pattern", S), ("source_timezone", S), ("source_currency", S),
)

SCHEMA_REGISTRY = _st(
    ("source_id", S), ("column_name", S), ("column_type", S), ("is_nullable", B),
    ("sample_values", S), ("null_rate", D), ("min_value", S), ("max_value", S),
    ("schema_version", I), ("analysed_at", TS), ("source_id_part", S),
)

DQ_RESULTS = _st(
    ("run_id", S), ("source_id", S), ("source_name", S),
    ("rule_id", S), ("rule_name", S), ("rule_type", S), ("rule_expression", S), ("column_name", S),
    ("total_rows", L), ("passed_rows", L), ("failed_rows", L), ("pass_rate", D), ("threshold", D),
    ("rule_passed", B), ("sample_failures", S), ("checked_at", TS),
    ("processing_date", S), ("source_id_part", S),
)

DQ_SUMMARY = _st(
    ("run_id", S), ("source_id", S), ("source_name", S), ("processing_date", S),
    ("total_rows_ingested", L), ("total_rows_passed", L), ("total_rows_rejected", L),
    ("overall_pass_rate", D), ("rules_checked", I), ("rules_passed", I), ("rules_failed", I),
    ("ingestion_status", S), ("duration_seconds", L),
    ("silver_path", S), ("rejected_path", S), ("run_completed_at", TS),
    ("processing_date_part", S),
)

_AUDIT = (("dq_passed", B), ("run_id", S), ("ingested_at", TS))
_PARTS = (("processing_date", S), ("source_id", S))

CARD_TRANSACTIONS_SILVER = _st(
    ("transaction_id", S), ("card_identifier", S), ("merchant_name", S), ("amount_usd", D),
    ("transaction_ts", TS), ("status", S), ("is_international", I), ("source_currency", S),
    ("original_amount", D), *_AUDIT, *_PARTS,
)

MERCHANT_SILVER = _st(
    ("merchant_id", S), ("business_name", S), ("merchant_category", S), ("country_code", S),
    ("city", S), ("risk_tier", S), ("onboarded_date", DT), ("is_active", I), *_AUDIT, *_PARTS,
)

ATM_SILVER = _st(
    ("withdrawal_id", S), ("atm_id", S), ("card_hash", S), ("amount_sgd", D), ("currency", S),
    ("withdrawal_ts", TS), ("dispense_status", S), ("location", S), *_AUDIT, *_PARTS,
)

FRAUD_FLAGS_SILVER = _st(
    ("flag_id", S), ("transaction_ref", S), ("fraud_score", D), ("flag_type", S),
    ("flagged_at", TS), ("reviewed", I), *_AUDIT, *_PARTS,
)

PIPELINE_LINEAGE = _st(
    ("lineage_id", S), ("run_id", S), ("source_id", S),
    ("source_path", S), ("target_table", S), ("target_path", S),
    ("rows_read", L), ("rows_written", L), ("rows_rejected", L),
    ("transformation_log", S), ("spark_app_id", S),
    ("started_at", TS), ("completed_at", TS), ("status", S),
    ("processing_date", S),
)

SILVER_TABLES: dict[str, T.StructType] = {
    "card_transactions_silver": CARD_TRANSACTIONS_SILVER,
    "merchant_silver": MERCHANT_SILVER,
    "atm_silver": ATM_SILVER,
    "fraud_flags_silver": FRAUD_FLAGS_SILVER,
}

PARTITIONS: dict[str, tuple[str, ...]] = {
    "ingestion_config": (),
    "schema_registry": ("source_id_part",),
    "dq_results": ("processing_date", "source_id_part"),
    "dq_summary": ("processing_date_part",),
    "card_transactions_silver": ("processing_date", "source_id"),
    "merchant_silver": ("processing_date", "source_id"),
    "atm_silver": ("processing_date", "source_id"),
    "fraud_flags_silver": ("processing_date", "source_id"),
    "pipeline_lineage": ("processing_date",),
}

TABLES: dict[str, T.StructType] = {
    "ingestion_config": INGESTION_CONFIG,
    "schema_registry": SCHEMA_REGISTRY,
    "dq_results": DQ_RESULTS,
    "dq_summary": DQ_SUMMARY,
    **SILVER_TABLES,
    "pipeline_lineage": PIPELINE_LINEAGE,
}

# Columns the pipeline adds to every silver row (C9) and the rejected zone's extras (B2).
AUDIT_COLUMNS = tuple(n for n, _ in _AUDIT)
PARTITION_COLUMNS = tuple(n for n, _ in _PARTS)


def data_fields(table: str) -> list[T.StructField]:
    """Silver fields coming from the feed (no audit or partition columns)."""
    skip = set(AUDIT_COLUMNS) | set(PARTITION_COLUMNS)
    return [f for f in TABLES[table].fields if f.name not in skip]


def ddl(schema: T.StructType, drop: tuple[str, ...] = ()) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields if f.name not in drop)
