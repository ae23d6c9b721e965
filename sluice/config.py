"""Source configuration: the control plane of an ingestion run.

A config row names the format, path template, column mapping, primary key,
event-time column and pattern, and the data-quality rules of one source.
Rules and mapping arrive as JSON text (``dq_rules_json``,
``column_mapping_json``).  Two views exist:

* driver side: ``SourceConfig`` / ``Rule`` dataclasses built from the active
  config rows (one row per source -- the only data the engine collects);
* executor side: ``rules_frame`` / ``mapping_frame`` / ``validate_configs``
  explode the JSON of a whole config table as DataFrames.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE_TYPES = ("not_null", "range", "allowed_values", "regex", "custom")
PATH_DATE_TOKEN = "{YYYY-MM-DD}"

RULES_SCHEMA = T.ArrayType(
    T.StructType(
        [
            T.StructField("rule_id", T.StringType()),
            T.StructField("rule_name", T.StringType()),
            T.StructField("column", T.StringType()),
            T.StructField("type", T.StringType()),
            T.StructField("expression", T.StringType()),
            T.StructField("values", T.ArrayType(T.StringType())),
            T.StructField("threshold", T.DoubleType()),
        ]
    )
)
MAPPING_SCHEMA = T.MapType(T.StringType(), T.StringType())


@dataclass(frozen=True)
class Rule:
    rule_id: str
    rule_name: str
    column: str
    type: str
    threshold: float = 1.0
    expression: str | None = None
    values: tuple[str, ...] | None = None

    @staticmethod
    def from_dict(d: dict[str, Any]) -> "Rule":
        values = d.get("values")
        return Rule(
            rule_id=str(d["rule_id"]),
            rule_name=str(d.get("rule_name") or d["rule_id"]),
            column=str(d.get("column") or ""),
            type=str(d["type"]),
            threshold=float(d.get("threshold", 1.0)),
            expression=d.get("expression"),
            values=tuple(str(v) for v in values) if values is not None else None,
        )


@dataclass(frozen=True)
class SourceConfig:
    source_id: str
    source_name: str
    source_type: str
    raw_path: str
    file_format: str
    delimiter: str
    has_header: bool
    date_column: str
    date_format: str
    primary_key_column: str
    target_table: str
    silver_path: str
    rejected_path: str
    rules: tuple[Rule, ...]
    column_mapping: tuple[tuple[str, str], ...]
    is_active: bool = True
    created_by: str = "human"
    schema_version: int = 1
    # Extensions for gaps in the config model (see README).
    file_pattern: str | None = None
    source_timezone: str = "UTC"
    source_currency: str | None = None

    # ---- name translation (raw names vs silver names) -------------------
    @property
    def mapping(self) -> dict[str, str]:
        return dict(self.column_mapping)

    def silver_name(self, raw: str) -> str:
        return self.mapping.get(raw, raw)

    @property
    def pk_silver(self) -> str:
        return self.silver_name(self.primary_key_column)

    @property
    def date_silver(self) -> str:
        return self.silver_name(self.date_column)

    def raw_path_for(self, processing_date: str) -> str:
        return self.raw_path.replace(PATH_DATE_TOKEN, processing_date)

    def with_root(self, root: str) -> "SourceConfig":
        """Resolve ``{root}`` in the three paths."""
        return replace(
            self,
            raw_path=self.raw_path.replace("{root}", root),
            silver_path=self.silver_path.replace("{root}", root),
            rejected_path=self.rejected_path.replace("{root}", root),
        )

    # ---- JSON forms as stored in the config table -----------------------
    def rules_json(self) -> str:
        out = []
        for r in self.rules:
            d: dict[str, Any] = {"rule_id": r.rule_id, "rule_name": r.rule_name, "column": r.column, "type": r.type}
            if r.expression is not None:
                d["expression"] = r.expression
            if r.values is not None:
                d["values"] = list(r.values)
            d["threshold"] = r.threshold
            out.append(d)
        return json.dumps(out)

    def mapping_json(self) -> str:
        return json.dumps(dict(self.column_mapping))

    @staticmethod
    def from_row(row: dict[str, Any]) -> "SourceConfig":
        rules = tuple(Rule.from_dict(d) for d in json.loads(row["dq_rules_json"] or "[]"))
        mapping = tuple(json.loads(row["column_mapping_json"] or "{}").items())
        return SourceConfig(
            source_id=row["source_id"],
            source_name=row["source_name"],
            source_type=row["source_type"],
            raw_path=row["hdfs_raw_path"],
            file_format=row["file_format"],
            delimiter=row["delimiter"] or ",",
            has_header=bool(row["has_header"]),
            date_column=row["date_column"],
            date_format=row["date_format"],
            primary_key_column=row["primary_key_column"],
            target_table=row["target_table"],
            silver_path=row["hdfs_silver_path"],
            rejected_path=row["hdfs_rejected_path"],
            rules=rules,
            column_mapping=mapping,
            is_active=bool(row["is_active"]),
            created_by=row.get("created_by") or "human",
            schema_version=int(row.get("schema_version") or 1),
            file_pattern=row.get("file_pattern"),
            source_timezone=row.get("source_timezone") or "UTC",
            source_currency=row.get("source_currency"),
        )


def _rules(*dicts: dict[str, Any]) -> tuple[Rule, ...]:
    return tuple(Rule.from_dict(d) for d in dicts)


# ---------------------------------------------------------------------------
# FIXED VALUES: the four seeded source configurations of the data model
# (ids, names, types, formats, key and date columns, patterns, targets,
# rules with thresholds, and column mappings), in seed order.  The fifth,
# the fraud feed, is ours: the data model has its table and feed but no
# seeded config.  Paths use a ``{root}`` placeholder instead of a cluster
# address.
# ---------------------------------------------------------------------------
SEED_CONFIGS: tuple[SourceConfig, ...] = (
    SourceConfig(
        source_id="src_us_card_txns",
        source_name="US Card Transactions",
        source_type="card_transactions",
        raw_path="{root}/raw/card_transactions/processing_date={YYYY-MM-DD}/",
        file_format="csv",
        delimiter=",",
        has_header=True,
        date_column="transaction_time",
        date_format="yyyy-MM-dd HH:mm:ss",
        primary_key_column="transaction_id",
        target_table="card_transactions_silver",
        silver_path="{root}/silver/card_transactions/",
        rejected_path="{root}/rejected/us_card_txns/",
        rules=_rules(
            {"rule_id": "r001", "rule_name": "amount_not_null", "column": "amount_usd", "type": "not_null", "threshold": 0.97},
            {"rule_id": "r002", "rule_name": "amount_positive", "column": "amount_usd", "type": "range", "expression": "amount_usd > 0 AND amount_usd < 50000", "threshold": 0.99},
            {"rule_id": "r003", "rule_name": "status_valid", "column": "status", "type": "allowed_values", "values": ["APPROVED", "DECLINED", "PENDING"], "threshold": 0.98},
            {"rule_id": "r004", "rule_name": "transaction_id_not_null", "column": "transaction_id", "type": "not_null", "threshold": 1.0},
        ),
        column_mapping=(
            ("transaction_id", "transaction_id"),
            ("card_number", "card_identifier"),
            ("merchant_name", "merchant_name"),
            ("amount_usd", "amount_usd"),
            ("transaction_time", "transaction_ts"),
            ("status", "status"),
            ("is_international", "is_international"),
        ),
        source_currency="USD",
    ),
    SourceConfig(
        source_id="src_in_card_txns",
        source_name="India Card Transactions",
        source_type="card_transactions",
        raw_path="{root}/raw/card_transactions/processing_date={YYYY-MM-DD}/",
        file_format="csv",
        delimiter=",",
        has_header=True,
        date_column="txn_datetime",
        date_format="dd/MM/yyyy HH:mm",
        primary_key_column="txn_ref",
        target_table="card_transactions_silver",
        silver_path="{root}/silver/card_transactions/",
        rejected_path="{root}/rejected/in_card_txns/",
        rules=_rules(
            {"rule_id": "r005", "rule_name": "card_id_not_null", "column": "card_identifier", "type": "not_null", "threshold": 0.94},
            {"rule_id": "r006", "rule_name": "amount_inr_positive", "column": "original_amount", "type": "range", "expression": "original_amount > 0 AND original_amount < 10000000", "threshold": 0.99},
            {"rule_id": "r007", "rule_name": "txn_ref_not_null", "column": "transaction_id", "type": "not_null", "threshold": 1.0},
            {"rule_id": "r008", "rule_name": "status_valid", "column": "status", "type": "allowed_values", "values": ["success", "failed", "pending"], "threshold": 0.97},
        ),
        column_mapping=(
            ("txn_ref", "transaction_id"),
            ("card_id", "card_identifier"),
            ("vendor", "merchant_name"),
            ("amount_inr", "original_amount"),
            ("txn_datetime", "transaction_ts"),
            ("txn_status", "status"),
        ),
        source_currency="INR",
    ),
    SourceConfig(
        source_id="src_merchant_updates",
        source_name="Merchant Reference Data",
        source_type="merchant",
        raw_path="{root}/raw/merchant_updates/processing_date={YYYY-MM-DD}/",
        file_format="csv",
        delimiter=",",
        has_header=True,
        date_column="onboarded_date",
        date_format="yyyy-MM-dd",
        primary_key_column="merchant_id",
        target_table="merchant_silver",
        silver_path="{root}/silver/merchant_updates/",
        rejected_path="{root}/rejected/merchants/",
        rules=_rules(
            {"rule_id": "r009", "rule_name": "merchant_id_not_null", "column": "merchant_id", "type": "not_null", "threshold": 1.0},
            {"rule_id": "r010", "rule_name": "category_not_null", "column": "merchant_category", "type": "not_null", "threshold": 0.97},
            {"rule_id": "r011", "rule_name": "country_code_format", "column": "country_code", "type": "regex", "expression": "^[A-Z]{2}$", "threshold": 0.99},
            {"rule_id": "r012", "rule_name": "risk_tier_valid", "column": "risk_tier", "type": "allowed_values", "values": ["LOW", "MEDIUM", "HIGH"], "threshold": 1.0},
            {"rule_id": "r013", "rule_name": "onboarded_date_not_null", "column": "onboarded_date", "type": "not_null", "threshold": 1.0},
        ),
        column_mapping=(
            ("merchant_id", "merchant_id"),
            ("business_name", "business_name"),
            ("merchant_category", "merchant_category"),
            ("country_code", "country_code"),
            ("city", "city"),
            ("risk_tier", "risk_tier"),
            ("onboarded_date", "onboarded_date"),
            ("is_active", "is_active"),
        ),
    ),
    SourceConfig(
        source_id="src_atm_sg",
        source_name="Singapore ATM Withdrawals",
        source_type="atm",
        raw_path="{root}/raw/atm_withdrawals/processing_date={YYYY-MM-DD}/",
        file_format="csv",
        delimiter=",",
        has_header=True,
        date_column="withdrawal_ts",
        date_format="yyyy-MM-dd'T'HH:mm:ss",
        primary_key_column="withdrawal_id",
        target_table="atm_silver",
        silver_path="{root}/silver/atm_withdrawals/",
        rejected_path="{root}/rejected/atm_sg/",
        rules=_rules(
            {"rule_id": "r014", "rule_name": "withdrawal_id_not_null", "column": "withdrawal_id", "type": "not_null", "threshold": 1.0},
            {"rule_id": "r015", "rule_name": "amount_multiple_of_50", "column": "amount_sgd", "type": "custom", "expression": "amount_sgd % 50 = 0", "threshold": 0.96},
            {"rule_id": "r016", "rule_name": "amount_positive", "column": "amount_sgd", "type": "range", "expression": "amount_sgd > 0 AND amount_sgd <= 20000", "threshold": 0.99},
            {"rule_id": "r017", "rule_name": "dispense_status_valid", "column": "dispense_status", "type": "allowed_values", "values": ["DISPENSED", "FAILED", "PARTIAL"], "threshold": 1.0},
            {"rule_id": "r018", "rule_name": "currency_sgd", "column": "currency", "type": "allowed_values", "values": ["SGD"], "threshold": 1.0},
        ),
        column_mapping=(
            ("withdrawal_id", "withdrawal_id"),
            ("atm_id", "atm_id"),
            ("card_hash", "card_hash"),
            ("amount_sgd", "amount_sgd"),
            ("currency", "currency"),
            ("withdrawal_ts", "withdrawal_ts"),
            ("dispense_status", "dispense_status"),
            ("location", "location"),
        ),
    ),
)

# Ours: the fraud feed (not seeded in the data model).
FRAUD_CONFIG = SourceConfig(
    source_id="src_fraud_flags",
    source_name="Fraud Flags",
    source_type="fraud_flags",
    raw_path="{root}/raw/fraud_flags/processing_date={YYYY-MM-DD}/",
    file_format="csv",
    delimiter=",",
    has_header=True,
    date_column="flagged_at",
    date_format="yyyy-MM-dd'T'HH:mm:ss",
    primary_key_column="flag_id",
    target_table="fraud_flags_silver",
    silver_path="{root}/silver/fraud_flags/",
    rejected_path="{root}/rejected/fraud_flags/",
    rules=_rules(
        {"rule_id": "f001", "rule_name": "flag_id_not_null", "column": "flag_id", "type": "not_null", "threshold": 1.0},
        {"rule_id": "f002", "rule_name": "score_in_range", "column": "fraud_score", "type": "range", "expression": "fraud_score >= 0.5 AND fraud_score <= 1.0", "threshold": 0.99},
        {"rule_id": "f003", "rule_name": "transaction_ref_not_null", "column": "transaction_ref", "type": "not_null", "threshold": 1.0},
    ),
    column_mapping=(
        ("flag_id", "flag_id"),
        ("transaction_ref", "transaction_ref"),
        ("fraud_score", "fraud_score"),
        ("flag_type", "flag_type"),
        ("flagged_at", "flagged_at"),
        ("reviewed", "reviewed"),
    ),
    is_active=False,
)


# ---------------------------------------------------------------------------
# Config table as a DataFrame
# ---------------------------------------------------------------------------
CONFIG_COLUMNS = (
    "source_id", "source_name", "source_type", "hdfs_raw_path", "file_format", "delimiter",
    "has_header", "date_column", "date_format", "primary_key_column", "target_table",
    "hdfs_silver_path", "hdfs_rejected_path", "dq_rules_json", "column_mapping_json",
    "is_active", "created_by", "schema_version", "file_pattern", "source_timezone", "source_currency",
)


def config_rows(configs: tuple[SourceConfig, ...] | list[SourceConfig]) -> list[tuple]:
    return [
        (
            c.source_id, c.source_name, c.source_type, c.raw_path, c.file_format, c.delimiter,
            c.has_header, c.date_column, c.date_format, c.primary_key_column, c.target_table,
            c.silver_path, c.rejected_path, c.rules_json(), c.mapping_json(), c.is_active,
            c.created_by, c.schema_version, c.file_pattern, c.source_timezone, c.source_currency,
        )
        for c in configs
    ]


def config_frame(spark: SparkSession, configs=None, stamp: Column | None = None) -> DataFrame:
    """The ``ingestion_config`` table (B9: INSERT ... VALUES with CURRENT_TIMESTAMP)."""
    from sluice.schemas import INGESTION_CONFIG

    configs = SEED_CONFIGS if configs is None else configs
    base = [f for f in INGESTION_CONFIG.fields if f.name not in ("created_at", "last_modified_at")]
    from sluice.session import local_frame

    df = local_frame(spark, config_rows(configs), T.StructType(base))
    ts = stamp if stamp is not None else F.current_timestamp()
    return df.withColumns({"created_at": ts, "last_modified_at": ts}).select(
        *[f.name for f in INGESTION_CONFIG.fields]
    )


def active_configs(config_df: DataFrame) -> list[SourceConfig]:
    """A8 + driver view: collect the active config rows (one per source)."""
    rows = config_df.filter(F.col("is_active")).collect()
    return [SourceConfig.from_row(r.asDict()) for r in rows]


def rules_frame(config_df: DataFrame) -> DataFrame:
    """One row per (source, rule)."""
    return config_df.select(
        "source_id",
        F.inline(F.from_json("dq_rules_json", RULES_SCHEMA)),
    )


def mapping_frame(config_df: DataFrame) -> DataFrame:
    """One row per (source, raw column, silver column)."""
    return config_df.select(
        "source_id",
        F.explode(F.from_json("column_mapping_json", MAPPING_SCHEMA)).alias("raw_column", "silver_column"),
    )


def has_rule(config_df: DataFrame, rule_id: str) -> DataFrame:
    """Does each source's rule list contain ``rule_id``."""
    return config_df.select(
        "source_id",
        F.exists(F.from_json("dq_rules_json", RULES_SCHEMA), lambda r: r["rule_id"] == F.lit(rule_id)).alias("has_rule"),
    )


def validate_configs(config_df: DataFrame) -> DataFrame:
    """One row per config problem ``(source_id, rule_id, problem)``.

    Checks: known rule type; ``expression`` present for range/regex/custom;
    ``values`` present for allowed_values; threshold in [0, 1]; rule column
    among the mapping targets; rule ids unique within a source.
    """
    rules = config_df.select(
        "source_id",
        F.from_json("column_mapping_json", MAPPING_SCHEMA).alias("m"),
        F.posexplode(F.from_json("dq_rules_json", RULES_SCHEMA)).alias("pos", "r"),
    )
    r = F.col("r")
    checks = [
        (~r["type"].isin(*RULE_TYPES) | r["type"].isNull(), F.concat(F.lit("unknown rule type: "), F.coalesce(r["type"], F.lit("null")))),
        (r["type"].isin("range", "regex", "custom") & (r["expression"].isNull() | (F.trim(r["expression"]) == "")), F.lit("expression missing")),
        ((r["type"] == "allowed_values") & (r["values"].isNull() | (F.size(r["values"]) == 0)), F.lit("values missing")),
        (r["threshold"].isNull() | (r["threshold"] < 0) | (r["threshold"] > 1), F.lit("threshold outside [0, 1]")),
        (~F.array_contains(F.map_values("m"), r["column"]) | r["column"].isNull(), F.concat(F.lit("column not mapped: "), F.coalesce(r["column"], F.lit("null")))),
    ]
    problems = F.array_compact(F.array(*[F.when(cond, msg) for cond, msg in checks]))
    per_rule = rules.select("source_id", r["rule_id"].alias("rule_id"), F.explode(problems).alias("problem"))
    dup_ids = (
        rules.groupBy("source_id", r["rule_id"].alias("rule_id"))
        .count()
        .filter("count > 1")
        .select("source_id", "rule_id", F.lit("duplicate rule id").alias("problem"))
    )
    return per_rule.unionByName(dup_ids)
