"""Driver queries that go through files: landing feeds, a full ingestion run,
the silver / rejected / audit tables it writes, and the catalog over them.

Test tables are written as raw feeds under the shared work folder
(``spark.checkpoint.dir``), then read back through the engine.  One
ingestion run over the orders feed is shared by the queries that inspect its
outputs (cached per Spark application and data directory).
"""

from __future__ import annotations

import datetime as dt
import threading
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice import schemas
from sluice.config import SourceConfig
from sluice.plans.ingest import Layout, run_source
from sluice.plans.standins import (
    ORDER_RULES, ORDERS_MAP, query, rates_frame, standin_config_frame, table,
)
from sluice.session import local_frame, scratch_path
from sluice.sources.tables import read_table

RUN_DATE = "2024-01-01"
RUN_ID = "run-standin-0001"
RUN_STAMP = dt.datetime(2024, 1, 1, 6, 0, 0)
_RUNS: dict[tuple[str, str], tuple] = {}
_RUNS_LOCK = threading.Lock()


def orders_csv_config(root: str) -> SourceConfig:
    return SourceConfig(
        source_id="src_orders_csv",
        source_name="Orders feed (CSV)",
        source_type="card_transactions",
        raw_path=root + "/raw/orders/processing_date={YYYY-MM-DD}/",
        file_format="csv",
        delimiter=",",
        has_header=True,
        date_column="o_orderdate",
        date_format="yyyy-MM-dd HH:mm:ss",
        primary_key_column="o_orderkey",
        target_table="card_transactions_silver",
        silver_path=root + "/silver/card_transactions/",
        rejected_path=root + "/rejected/orders/",
        rules=ORDER_RULES,
        column_mapping=tuple(ORDERS_MAP.items()),
        source_currency="INR",
    )


def write_orders_feed(spark: SparkSession, sf_dir: str, raw_dir: str) -> None:
    o = table(spark, sf_dir, "orders")
    o.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_custkey").cast("string").alias("o_custkey"),
        F.col("o_orderstatus"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
        F.col("o_orderpriority"),
    ).write.option("header", "true").csv(raw_dir)


def orders_run(spark: SparkSession, sf_dir: str):
    """Land orders as a CSV feed and ingest it once (shared by several queries)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    with _RUNS_LOCK:
        return _orders_run_locked(spark, sf_dir, key)


def _orders_run_locked(spark: SparkSession, sf_dir: str, key: tuple[str, str]):
    if key not in _RUNS:
        root = scratch_path(spark, "runs")
        cfg = orders_csv_config(root)
        write_orders_feed(spark, sf_dir, cfg.raw_path_for(RUN_DATE))
        layout = Layout(root)
        res = run_source(spark, cfg, RUN_DATE, layout, run_id=RUN_ID, rates=rates_frame(spark), now=RUN_STAMP)
        _RUNS[key] = (root, cfg, layout, res)
    return _RUNS[key]


@query
def rejected_sink(spark, sf_dir):
    """B2 + E14: rejected rows kept as raw text with their reasons."""
    _, cfg, _, _ = orders_run(spark, sf_dir)
    rej = spark.read.parquet(cfg.rejected_path)
    return rej.select("o_orderkey", "o_orderstatus", F.array_join("failed_rules", ",").alias("failed_rules"), "run_id")


@query
def silver_write(spark, sf_dir):
    """B1 + C4 + C7 + C8 + C9: the silver partition written by the run."""
    _, cfg, _, _ = orders_run(spark, sf_dir)
    s = read_table(spark, cfg.silver_path, schemas.CARD_TRANSACTIONS_SILVER,
                   {"processing_date": RUN_DATE, "source_id": cfg.source_id})
    return s.select(
        "transaction_id", "card_identifier", "amount_usd", "original_amount", "source_currency", "status",
        F.col("transaction_ts").cast("timestamp_ntz").alias("transaction_ts"), "dq_passed", "run_id",
        F.col("ingested_at").cast("timestamp_ntz").alias("ingested_at"), "processing_date", "source_id",
    )


@query
def run_results(spark, sf_dir):
    """B4 + E7 + E8 + E10: dq_results rows appended by the run."""
    _, _, layout, _ = orders_run(spark, sf_dir)
    r = read_table(spark, layout.dq_results, schemas.DQ_RESULTS, {"processing_date": RUN_DATE})
    return r.select(
        "run_id", "source_id", "rule_id", "rule_type", "rule_expression", "column_name", "total_rows",
        "passed_rows", "failed_rows", F.round("pass_rate", 4).alias("pass_rate"), "threshold", "rule_passed",
        (F.col("sample_failures").isNotNull()).alias("has_samples"),
    )


@query
def run_summary(spark, sf_dir):
    """E11 + E12 + E13: the dq_summary row of the run."""
    _, _, layout, _ = orders_run(spark, sf_dir)
    s = read_table(spark, layout.dq_summary, schemas.DQ_SUMMARY)
    return s.select(
        "run_id", "source_id", "processing_date", "total_rows_ingested", "total_rows_passed", "total_rows_rejected",
        F.round("overall_pass_rate", 4).alias("overall_pass_rate"), "rules_checked", "rules_passed", "rules_failed",
        "ingestion_status", (F.col("duration_seconds") >= 0).alias("timed"),
    )


@query
def lineage_row(spark, sf_dir):
    """G1-G4 + D4: the lineage row, reconciled and verified against the partition."""
    from sluice.operators.lineage import partition_count

    _, cfg, layout, _ = orders_run(spark, sf_dir)
    lin = read_table(spark, layout.lineage, schemas.PIPELINE_LINEAGE)
    silver = read_table(spark, cfg.silver_path, schemas.CARD_TRANSACTIONS_SILVER)
    found = partition_count(silver, RUN_DATE, cfg.source_id).withColumn("source_id", F.lit(cfg.source_id))
    return lin.join(found, "source_id").select(
        "run_id", "source_id", "target_table", "rows_read", "rows_written", "rows_rejected", "status",
        "transformation_log",
        (F.col("rows_read") - F.col("rows_written") - F.col("rows_rejected")).alias("unaccounted"), "rows_found",
        F.col("target_path").endswith(f"processing_date={RUN_DATE}/source_id={cfg.source_id}").alias("exact_partition"),
        F.regexp_extract("source_path", "(raw/.*)$", 1).alias("source_folder"),
    )


@query
def catalog_objects(spark, sf_dir):
    """B5-B7 + B11: managed config table and external tables over the run's output."""
    from sluice.plans.catalog import create_all, drop_database, list_tables, refresh_partitions, table_type

    _, cfg, layout, _ = orders_run(spark, sf_dir)
    db = "sluice_" + uuid.uuid4().hex[:12]
    create_all(spark, db, Layout(layout.root), location=scratch_path(spark, "catalog", db))
    standin_config_frame(spark).write.insertInto(f"{db}.ingestion_config")
    rows = []
    for name in sorted(r["tableName"] for r in list_tables(spark, db).collect()):
        refresh_partitions(spark, db, name)
        rows.append((name, table_type(spark, db, name), spark.table(f"{db}.{name}").count()))
    drop_database(spark, db)
    return local_frame(spark, rows, "table_name string, table_type string, rows bigint")


@query
def expectations(spark, sf_dir):
    """J1 + J2: set-up checks on the config table and invariants of the run."""
    from sluice.plans.catalog import create_all, drop_database
    from sluice.plans.checks import catalog_checks, check_row, config_checks, expectations as union

    _, cfg, layout, _ = orders_run(spark, sf_dir)
    db = "sluice_" + uuid.uuid4().hex[:12]
    create_all(spark, db, Layout(layout.root), location=scratch_path(spark, "catalog", db))
    kinds = catalog_checks(spark, db)
    kinds = [local_frame(spark, k.collect(), k.schema) for k in kinds]  # evaluated before the drop
    drop_database(spark, db)
    conf = standin_config_frame(spark)
    silver = read_table(spark, cfg.silver_path, schemas.CARD_TRANSACTIONS_SILVER, {"source_id": cfg.source_id})
    rejected = spark.read.parquet(cfg.rejected_path)
    raw = spark.read.option("header", "true").csv(cfg.raw_path_for(RUN_DATE))
    lin = read_table(spark, layout.lineage, schemas.PIPELINE_LINEAGE)
    from sluice.config import validate_configs

    checks = kinds + config_checks(conf, 3, "src_orders", "q003", "src_orders") + [
        check_row(validate_configs(conf).agg(F.count(F.lit(1)).alias("n")), "config_problems", "0", F.col("n")),
        check_row(silver.agg((F.count(F.lit(1)) == F.count_distinct("transaction_id")).alias("u")),
                  "silver_key_unique", "true", F.col("u")),
        check_row(lin.agg(F.count_if(F.col("rows_read") != F.col("rows_written") + F.col("rows_rejected")).alias("n")),
                  "lineage_reconciled", "0", F.col("n")),
        check_row(raw.select("o_orderkey").exceptAll(
            silver.select(F.col("transaction_id").alias("o_orderkey")).unionAll(rejected.select("o_orderkey"))
        ).agg(F.count(F.lit(1)).alias("n")), "silver_union_rejected_is_raw", "0", F.col("n")),
    ]
    return union(checks)


# ---------------------------------------------------------------------------
# Scans over landed files
# ---------------------------------------------------------------------------
@query
def csv_scan(spark, sf_dir):
    """A1 + A3 + C3: two feeds in one directory, routed by header, typed."""
    from sluice.operators.mapping import CAST_FAILURES, conform
    from sluice.sources.files import read_source

    root = scratch_path(spark, "landing")
    day_dir = f"{root}/raw/parties/processing_date={RUN_DATE}"
    table(spark, sf_dir, "customer").write.mode("append").option("header", "true").csv(day_dir)
    table(spark, sf_dir, "supplier").write.mode("append").option("header", "true").csv(day_dir)
    cfg = SourceConfig(
        source_id="src_customer_csv", source_name="Customers (CSV)", source_type="merchant",
        raw_path=root + "/raw/parties/processing_date={YYYY-MM-DD}/", file_format="csv", delimiter=",",
        has_header=True, date_column="c_custkey", date_format="", primary_key_column="c_custkey",
        target_table="merchant_silver", silver_path="", rejected_path="", rules=(),
        column_mapping=(("c_custkey", "merchant_id"), ("c_name", "business_name"), ("c_acctbal", "account_balance"),
                        ("c_mktsegment", "merchant_category")),
    )
    scan = read_source(spark, cfg, RUN_DATE)
    target = T.StructType([T.StructField("merchant_id", T.LongType()), T.StructField("business_name", T.StringType()),
                           T.StructField("account_balance", T.DoubleType()), T.StructField("merchant_category", T.StringType())])
    out = conform(scan.df, cfg.column_mapping, target)
    return out.withColumn("cast_failures", F.size(CAST_FAILURES)).drop(CAST_FAILURES)


@query
def headerless_scan(spark, sf_dir):
    """A5: headerless delimited files read with declared types."""
    from sluice.sources.files import read_headerless

    path = scratch_path(spark, "landing", "orders_headerless")
    o = table(spark, sf_dir, "orders")
    o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")) \
        .write.option("header", "false").option("sep", "|").csv(path)
    ddl = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ"
    return read_headerless(spark, path, ddl, delimiter="|")


@query
def format_scan(spark, sf_dir):
    """A4: the same feed landed as JSON and ORC, each read by format name."""
    from sluice.sources.files import read_format

    base = scratch_path(spark, "landing", "formats")
    p = table(spark, sf_dir, "part")
    p.write.json(f"{base}/json")
    p.write.option("compression", "snappy").orc(f"{base}/orc")
    schema = "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"
    j = read_format(spark, f"{base}/json", "json", schema).withColumn("file_format", F.lit("json"))
    o = read_format(spark, f"{base}/orc", "orc").withColumn("file_format", F.lit("orc"))
    return j.unionByName(o)


@query
def skip_missing(spark, sf_dir):
    """A day without a landing directory is skipped, not failed."""
    from sluice.sources.files import read_source

    root = scratch_path(spark, "landing")
    cfg = SourceConfig(
        source_id="src_events_csv", source_name="Events (CSV)", source_type="fraud_flags",
        raw_path=root + "/raw/events/processing_date={YYYY-MM-DD}/", file_format="csv", delimiter=",",
        has_header=True, date_column="ts", date_format="yyyy-MM-dd HH:mm:ss", primary_key_column="event_id",
        target_table="fraud_flags_silver", silver_path="", rejected_path="", rules=(),
        column_mapping=(("event_id", "flag_id"), ("event_type", "flag_type")),
    )
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    e.write.option("header", "true").csv(cfg.raw_path_for("2024-01-01"))
    out = None
    for day in ("2024-01-01", "2024-01-02"):
        scan = read_source(spark, cfg, day)
        if scan is None:
            part = spark.range(1).select(F.lit(day).alias("processing_date"), F.lit("SKIPPED").alias("status"),
                                         F.lit(0).cast("bigint").alias("rows"))
        else:
            part = scan.df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(day).alias("processing_date"), F.lit("READ").alias("status"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query
def landing_manifest(spark, sf_dir):
    """Files and bytes per source directory and day (bytes: no oracle)."""
    from sluice.sources.files import landing_manifest as manifest

    root = scratch_path(spark, "landing")
    for name, day in (("customer", "2024-01-01"), ("supplier", "2024-01-01"), ("customer", "2024-01-02")):
        table(spark, sf_dir, name).write.option("header", "true").csv(
            f"{root}/raw/{name}/processing_date={day}")
    return manifest(spark, f"{root}/raw")


@query
def partition_scan(spark, sf_dir):
    """A9 + A10 + B1 + B10: dynamic-partition write, then a pruned read of one day."""
    from sluice.sinks.writers import overwrite_partitions

    path = scratch_path(spark, "silver", "events")
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("flag_id"), F.col("user_id").alias("reference"), F.col("value").alias("score"),
        F.col("event_type").alias("flag_type"), F.col("ts").alias("flagged_at"),
        F.date_format("ts", "yyyy-MM-dd").alias("processing_date"), F.lit("src_events").alias("source_id"),
    )
    overwrite_partitions(e, path, ["processing_date", "source_id"])
    schema = T.StructType([
        T.StructField("flag_id", T.LongType()), T.StructField("reference", T.LongType()),
        T.StructField("score", T.DoubleType()), T.StructField("flag_type", T.StringType()),
        T.StructField("flagged_at", T.TimestampNTZType()), T.StructField("processing_date", T.StringType()),
        T.StructField("source_id", T.StringType()),
    ])
    return read_table(spark, path, schema, {"processing_date": "2024-01-15", "source_id": "src_events"},
                      ["flag_id", "flag_type", "score", "flagged_at", "processing_date"])
