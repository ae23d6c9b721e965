"""Driver queries over whole runs: settings in the config table, lossless scans,
audited outcomes, the registry, live config changes, and skewed keys.
"""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice import schemas
from sluice.config import SourceConfig, config_frame
from sluice.plans.ingest import Layout, run_all, run_from_config
from sluice.plans.standin_files import RUN_DATE, RUN_ID, orders_csv_config, write_orders_feed
from sluice.plans.standins import _orders_snapshots, query, rates_frame, table
from sluice.session import scratch_path
from sluice.sources.tables import read_table


@query
def inr_from_config_table(spark, sf_dir):
    """A8 + C6 + C7: currency and time zone travel through the stored config table."""
    root = scratch_path(spark, "runs")
    cfg = orders_csv_config(root)
    write_orders_feed(spark, sf_dir, cfg.raw_path_for(RUN_DATE))
    config_frame(spark, [cfg]).write.orc(f"{root}/config")
    stored = spark.read.schema(schemas.INGESTION_CONFIG).orc(f"{root}/config")
    results = run_from_config(spark, stored, RUN_DATE, Layout(root), RUN_ID, rates_frame(spark))
    assert [r.status for r in results] != ["FAILED"], results
    silver = read_table(spark, cfg.silver_path, schemas.CARD_TRANSACTIONS_SILVER)
    return silver.select("transaction_id", "card_identifier", "amount_usd", "original_amount", "source_currency", "status",
                         F.col("transaction_ts").cast("timestamp_ntz").alias("transaction_ts"))


def _malformed_config(root: str) -> SourceConfig:
    return SourceConfig(
        source_id="src_lines", source_name="Orders with surplus fields", source_type="merchant",
        raw_path=root + "/raw/lines/processing_date={YYYY-MM-DD}/", file_format="CSV", delimiter=",", has_header=False,
        date_column="o_orderpriority", date_format="", primary_key_column="o_orderkey", target_table="merchant_silver",
        silver_path=root + "/silver/merchant/", rejected_path=root + "/rejected/lines/", rules=(),
        column_mapping=(("o_orderkey", "merchant_id"), ("o_custkey", "business_name"), ("o_orderstatus", "merchant_category"),
                        ("o_orderpriority", "city")),
    )


def _land_lines(spark, sf_dir, cfg) -> None:
    fields = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    line = F.concat_ws(",", *fields, F.when(F.col("o_orderkey") % 7 == 0, F.lit("surplus")))
    table(spark, sf_dir, "orders").select(line.alias("value")).write.text(cfg.raw_path_for(RUN_DATE) + "sub/folder")


@query
def malformed_scan(spark, sf_dir):
    """A1 + A3: a line with a field too many is kept whole and marked; sub-folders are read."""
    from sluice.sources.files import CORRUPT, read_source

    cfg = _malformed_config(scratch_path(spark, "landing"))
    _land_lines(spark, sf_dir, cfg)
    rows = read_source(spark, cfg, RUN_DATE).df
    return rows.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col(CORRUPT).isNotNull().alias("malformed"),
                       F.col(CORRUPT).alias("line"))


@query
def malformed_counts(spark, sf_dir):
    """G1 + G2 + E14: raw rows, silver rows and rejected rows, each counted where it lies."""
    root = scratch_path(spark, "runs")
    cfg = _malformed_config(root)
    _land_lines(spark, sf_dir, cfg)
    run_all(spark, [cfg], RUN_DATE, Layout(root), RUN_ID)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    raw = count(spark.read.option("recursiveFileLookup", "true").text(cfg.raw_path_for(RUN_DATE)), "raw_rows")
    silver = count(read_table(spark, cfg.silver_path, schemas.MERCHANT_SILVER), "silver_rows")
    rejected = spark.read.parquet(cfg.rejected_path).agg(
        F.count(F.lit(1)).alias("rejected_rows"), F.count_if(F.array_contains("failed_rules", "raw:malformed")).alias("malformed_rows"))
    on = F.lit(1).alias("k")
    return raw.select(on, "*").join(silver.select(on, "*"), "k").join(rejected.select(on, "*"), "k").drop("k")


@query
def drifted_file(spark, sf_dir):
    """A3: a file whose header no source knows is found, not left out in silence."""
    from sluice.sources.files import read_source, unclaimed_files

    root = scratch_path(spark, "landing")
    cfg = dataclasses.replace(
        _malformed_config(root), raw_path=root + "/raw/parties/processing_date={YYYY-MM-DD}/", has_header=True,
        column_mapping=(("c_custkey", "merchant_id"), ("c_name", "business_name")))
    day = cfg.raw_path_for(RUN_DATE)
    for name in ("customer", "supplier"):
        table(spark, sf_dir, name).write.mode("append").option("header", "true").csv(day)
    left = spark.read.option("header", "true").csv(unclaimed_files(spark, [cfg], day))
    kinds = {"claimed": read_source(spark, cfg, RUN_DATE).df, "unclaimed": left}
    rows = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(kind).alias("kind"), "rows") for kind, df in kinds.items()]
    return rows[0].unionByName(rows[1])


@query
def failed_source_summary(spark, sf_dir):
    """E12 + A6: sources that fail or have no files get their dq_summary row."""
    root = scratch_path(spark, "runs")
    good = orders_csv_config(root)
    write_orders_feed(spark, sf_dir, good.raw_path_for(RUN_DATE))
    other = {"silver_path": root + "/silver/other/", "rejected_path": root + "/rejected/other/"}
    no_rate = dataclasses.replace(good, source_id="src_no_rate", source_currency="XTS", **other)
    no_files = dataclasses.replace(good, source_id="src_no_files", raw_path=root + "/raw/none/processing_date={YYYY-MM-DD}/", **other)
    run_all(spark, [good, no_rate, no_files], RUN_DATE, Layout(root), RUN_ID, rates_frame(spark))
    summary = read_table(spark, Layout(root).dq_summary, schemas.DQ_SUMMARY)
    return summary.select("source_id", "ingestion_status", F.col("total_rows_ingested").alias("rows"))


def _registry(spark, sf_dir):
    """Two runs' snapshots appended to the registry table and read back."""
    from sluice.sinks.writers import append

    path = scratch_path(spark, "registry")
    for version, snapshot in enumerate(_orders_snapshots(spark, sf_dir), start=1):
        rows = snapshot.withColumns({
            "source_id": F.lit("src_orders"), "source_id_part": F.lit("src_orders"), "sample_values": F.lit(None).cast("string"),
            "schema_version": F.lit(version), "analysed_at": F.to_timestamp(F.lit(f"2024-01-0{version} 00:00:00"))})
        append(rows.select(*[f.name for f in schemas.SCHEMA_REGISTRY.fields]), path, schemas.PARTITIONS["schema_registry"])
    return read_table(spark, path, schemas.SCHEMA_REGISTRY)


@query
def registry_append(spark, sf_dir):
    """H1 + H4: snapshots of two versions, appended and read back."""
    return _registry(spark, sf_dir).select(
        "source_id", "schema_version", "column_name", "column_type", "is_nullable", F.round("null_rate", 4).alias("null_rate"),
        "min_value", "max_value")


@query
def drift_from_registry(spark, sf_dir):
    """H5 + H6: the newest two versions in the registry compared."""
    from sluice.operators.registry import drift_from_registry as drift

    return drift(_registry(spark, sf_dir)).withColumn("null_rate_delta", F.round("null_rate_delta", 4))


def _hot_lines(spark, sf_dir):
    hot = F.col("l_partkey") % 3 == 0
    return table(spark, sf_dir, "lineitem").select(
        F.when(hot, F.lit(1)).otherwise(F.col("l_orderkey")).cast("bigint").alias("withdrawal_id"),
        F.when(hot, F.lit(1)).otherwise(F.col("l_linenumber")).cast("bigint").alias("line_no"), "l_shipdate", "l_partkey", "l_suppkey")


@query
def skew_dedup(spark, sf_dir):
    """F1 with one key holding a third of all rows: the winners, and how many copies each had."""
    from sluice.operators.dedup import DUP_FLAG, flag_duplicates, with_row_id

    keys = ["withdrawal_id", "line_no"]
    flagged = flag_duplicates(with_row_id(_hot_lines(spark, sf_dir)), keys, ["l_shipdate", "l_partkey", "l_suppkey"])
    return flagged.groupBy(*keys).agg(F.max(F.when(~F.col(DUP_FLAG), F.col("l_shipdate"))).alias("withdrawal_ts"), F.count(F.lit(1)).alias("copies"))


@query
def skew_fk_join(spark, sf_dir):
    """F4 as a full join with one key holding a third of all rows, and rows without a partner on both sides."""
    from sluice.operators.relate import fk_join

    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != "P")
    joined = fk_join(_hot_lines(spark, sf_dir), orders, "withdrawal_id", "o_orderkey", "full")
    return joined.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("l_partkey").alias("parts"), F.count("o_orderkey").alias("matched"))


@query
def fraud_join(spark, sf_dir):
    """F4-F6 on stored silver tables, flag and transaction of the same source pair and day."""
    from sluice.operators.relate import silver_flags_with_transactions
    from sluice.sinks.writers import overwrite_partitions

    root = scratch_path(spark, "silver")
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("flag_id"), F.col("user_id").cast("string").alias("transaction_ref"),
        F.date_format("ts", "yyyy-MM-dd").alias("processing_date"))
    flags = events.withColumn("source_id", F.lit("src_flags"))
    # the same transaction ids are delivered every day
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("transaction_id"), F.col("o_orderstatus").alias("status"))
    wanted = events.select("processing_date", F.col("transaction_ref").alias("transaction_id")).distinct()
    cards = wanted.join(orders, "transaction_id").withColumn("source_id", F.lit("src_cards"))
    overwrite_partitions(flags, f"{root}/flags", ["processing_date", "source_id"])
    overwrite_partitions(cards.select("transaction_id", "status", "processing_date", "source_id"), f"{root}/cards", ["processing_date", "source_id"])
    joined = silver_flags_with_transactions(spark.read.parquet(f"{root}/flags"), spark.read.parquet(f"{root}/cards"))
    return joined.select("processing_date", F.col("flag_id").cast("bigint").alias("flag_id"),
                         F.col("transaction_id").cast("bigint").alias("transaction_id"), "status")


def _customer_configs(spark, sf_dir):
    """A config table with a row per customer."""
    c = table(spark, sf_dir, "customer")
    given = {"source_id": F.col("c_custkey").cast("string"), "source_type": F.col("c_mktsegment"), "is_active": F.col("c_acctbal") >= 0,
             "dq_rules_json": F.lit("[]"), "column_mapping_json": F.lit("{}"), "schema_version": F.lit(1),
             "created_at": F.to_timestamp(F.lit("2024-01-01 00:00:00")), "last_modified_at": F.to_timestamp(F.lit("2024-01-01 00:00:00"))}
    return c.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.INGESTION_CONFIG.fields])


@query
def config_mutation(spark, sf_dir):
    """I1-I3 + H7 on a live catalog table: insert, merge, delete, each state read back."""
    from sluice.operators.mutate import delete_rows, merge_configs, rewrite_table

    db = "sluice_" + uuid.uuid4().hex[:12]
    name = f"{db}.ingestion_config"
    spark.sql(f"CREATE DATABASE {db} LOCATION '{scratch_path(spark, 'catalog', db)}'")
    _customer_configs(spark, sf_dir).write.format("orc").saveAsTable(name)
    states = scratch_path(spark, "states")

    def keep(state: int) -> None:
        spark.table(name).select(
            F.lit(state).alias("state"), F.col("source_id").cast("bigint").alias("source_id"), "is_active", "schema_version",
            (F.col("last_modified_at") > F.to_timestamp(F.lit("2024-01-01 00:00:00"))).alias("modified")).write.mode("append").parquet(states)

    def change(stored):
        segment = F.col("source_type")
        incoming = stored.withColumns({
            "is_active": F.col("is_active") & (segment != "BUILDING"),
            "dq_rules_json": F.when(segment == "MACHINERY", F.lit("[ ]")).otherwise(F.col("dq_rules_json"))})
        return merge_configs(stored, incoming)

    keep(1)
    rewrite_table(spark, name, change)
    keep(2)
    rewrite_table(spark, name, lambda stored: delete_rows(stored, F.col("source_type") == "FURNITURE"))
    keep(3)
    spark.sql(f"DROP DATABASE {db} CASCADE")
    return spark.read.parquet(states)


@query
def seed_listing(spark, sf_dir):
    """The configs in the order of the listing."""
    from sluice.plans.checks import seed_listing as listing

    path = scratch_path(spark, "listing")
    configs = _customer_configs(spark, sf_dir).withColumn("source_id", F.lpad("source_id", 12, "0"))
    listing(configs).write.parquet(path)  # sorted globally: file by file, and row by row in each
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i"))
    ahead = Window.orderBy("f").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = rows.groupBy("f").agg(F.count(F.lit(1)).alias("n")).select("f", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    nth = F.col("before") + F.col("i") + 1
    return rows.join(files, "f").select(nth.alias("nth"), F.col("source_id").cast("bigint").alias("source_id"), "source_type", "is_active")


@query
def config_problems(spark, sf_dir):
    """A config per part, each with one planted problem or two, all of them found."""
    from sluice.config import validate_configs

    rule = lambda **kw: F.struct(*[F.lit(kw.get(k, d)).alias(k) for k, d in (
        ("rule_id", "r1"), ("rule_name", "n"), ("column", "a"), ("type", "not_null"))] + [
        (F.lit(kw["expression"]) if "expression" in kw else F.lit(None).cast("string")).alias("expression"),
        F.lit(None).cast("array<string>").alias("values"), F.lit(kw.get("threshold", 1.0)).cast("double").alias("threshold")])
    kinds = [F.array(rule(type="odd", threshold=2.0)), F.array(rule(type="range")), F.array(rule(type="allowed_values")),
             F.array(rule(threshold=-0.5)), F.array(rule(column="nowhere")), F.array(rule(), rule())]
    which = F.col("p_partkey") % 6
    rules = F.when(which == 0, kinds[0])
    for i, kind in enumerate(kinds[1:], start=1):
        rules = rules.when(which == i, kind)
    configs = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("source_id"), F.to_json(rules).alias("dq_rules_json"), F.lit('{"x": "a"}').alias("column_mapping_json"))
    found = validate_configs(configs)
    return found.groupBy(F.col("source_id").cast("bigint").alias("source_id"), "problem").agg(F.count(F.lit(1)).alias("rows"))


@query
def landing_files(spark, sf_dir):
    """Bytes per source directory and day, of files whose text is known."""
    from sluice.sources.files import landing_manifest as manifest

    root = scratch_path(spark, "landing")
    feeds = (("customer", "2024-01-01", "c_custkey", "c_name"), ("customer", "2024-01-02", "c_custkey", "c_mktsegment"), ("supplier", "2024-01-01", "s_suppkey", "s_name"))
    for name, day, key, text in feeds:
        table(spark, sf_dir, name).select(F.concat_ws(",", F.col(key).cast("string"), text).alias("value")).write.text(f"{root}/raw/{name}/processing_date={day}")
    return manifest(spark, f"{root}/raw").select("source_dir", "processing_date", "total_bytes")


@query
def scanned_files(spark, sf_dir):
    """The raw files behind a scan, told by the file source's metadata column."""
    from sluice.operators.lineage import source_files

    path = scratch_path(spark, "landing")
    c = table(spark, sf_dir, "customer").select(F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name").alias("value"), "c_mktsegment")
    c.repartition("c_mktsegment").write.partitionBy("c_mktsegment").text(path)
    scan = spark.read.option("recursiveFileLookup", "true").text(path)
    return source_files(scan).select(F.regexp_extract("source_path", "c_mktsegment=([^/]+)/", 1).alias("segment"))
