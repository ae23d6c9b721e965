"""Driver queries over feeds whose files differ, file accounting, merged
profiles, raw drift and partition-scoped mutation.

Test tables are landed as raw feeds under the shared work folder; all else
runs through the engine.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice import schemas
from sluice.config import Rule, SourceConfig, config_frame
from sluice.plans.ingest import Layout, run_from_config, run_source
from sluice.plans.standin_files import RUN_DATE, RUN_ID, RUN_STAMP, orders_csv_config
from sluice.plans.standins import _round_rate, orders_feed, query, rates_frame, table
from sluice.session import scratch_path
from sluice.sources.files import read_source
from sluice.sources.tables import read_table


def _parties(root: str, fmt: str, **more) -> SourceConfig:
    return dataclasses.replace(SourceConfig(
        source_id="src_parties", source_name="Customers", source_type="merchant",
        raw_path=root + "/raw/parties/processing_date={YYYY-MM-DD}/", file_format=fmt, delimiter=",", has_header=True,
        date_column="c_mktsegment", date_format="", primary_key_column="c_custkey", target_table="merchant_silver",
        silver_path=root + "/silver/parties/", rejected_path=root + "/rejected/parties/", rules=(),
        column_mapping=(("c_custkey", "merchant_id"), ("c_name", "business_name"), ("c_mktsegment", "merchant_category")),
    ), **more)


@query
def mixed_schema_scan(spark, sf_dir):
    """A4: Parquet and ORC files of one day with other columns, other types and another order; no value is lost."""
    out = None
    for fmt in ("parquet", "orc"):
        cfg = _parties(scratch_path(spark, "landing"), fmt)
        c, day = table(spark, sf_dir, "customer"), cfg.raw_path_for(RUN_DATE)
        c.filter("c_custkey % 3 = 0").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.mode("append").format(fmt).save(day)
        c.filter("c_custkey % 3 = 1").select("c_mktsegment", F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", "c_nationkey").write.mode("append").format(fmt).save(day)
        c.filter("c_custkey % 3 = 2").select("c_nationkey", "c_custkey", F.col("c_name").alias("c_label"), "c_mktsegment").write.mode("append").format(fmt).save(day)
        rows = read_source(spark, cfg, RUN_DATE).df.select(
            F.lit(fmt).alias("file_format"), F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_label", "c_mktsegment",
            F.round(F.col("c_acctbal").cast("double"), 2).alias("c_acctbal"), F.col("c_nationkey").cast("bigint").alias("c_nationkey"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def header_versions_scan(spark, sf_dir):
    """A3: delimited files of one day, the second with its columns in another order, the third with one more."""
    cfg = _parties(scratch_path(spark, "landing"), "csv")
    c, day = table(spark, sf_dir, "customer"), cfg.raw_path_for(RUN_DATE)
    versions = (("c_custkey", "c_name", "c_mktsegment"), ("c_mktsegment", "c_custkey", "c_name"), ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
    for i, columns in enumerate(versions):
        c.filter(F.col("c_custkey") % 3 == i).select(*columns).write.mode("append").option("header", "true").csv(day)
    rows = read_source(spark, cfg, RUN_DATE).df
    return rows.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", "c_mktsegment", F.col("c_nationkey").cast("bigint").alias("c_nationkey"))


@query
def pattern_scan(spark, sf_dir):
    """A3: two JSON, two Parquet and two ORC sources in one folder each, told apart by file pattern."""
    out = None
    for fmt in ("json", "parquet", "orc"):
        root = scratch_path(spark, "landing")
        odd, even = (_parties(root, fmt, source_id=f"src_{k}", file_pattern=f"part-*{k}*") for k in ("-odd-", "-even-"))
        day = odd.raw_path_for(RUN_DATE)
        c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
        for cfg, wanted in ((odd, 1), (even, 0)):
            _land_as(c.filter(F.col("c_custkey") % 2 == wanted), fmt, day, cfg.source_id.removeprefix("src_"))
        for cfg in (odd, even):
            rows = read_source(spark, cfg, RUN_DATE).df.select(
                F.lit(fmt).alias("file_format"), F.lit(cfg.source_id).alias("source_id"), F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name")
            out = rows if out is None else out.unionByName(rows)
    return out


def _land_as(rows, fmt: str, day: str, name: str) -> None:
    """Write files whose names hold ``name``, as a source that names its files would deliver them."""
    from sluice.sources.files import hadoop_fs, list_data_files, make_dirs

    spark, staging = rows.sparkSession, scratch_path(rows.sparkSession, "landing")
    rows.write.format(fmt).save(staging)
    make_dirs(spark, day)
    fs, _ = hadoop_fs(spark, day)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for i, f in enumerate(list_data_files(spark, staging)):
        fs.rename(at(f), at(f"{day}/part-{i:05d}{name}.{fmt}"))


@query
def landing_counts(spark, sf_dir):
    """Number of landed files per source directory and day."""
    from sluice.sources.files import landing_manifest as manifest

    root = scratch_path(spark, "landing")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("processing_date"))
    for part in range(3):  # three deliveries, each with one file for a day that it has events of
        e.filter(F.col("event_id") % 3 == part).repartition("processing_date").write.mode("append").partitionBy("processing_date").csv(f"{root}/raw/events")
    return manifest(spark, f"{root}/raw").select("source_dir", "processing_date", "file_count")


@query
def file_accounting(spark, sf_dir):
    """G1 + G3: rows read, written and rejected per raw file, and the rows counted in it apart from the scan."""
    root = scratch_path(spark, "runs")
    cfg = orders_csv_config(root)
    o = table(spark, sf_dir, "orders")
    o.select(o["o_orderkey"].cast("string"), o["o_custkey"].cast("string"), "o_orderstatus", o["o_totalprice"].cast("string"),
             F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), F.col("o_orderpriority").alias("sent_as")) \
        .write.partitionBy("sent_as").option("header", "true").csv(cfg.raw_path_for(RUN_DATE))
    layout = Layout(root)
    run_source(spark, cfg, RUN_DATE, layout, RUN_ID, rates_frame(spark), RUN_STAMP, check_files=True)
    files = spark.read.parquet(layout.files)
    sums = [F.sum(c).alias(c) for c in ("rows_read", "rows_written", "rows_rejected", "rows_expected")]
    return files.groupBy(F.substring(F.regexp_extract("file", "sent_as=([^/]+)/", 1), 1, 1).alias("sent_as"), "run_id", "source_id").agg(
        *sums, F.bool_and("reconciled").alias("reconciled"), (F.min("bytes") > 0).alias("has_bytes"))


@query
def profile_merge(spark, sf_dir):
    """H1: profiles of three days, kept as states and merged, without reading a day again."""
    from sluice.operators.registry import merge_states, profile_states

    path = scratch_path(spark, "states")
    o = orders_feed(spark, sf_dir)
    days = (o["transaction_ts"] < F.lit("1994-01-01").cast("timestamp_ntz"), o["transaction_ts"] >= F.lit("1997-01-01").cast("timestamp_ntz"))
    for i, day in enumerate((days[0], ~days[0] & ~days[1], days[1])):
        profile_states(o.filter(day)).withColumn("processing_date", F.lit(f"2024-01-0{i + 1}")).write.mode("append").parquet(path)
    return _round_rate(merge_states(spark.read.parquet(path)).drop("sample_values"))


@query
def top_values(spark, sf_dir):
    """H2: the most frequent values of columns by sketches of two halves, merged (few distinct values: exact)."""
    from sluice.operators.registry import merge_states, profile_states

    path = scratch_path(spark, "states")
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey")
    for half in (0, 1):
        profile_states(o.filter(F.col("o_orderkey") % 2 == half), ["o_orderstatus", "o_orderpriority"]).write.mode("append").parquet(path)
    merged = merge_states(spark.read.parquet(path))
    values = F.array_sort(F.from_json("sample_values", "array<string>"))
    return merged.select("column_name", F.array_join(values, "|").alias("sample_values"))


@query
def raw_drift(spark, sf_dir):
    """H5: two runs of a feed whose second day has a column more, one less and one of another type."""
    from sluice.operators.registry import raw_drift as drift

    root = scratch_path(spark, "runs")
    cfg, layout = _parties(root, "csv"), Layout(root)
    c = table(spark, sf_dir, "customer")
    days = {
        "2024-01-01": c.filter("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal"),
        "2024-01-02": c.select("c_custkey", F.concat(F.lit("N"), F.col("c_nationkey")).alias("c_nationkey"), "c_name", "c_mktsegment", F.lit("web").alias("channel")),
    }
    for i, (day, rows) in enumerate(days.items()):
        rows.write.option("header", "true").csv(cfg.raw_path_for(day))
        run_source(spark, cfg, day, layout, now=RUN_STAMP.replace(day=i + 1), profile_registry=True)
    return drift(read_table(spark, layout.raw_registry, schemas.SCHEMA_REGISTRY)).select(
        "source_id", "column_name", "changes", "min_changed", "max_changed")


@query
def registry_run(spark, sf_dir):
    """H1 + H2 + H4 + J3: a plain run fills the registry; a source with an invalid config fails and is not read."""
    root = scratch_path(spark, "runs")
    good = _parties(root, "csv")
    bad = dataclasses.replace(good, source_id="src_bad", silver_path=root + "/silver/bad/", rejected_path=root + "/rejected/bad/",
                              rules=(Rule("b1", "no expression", "merchant_id", "range", 1.0),))
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", "true").csv(good.raw_path_for(RUN_DATE))
    layout = Layout(root)
    run_from_config(spark, config_frame(spark, [good, bad]), RUN_DATE, layout, RUN_ID)
    registry = read_table(spark, layout.registry, schemas.SCHEMA_REGISTRY).filter("column_name in ('merchant_id', 'business_name', 'merchant_category')")
    status = read_table(spark, layout.dq_summary, schemas.DQ_SUMMARY).select("source_id", "ingestion_status", "total_rows_ingested")
    return status.join(registry.select("source_id", "column_name", "column_type", "is_nullable", "min_value", "max_value"), "source_id", "left")


@query
def partition_rewrite(spark, sf_dir):
    """I1-I3 on a partitioned table: an update, a delete and an upsert rewrite the days they touch, and leave all other files alone."""
    from sluice.operators.mutate import delete_partitions, update_partitions, upsert_partitions
    from sluice.sinks.writers import overwrite_partitions

    path = scratch_path(spark, "silver", "days")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("processing_date"))
    overwrite_partitions(rows, path, ["processing_date"])
    schema = T.StructType([*rows.schema.fields])
    files = lambda: spark.read.schema(schema).option("basePath", path).parquet(path).select(
        "processing_date", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("t")).distinct()
    before = scratch_path(spark, "files")
    files().write.parquet(before)
    update_partitions(spark, path, schema, ["processing_date"], {"value": -1.0}, (F.col("processing_date") == "2024-01-10") & (F.col("user_id") % 2 == 0))
    delete_partitions(spark, path, schema, ["processing_date"], F.col("processing_date").isin("2024-01-11", "2024-01-12") & (F.col("event_id") % 3 == 0))
    new = rows.filter("processing_date = '2024-01-13'").withColumns({"value": F.lit(-2.0), "event_id": F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(-F.col("event_id"))})
    upsert_partitions(spark, path, schema, ["processing_date"], new, ["event_id"])
    kept = spark.read.parquet(before).join(files(), ["processing_date", "f", "t"]).groupBy("processing_date").agg(F.lit(True).alias("files_kept"))
    table_now = spark.read.schema(schema).option("basePath", path).parquet(path)
    return table_now.groupBy("processing_date").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value") == -1.0).alias("updated"), F.count_if(F.col("value") == -2.0).alias("upserted"),
        F.sum("event_id").alias("ids"),
    ).join(kept, "processing_date", "left").withColumn("files_kept", F.coalesce("files_kept", F.lit(False)))
