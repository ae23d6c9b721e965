"""Scans (A1-A7) and writers."""

import csv
import io
import os
import tempfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sluice.config import SEED_CONFIGS
from sluice.sinks.writers import (
    append, balanced, dealt_for, overwrite_partitions, overwrite_table_partitions, replace_partition, table_buckets,
)
from sluice.sources.files import (
    FILE, first_lines, header_groups, landing_manifest, list_data_files, read_source, route_files, try_read, unclaimed_files,
)
from tests.fixtures import IN_FEED, US_FEED, write_feed

DATE = "2026-01-01"


def _landing():
    root = tempfile.mkdtemp(prefix="sluice-src-")
    write_feed(root, "card_transactions", DATE, "us_card_transactions_2026-01-01_001.csv", US_FEED)
    write_feed(root, "card_transactions", DATE, "us_card_transactions_2026-01-01_002.csv", US_FEED)
    write_feed(root, "card_transactions", DATE, "in_card_transactions_2026-01-01_001.csv", IN_FEED)
    return root


def test_header_routing_in_shared_directory(spark):
    root = _landing()
    us, india = (c.with_root(root) for c in SEED_CONFIGS[:2])
    routed = route_files(spark, us, us.raw_path_for(DATE))
    assert len(routed.files) == 2 and routed.bytes == 2 * len(US_FEED.encode())
    assert [g.columns[0] for g in routed.groups] == ["transaction_id"]
    scan = read_source(spark, india, DATE)
    rows = scan.df.collect()
    assert len(rows) == 3 and rows[0]["upi_flag"] == "Y"  # every column read as text, nothing shifted
    assert all(isinstance(v, (str, type(None))) for r in rows for v in r)
    us_rows = read_source(spark, us, DATE).df
    assert us_rows.count() == 14 and us_rows.filter(F.col("merchant_name") == "Smith, Lee and Co").count() == 4


def test_glob_pattern_routing(spark):
    root = _landing()
    us = replace(SEED_CONFIGS[0].with_root(root), file_pattern="us_*_001.csv")
    assert read_source(spark, us, DATE).df.count() == 7


def test_headers_of_one_day_may_differ(spark):
    """A reordered and a widened header are scans of their own; a renamed column leaves the file unclaimed."""
    root = tempfile.mkdtemp(prefix="sluice-src-")
    write_feed(root, "card_transactions", DATE, "a.csv", US_FEED)
    rows = list(csv.reader(US_FEED.splitlines()))
    turned = [r[::-1] for r in rows]
    wide = [[*r, "channel" if i == 0 else "web"] for i, r in enumerate(rows)]
    for name, lines in (("b.csv", turned), ("c 1.csv", wide)):
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(lines)
        write_feed(root, "card_transactions", DATE, name, out.getvalue())
    write_feed(root, "card_transactions", DATE, "d.csv", US_FEED.replace("merchant_name", "shop", 1))
    write_feed(root, "card_transactions", DATE, "e.csv", "")
    us = SEED_CONFIGS[0].with_root(root)
    headers = {}
    routed = route_files(spark, us, us.raw_path_for(DATE), headers)
    assert [len(g.files) for g in routed.groups] == [1, 1, 1] and len(headers) == 1
    df = read_source(spark, us, DATE, headers).df
    per_row = df.groupBy(*rows[0]).count().collect()
    assert len(per_row) == 7 and {r["count"] for r in per_row} == {3}  # each row once per file, nothing shifted
    assert df.filter("channel = 'web'").count() == 7
    left = unclaimed_files(spark, [us], us.raw_path_for(DATE), headers)
    assert sorted(f.rsplit("/", 1)[-1] for f in left) == ["d.csv", "e.csv"]


def test_header_scan_reads_no_file_whole(spark):
    root = tempfile.mkdtemp(prefix="sluice-src-")
    for i in range(3):
        write_feed(root, "x", DATE, f"{i}.csv", "\ufeffa,b\n" + "1,2\n" * 400_000)
    path = f"{root}/raw/x/processing_date={DATE}"
    files = [f for f in list_data_files(spark, path)]
    lines = first_lines(spark, files)
    assert lines.rdd.getNumPartitions() == 3  # a task a file
    assert [g.columns for g in header_groups(spark, files, ",")] == [("a", "b")]


def test_a_pattern_claims_files_and_wants_its_columns(spark):
    root = _landing()
    us = replace(SEED_CONFIGS[0].with_root(root), file_pattern="in_*.csv")
    with pytest.raises(ValueError, match="lacks"):
        read_source(spark, us, DATE)
    day = tempfile.mkdtemp(prefix="sluice-src-")
    for fmt, write in (("parquet", lambda df, p: df.write.parquet(p)), ("orc", lambda df, p: df.write.orc(p)), ("json", lambda df, p: df.write.json(p))):
        cfg = replace(SEED_CONFIGS[0], raw_path=f"{day}/{fmt}/processing_date={{YYYY-MM-DD}}/", file_format=fmt, column_mapping=(("k", "transaction_id"),))
        write(spark.range(5).selectExpr("cast(id as string) k").coalesce(1), cfg.raw_path_for(DATE))
        name = next(n for n in os.listdir(cfg.raw_path_for(DATE)) if n.startswith("part-"))
        os.rename(os.path.join(cfg.raw_path_for(DATE), name), os.path.join(cfg.raw_path_for(DATE), f"us_1.{fmt}"))
        assert read_source(spark, replace(cfg, file_pattern="us_*"), DATE).df.count() == 5
        assert read_source(spark, replace(cfg, file_pattern="in_*"), DATE) is None
        assert unclaimed_files(spark, [replace(cfg, file_pattern="in_*")], cfg.raw_path_for(DATE))


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_files_with_other_columns_and_types(spark, fmt):
    root = tempfile.mkdtemp(prefix="sluice-src-")
    cfg = replace(SEED_CONFIGS[0], raw_path=root + "/processing_date={YYYY-MM-DD}/", file_format=fmt, column_mapping=(("k", "transaction_id"), ("merchant_name", "merchant_name")))
    day = cfg.raw_path_for(DATE)
    for sql in ("1L k, 'a' merchant_name", "2L k, 'b' shop, 7 more", "'x3' k, 'c' merchant_name", "4L k, 'd' merchant_name, 'text' more"):
        spark.sql(f"select {sql}").write.mode("append").format(fmt).save(day)
    scan = read_source(spark, cfg, DATE)
    assert len(scan.parts) <= 3
    rows = {r.k: (r.merchant_name, r.shop, r.more) for r in scan.df.collect()}
    assert rows == {"1": ("a", None, None), "2": (None, "b", "7"), "x3": ("c", None, None), "4": ("d", None, "text")}
    assert scan.tracked.select(FILE).distinct().count() == 4


def test_missing_day_and_missing_path(spark):
    root = _landing()
    assert read_source(spark, SEED_CONFIGS[0].with_root(root), "1999-01-01") is None
    assert try_read(spark, os.path.join(root, "nope"), "parquet") is None


def test_json_and_parquet_sources(spark):
    root = tempfile.mkdtemp(prefix="sluice-src-")
    us = SEED_CONFIGS[0].with_root(root)
    df = spark.createDataFrame([("U1", "4000", "Acme", "10.5", "2026-01-01 10:00:00", "APPROVED", "0")],
                               "transaction_id string, card_number string, merchant_name string, amount_usd string, "
                               "transaction_time string, status string, is_international string")
    df.write.json(us.raw_path_for(DATE))
    got = read_source(spark, replace(us, file_format="json"), DATE).df.first()
    assert got["amount_usd"] == "10.5"
    pq = replace(us, raw_path=root + "/pq/processing_date={YYYY-MM-DD}/", file_format="parquet")
    df.withColumn("amount_usd", F.col("amount_usd").cast("double")).write.parquet(pq.raw_path_for(DATE))
    assert read_source(spark, pq, DATE).df.first()["amount_usd"] == "10.5"


def test_manifest_counts_files_and_bytes(spark):
    root = _landing()
    m = landing_manifest(spark, os.path.join(root, "raw")).first()
    assert (m.source_dir, m.processing_date, m.file_count) == ("card_transactions", DATE, 3)
    assert m.total_bytes == 2 * len(US_FEED.encode()) + len(IN_FEED.encode())


def test_dynamic_overwrite_and_empty_rerun(spark):
    path = tempfile.mkdtemp(prefix="sluice-sink-") + "/t"
    a = spark.createDataFrame([(1, "d1", "s"), (2, "d2", "s")], "v int, processing_date string, source_id string")
    overwrite_partitions(a, path, ["processing_date", "source_id"])
    b = spark.createDataFrame([(3, "d1", "s")], "v int, processing_date string, source_id string")
    overwrite_partitions(b, path, ["processing_date", "source_id"])
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [2, 3]  # d2 untouched
    empty = b.filter("false")
    replace_partition(empty, path, ["processing_date", "source_id"], {"processing_date": "d1", "source_id": "s"}, 0)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [2]
    append(b, path + "_audit", ["processing_date"])
    append(b, path + "_audit", ["processing_date"])
    assert spark.read.parquet(path + "_audit").count() == 2


def test_shuffle_sizing_grows_with_the_input_and_is_restored(spark):
    from sluice.session import SHUFFLE_SETTING, sized_shuffles

    before = spark.conf.get(SHUFFLE_SETTING, None)
    with sized_shuffles(spark, 1024):
        assert spark.conf.get(SHUFFLE_SETTING, None) == before  # small input: unchanged
    with sized_shuffles(spark, 100 * 1024**4):
        assert spark.conf.get(SHUFFLE_SETTING) == str(100 * 1024**4 // (128 * 1024**2))
        with sized_shuffles(spark, 1024):
            assert spark.conf.get(SHUFFLE_SETTING) == "819200"  # never lowered
        assert spark.conf.get(SHUFFLE_SETTING) == "819200"
    assert spark.conf.get(SHUFFLE_SETTING, None) == before

def test_lineage_helpers_and_insert_values(spark):
    from sluice.operators.lineage import row_counts, source_files, unreconciled
    from sluice.operators.relate import count_where
    from sluice.sinks.writers import insert_values

    root = _landing()
    scan = read_source(spark, SEED_CONFIGS[0].with_root(root), DATE)
    files = {r.source_path for r in source_files(scan.df).collect()}
    assert len(files) == 2 and all("us_card_transactions" in f for f in files)  # G3: distinct raw files
    assert count_where(scan.df, F.col("status") == "APPROVED").first().n == 6  # F8
    lin = spark.createDataFrame([(7, 1, 6), (5, 2, 2)], "rows_read long, rows_written long, rows_rejected long")
    assert [r.rows_read for r in unreconciled(lin).collect()] == [5]  # G2
    v = spark.createDataFrame([(["r1"],), ([],)], "failed_rules array<string>")
    r = row_counts(v).first()
    assert (r.rows_read, r.rows_written, r.rows_rejected, r.reconciled) == (2, 1, 1, True)
    spark.sql("CREATE DATABASE IF NOT EXISTS sluice_iv")
    spark.sql("CREATE TABLE IF NOT EXISTS sluice_iv.t (k int, v string) USING parquet")
    insert_values(spark, "sluice_iv.t", [(1, "a"), (2, None)], "k int, v string")  # B9
    assert spark.table("sluice_iv.t").count() == 2
    spark.sql("DROP DATABASE sluice_iv CASCADE")


def _tasks_reading(spark, plan_df, write):
    """Tasks of the stages of a write, by what the status tracker saw of its job group."""
    group = f"g{id(plan_df)}"
    spark.sparkContext.setJobGroup(group, "write")
    write(plan_df)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return sorted(i.numTasks for i in map(tracker.getStageInfo, stages) if i)


def test_a_few_rows_are_written_by_all_tasks_of_the_scan(spark):
    """A write deals rows by a rebalance: the scan before it keeps its tasks, and few files come out."""
    path = tempfile.mkdtemp(prefix="sluice-sink-") + "/t"
    rows = spark.range(0, 200_000, numPartitions=11).withColumns({"p": F.lit("d"), "pad": F.sha2(F.col("id").cast("string"), 256)})
    one = balanced(rows.filter("id = 77777"), ["p"])
    assert "REBALANCE_PARTITIONS_BY_COL" in one._jdf.queryExecution().executedPlan().toString()
    tasks = _tasks_reading(spark, one, lambda df: overwrite_partitions(df, path, ["p"]))
    assert 11 in tasks
    assert len(list_data_files(spark, path)) == 1 and spark.read.parquet(path).count() == 1


def test_a_hot_partition_is_split_into_files(spark):
    path = tempfile.mkdtemp(prefix="sluice-sink-") + "/t"
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "1m")
    try:
        rows = spark.range(0, 200_000, numPartitions=11).withColumns({"p": F.when(F.col("id") % 50 == 0, F.lit("cold")).otherwise(F.lit("hot")), "pad": F.sha2(F.col("id").cast("string"), 512)})
        overwrite_partitions(balanced(rows, ["p"]), path, ["p"])
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    files = list_data_files(spark, path)
    assert sum("p=hot" in f for f in files) > 3 and sum("p=cold" in f for f in files) <= 2
    assert spark.read.parquet(path).count() == 200_000


def test_bucketed_write_has_a_file_per_bucket(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS sluice_bk")
    spark.sql("CREATE TABLE sluice_bk.t (k bigint, v string, d string) USING parquet PARTITIONED BY (d) CLUSTERED BY (k) INTO 8 BUCKETS")
    try:
        assert table_buckets(spark, "sluice_bk.t") == (8, ["k"])
        rows = spark.range(0, 10_000, numPartitions=50).selectExpr("id k", "cast(id as string) v", "'x' d")
        overwrite_table_partitions(dealt_for(rows, ["d"], 1.0, "sluice_bk.t"), "sluice_bk.t")
        files = {r[0] for r in spark.table("sluice_bk.t").select("_metadata.file_path").distinct().collect()}
        assert len(files) == 8 and spark.table("sluice_bk.t").count() == 10_000
        spark.sql("CREATE TABLE sluice_bk.plain (k bigint, d string) USING parquet PARTITIONED BY (d)")
        assert table_buckets(spark, "sluice_bk.plain") is None
        plans = [dealt_for(rows, ["d"], share, "sluice_bk.plain")._jdf.queryExecution().executedPlan().toString() for share in (0.9, 0.1)]
        assert "Exchange" not in plans[0] and "REBALANCE" in plans[1]  # most rows stay where they are, few are dealt anew
    finally:
        spark.sql("DROP DATABASE sluice_bk CASCADE")
