"""End-to-end ingestion of literal feeds (FIXTURES.md section 4)."""

import os
import tempfile

from pyspark.sql import functions as F

from sluice import schemas
from sluice.config import SEED_CONFIGS
from sluice.plans.ingest import Layout, run_all, run_source
from sluice.sources.tables import read_table
from dataclasses import replace

from sluice.config import FRAUD_CONFIG
from sluice.operators.relate import fk_join, fk_orphans
from sluice.sources.files import read_source
from tests.fixtures import ATM_FEED, FRAUD_FEED, IN_FEED, MERCHANT_FEED, US_FEED, write_feed

DATE = "2026-01-01"


def _setup():
    root = tempfile.mkdtemp(prefix="sluice-e2e-")
    write_feed(root, "card_transactions", DATE, f"us_card_transactions_{DATE}_001.csv", US_FEED)
    write_feed(root, "card_transactions", DATE, f"in_card_transactions_{DATE}_001.csv", IN_FEED)
    write_feed(root, "merchant_updates", DATE, f"merchant_updates_{DATE}_001.csv", MERCHANT_FEED)
    write_feed(root, "atm_withdrawals", DATE, f"atm_withdrawals_{DATE}_001.csv", ATM_FEED)
    write_feed(root, "fraud_flags", DATE, f"fraud_flags_{DATE}_001.csv", FRAUD_FEED)
    configs = [c.with_root(root) for c in SEED_CONFIGS]
    return root, configs


def _rates(spark):
    return spark.createDataFrame([("INR", "2025-12-01", 0.012)], "currency string, as_of_date string, rate_to_usd double") \
        .withColumn("as_of_date", F.to_date("as_of_date"))


def test_us_feed_verdicts_and_audit(spark):
    root, configs = _setup()
    us = configs[0]
    layout = Layout(root)
    res = run_source(spark, us, DATE, layout, run_id="run-1")
    assert (res.rows_read, res.rows_written, res.rows_rejected) == (7, 1, 6)
    assert res.status == "PARTIAL"

    rej = read_table(spark, us.rejected_path, None or spark.read.parquet(us.rejected_path).schema)
    got = {(r["transaction_id"], r["transaction_time"][-8:]): list(r["failed_rules"]) for r in rej.collect()}
    assert got == {
        ("U1", "10:00:00"): ["dup:transaction_id"],
        ("U2", "10:01:00"): ["r001"],
        ("U3", "10:02:00"): ["r002"],
        ("U4", "10:03:00"): ["r003"],
        (None, "10:04:00"): ["r003", "r004"],
        ("U6", "10:05:00"): ["cast:amount_usd", "r001"],
    }
    silver = read_table(spark, us.silver_path, schemas.CARD_TRANSACTIONS_SILVER, {"processing_date": DATE, "source_id": us.source_id})
    rows = silver.collect()
    assert len(rows) == 1 and rows[0]["transaction_id"] == "U1" and rows[0]["amount_usd"] == 11.0
    assert rows[0]["source_currency"] == "USD" and rows[0]["original_amount"] is None and rows[0]["dq_passed"]

    dq = read_table(spark, layout.dq_results, schemas.DQ_RESULTS).orderBy("rule_id").collect()
    assert [(r.rule_id, r.total_rows, r.passed_rows, r.failed_rows, round(r.pass_rate, 4), r.rule_passed) for r in dq] == [
        ("r001", 7, 5, 2, 0.7143, False),
        ("r002", 7, 6, 1, 0.8571, False),
        ("r003", 7, 5, 2, 0.7143, False),
        ("r004", 7, 6, 1, 0.8571, False),
    ]
    s = read_table(spark, layout.dq_summary, schemas.DQ_SUMMARY).collect()[0]
    assert (s.total_rows_ingested, s.total_rows_passed, s.total_rows_rejected) == (7, 1, 6)
    assert round(s.overall_pass_rate, 4) == 0.1429
    assert (s.rules_checked, s.rules_passed, s.rules_failed, s.ingestion_status) == (4, 0, 4, "PARTIAL")
    lin = read_table(spark, layout.lineage, schemas.PIPELINE_LINEAGE).collect()[0]
    assert (lin.rows_read, lin.rows_written, lin.rows_rejected) == (7, 1, 6)
    assert lin.rows_read == lin.rows_written + lin.rows_rejected


def test_rerun_is_idempotent(spark):
    root, configs = _setup()
    us = configs[0]
    layout = Layout(root)
    run_source(spark, us, DATE, layout, run_id="run-1")
    run_source(spark, us, DATE, layout, run_id="run-2")
    silver = read_table(spark, us.silver_path, schemas.CARD_TRANSACTIONS_SILVER)
    assert silver.count() == 1
    assert silver.first().run_id == "run-2"
    assert read_table(spark, layout.dq_results, schemas.DQ_RESULTS).count() == 8  # appended twice
    assert read_table(spark, layout.dq_summary, schemas.DQ_SUMMARY).count() == 2


def test_run_all_four_sources(spark):
    root, configs = _setup()
    layout = Layout(root)
    results = {r.source_id: r for r in run_all(spark, configs, DATE, layout, run_id="run-all", rates=_rates(spark),
                                               profile_registry=True)}
    assert results["src_us_card_txns"].rows_read == 7
    india = results["src_in_card_txns"]
    assert (india.rows_read, india.rows_written, india.rows_rejected) == (3, 1, 2)
    card = read_table(spark, configs[1].silver_path, schemas.CARD_TRANSACTIONS_SILVER, {"source_id": "src_in_card_txns"}).collect()
    assert len(card) == 1
    r = card[0]
    assert r.status == "APPROVED" and r.source_currency == "INR" and r.original_amount == 1000.0 and r.amount_usd == 12.0
    assert str(r.transaction_ts) == "2026-01-01 09:05:00"  # UTC source by default
    merchant = results["src_merchant_updates"]
    assert (merchant.rows_read, merchant.rows_written) == (3, 1)
    atm = results["src_atm_sg"]
    assert (atm.rows_read, atm.rows_written, atm.rows_rejected) == (3, 2, 1)  # 75 is not a multiple of 50
    atm_rows = read_table(spark, configs[3].silver_path, schemas.ATM_SILVER).orderBy("withdrawal_id").collect()
    assert [str(x.withdrawal_ts) for x in atm_rows] == ["2026-01-01 10:00:00.123456", "2026-01-01 12:00:00.500000"]
    reg = read_table(spark, layout.registry, schemas.SCHEMA_REGISTRY, {"source_id_part": "src_atm_sg"}).collect()
    assert {r.column_name for r in reg} == {"withdrawal_id", "atm_id", "card_hash", "amount_sgd", "currency",
                                            "withdrawal_ts", "dispense_status", "location"}
    assert {r.schema_version for r in reg} == {1}
    # both card sources share one silver table, told apart by source_id
    both = read_table(spark, configs[0].silver_path, schemas.CARD_TRANSACTIONS_SILVER)
    assert sorted(r.source_id for r in both.collect()) == ["src_in_card_txns", "src_us_card_txns"]


def test_missing_day_is_skipped(spark):
    root, configs = _setup()
    res = run_source(spark, configs[0], "2030-01-01", Layout(root))
    assert res.status == "SKIPPED"


def test_hot_key_feed_reconciles(spark):
    """One key holds a third of the rows: one winner, every other copy rejected, counts exact."""
    from sluice.plans.ingest import ingest_frame

    us = SEED_CONFIGS[0].with_root(tempfile.mkdtemp(prefix="sluice-hot-"))
    lines = US_FEED.strip().splitlines()
    header = lines[0]
    rows = []
    for i in range(3000):
        tid = "HOT" if i % 3 == 0 else f"K{i}"
        rows.append(f"{tid},4000000000000001,Acme,{10 + i % 7}.5,2026-01-01 10:{i % 60:02d}:{(i // 60) % 60:02d},APPROVED,0")
    path = os.path.join(tempfile.mkdtemp(prefix="sluice-hot-raw-"), "feed.csv")
    with open(path, "w") as f:
        f.write("\n".join([header, *rows]) + "\n")
    raw = spark.read.option("header", "true").schema(", ".join(f"`{c}` string" for c in header.split(","))).csv(path)
    layout = Layout(os.path.dirname(us.silver_path.rstrip("/")))
    res = ingest_frame(spark, us, raw, path, DATE, layout, "run-hot")
    assert (res.rows_read, res.rows_written, res.rows_rejected) == (3000, 2001, 999)
    silver = read_table(spark, us.silver_path, schemas.CARD_TRANSACTIONS_SILVER)
    hot = silver.filter(F.col("transaction_id") == "HOT").collect()
    assert len(hot) == 1
    # the newest copy wins: latest minute, then latest second
    newest = max((f"10:{i % 60:02d}:{(i // 60) % 60:02d}", i) for i in range(0, 3000, 3))
    assert hot[0].transaction_ts.strftime("%H:%M:%S") == newest[0]
    rej = spark.read.parquet(us.rejected_path)
    assert rej.filter(F.array_contains("failed_rules", "dup:transaction_id")).count() == 999


def test_five_feeds_invariants(spark):
    """Five feeds in one run; invariants of SURVEY section 5 on every source."""
    root, configs = _setup()
    configs = configs + [replace(FRAUD_CONFIG.with_root(root), is_active=True)]
    layout = Layout(root)
    results = run_all(spark, configs, DATE, layout, run_id="run-5", rates=_rates(spark))
    assert {r.source_id: r.status for r in results}["src_fraud_flags"] == "PARTIAL"  # F3 score, F4 ref
    lin = read_table(spark, layout.lineage, schemas.PIPELINE_LINEAGE)
    assert lin.count() == 5
    assert lin.filter(F.col("rows_read") != F.col("rows_written") + F.col("rows_rejected")).count() == 0  # G2
    dq = read_table(spark, layout.dq_results, schemas.DQ_RESULTS)
    assert dq.filter(F.col("passed_rows") + F.col("failed_rows") != F.col("total_rows")).count() == 0
    assert dq.count() == 21  # 18 seeded rules + 3 fraud rules
    for cfg in configs:
        silver = read_table(spark, cfg.silver_path, schemas.TABLES[cfg.target_table], {"source_id": cfg.source_id})
        pk = cfg.pk_silver
        assert silver.count() == silver.select(pk).distinct().count()  # silver key unique
        raw = read_source(spark, cfg, DATE).df  # the routed feed of this source
        rejected = spark.read.parquet(cfg.rejected_path).filter(F.col("source_id") == cfg.source_id)
        key_raw = [c for c, s_ in cfg.column_mapping if s_ == pk][0]
        back = silver.select(F.col(pk).alias("k")).unionAll(rejected.select(F.col(key_raw).alias("k")))
        assert raw.select(F.col(key_raw).alias("k")).exceptAll(back).count() == 0  # silver + rejected = raw
        assert back.count() == raw.count()
    # fraud flags join to card transactions 1:N; orphans found
    card = read_table(spark, configs[0].silver_path, schemas.CARD_TRANSACTIONS_SILVER)
    flags = read_table(spark, configs[-1].silver_path, schemas.FRAUD_FLAGS_SILVER).drop("run_id", "ingested_at", "dq_passed", "processing_date", "source_id")
    assert fk_join(flags, card, "transaction_ref", "transaction_id").count() == 2  # F1 and F2 both hit U1
    assert fk_orphans(flags, card, "transaction_ref", "transaction_id").count() == 0


def test_rerun_gives_identical_silver(spark):
    root, configs = _setup()
    layout = Layout(root)
    cols = [f.name for f in schemas.data_fields("merchant_silver")]
    run_source(spark, configs[2], DATE, layout, run_id="a")
    first = {tuple(r) for r in read_table(spark, configs[2].silver_path, schemas.MERCHANT_SILVER).select(*cols).collect()}
    run_source(spark, configs[2], DATE, layout, run_id="b")
    second = {tuple(r) for r in read_table(spark, configs[2].silver_path, schemas.MERCHANT_SILVER).select(*cols).collect()}
    assert first == second and len(first) == 1


def test_run_all_parallel_by_target_table(spark):
    root, configs = _setup()
    layout = Layout(root)
    results = run_all(spark, configs, DATE, layout, run_id="run-par", rates=_rates(spark), parallel=3)
    assert sorted(r.source_id for r in results) == sorted(c.source_id for c in configs)
    assert all(r.status in ("SUCCESS", "PARTIAL") for r in results)
    card = read_table(spark, configs[0].silver_path, schemas.CARD_TRANSACTIONS_SILVER)
    assert sorted({r.source_id for r in card.collect()}) == ["src_in_card_txns", "src_us_card_txns"]


def test_failing_source_is_isolated(spark):
    root, configs = _setup()
    broken = replace(configs[2], column_mapping=configs[2].column_mapping + (("merchant_id", "merchant_id"),),
                     target_table="no_such_table")
    results = {r.source_id: r for r in run_all(spark, [configs[0], broken], DATE, Layout(root), run_id="run-iso")}
    assert results["src_merchant_updates"].status == "FAILED"
    assert results["src_us_card_txns"].status == "PARTIAL"
    lin = read_table(spark, Layout(root).lineage, schemas.PIPELINE_LINEAGE)
    assert {(r.source_id, r.status) for r in lin.collect()} == {("src_us_card_txns", "PARTIAL"), ("src_merchant_updates", "FAILED")}


def test_source_timezone_normalised_to_utc(spark):
    root, configs = _setup()
    india = replace(configs[1], source_timezone="Asia/Kolkata")
    res = run_source(spark, india, DATE, Layout(root), run_id="tz", rates=_rates(spark))
    assert res.rows_written == 1
    row = read_table(spark, india.silver_path, schemas.CARD_TRANSACTIONS_SILVER, {"source_id": india.source_id}).first()
    assert str(row.transaction_ts) == "2026-01-01 03:35:00"  # 09:05 in Kolkata


def test_a_short_write_fails_the_run(spark, monkeypatch):
    """Read, written and rejected rows are counted apart, so a row lost in a write shows."""
    from sluice.plans import ingest

    root, configs = _setup()
    monkeypatch.setattr(ingest, "dealt_for", lambda df, *args: df.limit(df.count() - 1))
    res = run_source(spark, configs[0], DATE, Layout(root))
    assert res.status == "FAILED" and "read 7 !=" in res.message
    assert ingest.unreconciled_counts(7, 1, 6, 1) is None
    assert ingest.unreconciled_counts(7, 1, 5, 1) and ingest.unreconciled_counts(7, 1, 6, 0)


def test_a_rule_that_raises_on_a_row_rejects_that_row(spark):
    import dataclasses

    from sluice.config import Rule

    root, configs = _setup()
    bad = (Rule("x1", "divides", "amount_usd", "custom", 1.0, expression="100 / (amount_usd - 11) > -1000"),
           Rule("x2", "aggregates", "amount_usd", "custom", 1.0, expression="sum(amount_usd) > 1"),
           Rule("x3", "ranks", "amount_usd", "custom", 1.0, expression="row_number() over (order by amount_usd) > 0"),
           Rule("x4", "broken", "merchant_name", "regex", 1.0, expression="a("),
           Rule("x5", "casts", "merchant_name", "range", 1.0, expression="CASE WHEN amount_usd = 12 THEN CAST(merchant_name AS INT) END > 0"))
    plain = run_source(spark, configs[0], DATE, Layout(root))
    cfg = dataclasses.replace(configs[0], rules=(*configs[0].rules, *bad))
    res = run_source(spark, cfg, DATE, Layout(root))
    # U1's newer copy raises in x1, so the older one is no copy any more and takes its place
    assert res.rows_read == 7 and res.rows_written == plain.rows_written == 1
    rejected = [set(r.failed_rules) for r in spark.read.parquet(cfg.rejected_path).collect()]
    assert sum("error:x1" in r for r in rejected) == 1 and sum("error:x5" in r for r in rejected) == 2
    rules = {r["rule_id"]: r for r in res.rules}
    assert rules["x1"]["failed_rows"] == 1 and rules["x5"]["failed_rows"] == 2 and not rules["x1"]["rule_passed"]
    results = {r.rule_id: r for r in read_table(spark, Layout(root).dq_results, schemas.DQ_RESULTS).filter(F.col("run_id") == res.run_id).collect()}
    assert "U1" in results["x1"].sample_failures
    for rule in ("x2", "x3", "x4"):
        assert not rules[rule]["rule_passed"] and results[rule].sample_failures
    assert "bad pattern" in results["x4"].sample_failures


def test_json_rows_are_rejected_whole(spark):
    import dataclasses
    import json

    root = tempfile.mkdtemp(prefix="sluice-json-")
    us = dataclasses.replace(SEED_CONFIGS[0].with_root(root), file_format="JSON")
    day = us.raw_path_for(DATE)
    os.makedirs(day)
    good = {"transaction_id": "J1", "card_number": "4000000000000001", "merchant_name": "Acme", "amount_usd": "10.5",
            "transaction_time": "2026-01-01 10:00:00", "status": "APPROVED", "is_international": "0", "loyalty": {"tier": 3}}
    with open(os.path.join(day, "feed.json"), "w") as f:
        f.write(json.dumps(good) + "\n" + json.dumps({**good, "transaction_id": "J2", "amount_usd": "abc"}) + "\n{broken\n")
    res = run_source(spark, us, DATE, Layout(root))
    assert (res.rows_read, res.rows_written, res.rows_rejected) == (3, 1, 2)
    rejected = {tuple(r.failed_rules): r._raw_json for r in spark.read.parquet(us.rejected_path).collect()}
    assert any('"tier": 3' in line for line in rejected.values()) and "{broken" in rejected.values()
    assert any("raw:malformed" in reasons for reasons in rejected)


def test_a_value_changed_on_disk_fails_the_run(spark, monkeypatch):
    """The row counts agree, the content of the written partition doesn't."""
    from sluice.plans import ingest

    root, configs = _setup()
    real = ingest.read_table

    def tampered(spark, path, schema, spec=None, columns=None):
        rows = real(spark, path, schema, spec, columns)
        return rows.withColumn("merchant_name", F.upper("merchant_name")) if "silver" in path else rows

    monkeypatch.setattr(ingest, "read_table", tampered)
    res = run_source(spark, configs[0], DATE, Layout(root))
    assert res.status == "FAILED" and "content written" in res.message
    monkeypatch.setattr(ingest, "read_table", real)
    assert run_source(spark, configs[0], DATE, Layout(root)).status != "FAILED"


def test_a_file_read_short_is_named(spark, monkeypatch):
    """G1 by file: rows counted apart from the scan tell which file lost some."""
    from sluice.plans import ingest
    from sluice.sources.files import RawScan

    root, configs = _setup()
    write_feed(root, "card_transactions", DATE, "us_more.csv", US_FEED)
    real = ingest.read_source

    class Short(RawScan):
        @property
        def tracked(self):
            rows = super().tracked
            return rows.filter(~(F.col("_file").contains("us_more") & F.col("transaction_id").eqNullSafe("U2")))

    def short(*args):
        scan = real(*args)
        return Short(scan.parts, scan.routed, scan.path)

    assert run_source(spark, configs[0], DATE, Layout(root), check_files=True).status != "FAILED"
    monkeypatch.setattr(ingest, "read_source", short)
    res = run_source(spark, configs[0], DATE, Layout(root), check_files=True)
    assert res.status == "FAILED" and "us_more.csv: read 6 of 7 rows" in res.message
    files = spark.read.parquet(Layout(root).files).filter(F.col("run_id") == res.run_id)
    assert {(r.file.rsplit("/", 1)[-1], r.rows_read, r.reconciled) for r in files.collect() if "us_more" in r.file} == {("us_more.csv", 6, False)}


def test_unique_keys_ship_no_raw_row(spark):
    """of a feed without copies only hashes of keys are shuffled by the dedup."""
    from sluice.operators.dedup import repeated_hashes, with_row_id

    rows = with_row_id(spark.range(0, 50_000, numPartitions=4).selectExpr("concat('key-', id) k", "repeat(sha2(cast(id as string), 256), 3) raw"))
    path = tempfile.mkdtemp() + "/h"
    assert repeated_hashes(rows, ["k"], path).count() == 0
    plan = rows.groupBy(F.xxhash64("k")).count()._jdf.queryExecution().executedPlan().toString()
    assert "raw" not in plan.split("Exchange")[1]
