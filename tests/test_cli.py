"""Command line: setup -> verify -> ingest -> manifest in one session."""

import json
import tempfile

from pyspark.sql import functions as F

from sluice import cli
from tests.fixtures import ATM_FEED, IN_FEED, US_FEED, write_feed


def test_cli_round_trip(spark, capsys):
    root = tempfile.mkdtemp(prefix="sluice-cli-")
    db = "sluice_cli_test"
    write_feed(root, "card_transactions", "2026-01-01", "us_card_transactions_2026-01-01_001.csv", US_FEED)
    write_feed(root, "atm_withdrawals", "2026-01-01", "atm_withdrawals_2026-01-01_001.csv", ATM_FEED)
    assert cli.main(["setup", "--db", db, "--root", root, "--buckets", "4"]) == 0
    assert json.loads(capsys.readouterr().out)["configs"] == 4
    assert cli.main(["verify", "--db", db]) == 0
    assert json.loads(capsys.readouterr().out)["ok"] is True
    assert cli.main(["ingest", "--db", db, "--root", root, "--date", "2026-01-01"]) == 0
    runs = {r["source_id"]: r for r in json.loads(capsys.readouterr().out)["runs"]}
    assert runs["src_us_card_txns"]["rows_read"] == 7 and runs["src_atm_sg"]["rows_written"] == 2
    # partitions registered in the catalog; sources without files are audited as well
    summary = {r.source_id: r.ingestion_status for r in spark.table(f"{db}.dq_summary").collect()}
    assert sum(s == "SKIPPED" for s in summary.values()) == 2 and len(summary) == 4
    assert spark.table(f"{db}.card_transactions_silver").count() == 1  # written through the bucketed table
    assert cli.main(["manifest", "--root", root]) == 0
    files = json.loads(capsys.readouterr().out)["files"]
    assert {f["source_dir"] for f in files} == {"card_transactions", "atm_withdrawals"}
    spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")


def test_setup_keeps_the_users_sources_and_inr_amounts_survive_the_config_table(spark, capsys):
    root, db = tempfile.mkdtemp(prefix="sluice-cli-in-"), "sluice_cli_in_test"
    write_feed(root, "card_transactions", "2026-01-01", "in_card_transactions_2026-01-01_001.csv", IN_FEED)
    write_feed(root, "card_transactions", "2026-01-01", "drifted.csv", IN_FEED.replace("vendor", "shop"))
    rates = f"{root}/rates"
    spark.createDataFrame([("INR", "2025-12-31", 0.012)], "currency string, as_of_date string, rate_to_usd double") \
        .selectExpr("currency", "to_date(as_of_date) AS as_of_date", "rate_to_usd").write.parquet(rates)
    assert cli.main(["setup", "--db", db, "--root", root]) == 0
    own = spark.table(f"{db}.ingestion_config").limit(1).selectExpr("'mine' AS source_id", "* EXCEPT (source_id)", )
    own = own.withColumn("is_active", F.lit(False)).select(spark.table(f"{db}.ingestion_config").columns)
    own.write.insertInto(f"{db}.ingestion_config")
    assert cli.main(["setup", "--db", db, "--root", root]) == 0
    capsys.readouterr()
    assert {r.source_id for r in spark.table(f"{db}.ingestion_config").collect()} >= {"mine", "src_in_card_txns"}

    cli.main(["ingest", "--db", db, "--root", root, "--date", "2026-01-01"])
    runs = {r["source_id"]: r for r in json.loads(capsys.readouterr().out)["runs"]}
    assert runs["src_in_card_txns"]["status"] == "FAILED" and "no rate from INR" in runs["src_in_card_txns"]["message"]
    assert "drifted.csv" in runs["(unclaimed)"]["message"]

    cli.main(["ingest", "--db", db, "--root", root, "--date", "2026-01-01", "--rates", rates])
    runs = {r["source_id"]: r for r in json.loads(capsys.readouterr().out)["runs"]}
    assert runs["src_in_card_txns"]["rows_written"] >= 1
    rows = spark.table(f"{db}.card_transactions_silver").filter("source_id = 'src_in_card_txns'").collect()
    assert rows and all(r.source_currency == "INR" and r.original_amount is not None for r in rows)
    assert all(abs(r.amount_usd - round(r.original_amount * 0.012, 2)) < 0.011 for r in rows)


def test_ingest_fills_the_registry_and_drift_names_a_new_raw_column(spark, capsys):
    root, db = tempfile.mkdtemp(prefix="sluice-cli-drift-"), "sluice_cli_drift_test"
    lines = US_FEED.splitlines()
    write_feed(root, "card_transactions", "2026-01-01", "us_1.csv", US_FEED)
    write_feed(root, "card_transactions", "2026-01-02", "us_1.csv", "\n".join([lines[0] + ",loyalty", *[x + ",gold" for x in lines[1:]]]) + "\n")
    assert cli.main(["setup", "--db", db, "--root", root]) == 0
    for day in ("2026-01-01", "2026-01-02"):
        assert cli.main(["ingest", "--db", db, "--root", root, "--date", day, "--check-files"]) == 0
    registry = spark.table(f"{db}.schema_registry").filter("source_id = 'src_us_card_txns'")
    assert registry.filter("column_name = 'transaction_id' and sample_values is not null").count() == 2  # a snapshot a run
    capsys.readouterr()
    assert cli.main(["drift", "--root", root]) == 0
    raw = {r["column_name"]: r["changes"] for r in json.loads(capsys.readouterr().out)["raw"]}
    assert raw["loyalty"] == "added"
    spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")


def test_an_invalid_config_fails_its_source_before_anything_is_read(spark, capsys):
    root, db = tempfile.mkdtemp(prefix="sluice-cli-bad-"), "sluice_cli_bad_test"
    write_feed(root, "card_transactions", "2026-01-01", "us_1.csv", US_FEED)
    write_feed(root, "atm_withdrawals", "2026-01-01", "atm_1.csv", ATM_FEED)
    assert cli.main(["setup", "--db", db, "--root", root]) == 0
    from sluice.operators.mutate import rewrite_table, update_rows

    rule = '[{"rule_id": "z1", "type": "range", "column": "amount_usd", "threshold": 2.0}]'
    rewrite_table(spark, f"{db}.ingestion_config", lambda t: update_rows(t, {"dq_rules_json": rule}, F.col("source_id") == "src_us_card_txns"))
    capsys.readouterr()
    cli.main(["ingest", "--db", db, "--root", root, "--date", "2026-01-01"])
    runs = {r["source_id"]: r for r in json.loads(capsys.readouterr().out)["runs"]}
    bad = runs["src_us_card_txns"]
    assert bad["status"] == "FAILED" and "z1: expression missing" in bad["message"] and "threshold outside" in bad["message"]
    assert runs["src_atm_sg"]["rows_written"] == 2
    status = {r.source_id: (r.ingestion_status, r.total_rows_ingested) for r in spark.table(f"{db}.dq_summary").collect()}
    assert status["src_us_card_txns"] == ("FAILED", None)
    spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")
