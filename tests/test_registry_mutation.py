"""Registry (H1-H7), mutation (I1-I5), catalog (B5-B11) and checks."""

import glob
import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from sluice.config import config_frame
from sluice.operators.mutate import commit_snapshot, delete_rows, latest_version, read_snapshot, update_rows, upsert
from sluice.operators.registry import bump_versions, infer_types, profile, sample_values, schema_drift, snapshot, value_drift
from sluice.plans.catalog import create_all, drop_database, list_tables, table_type
from sluice.plans.checks import catalog_checks, config_checks, expectations, seed_listing
from sluice.plans.ingest import Layout
from sluice.sources.files import read_headerless
from tests.fixtures import EMP_CSV


def test_profile_and_samples(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("a", 3.0), (None, 2.0)], "s string, d double")
    p = {r.column_name: r for r in profile(df).collect()}
    assert (p["s"].column_type, p["s"].is_nullable, p["s"].null_rate, p["s"].min_value, p["s"].max_value) == ("string", True, 0.25, "a", "b")
    assert (p["d"].column_type, p["d"].min_value, p["d"].max_value) == ("double", "1.0", "3.0")
    sv = {r.column_name: r.sample_values for r in sample_values(df, k=10).collect()}
    assert sv["s"] == '["a","b"]' and sv["d"] == '["1.0","2.0","3.0"]'


def test_infer_types(spark):
    df = spark.createDataFrame([("1", "1.5", "true", "2026-01-01 10:00:00", "x", None),
                                ("2", "2", "false", "2026-01-02", "1", None)], "a string, b string, c string, d string, e string, f string")
    got = {r.column_name: r.column_type for r in infer_types(df).collect()}
    assert got == {"a": "integer", "b": "double", "c": "boolean", "d": "timestamp", "e": "string", "f": "string"}


def test_drift(spark):
    old = profile(spark.createDataFrame([(1, "x", 2.0)], "a int, b string, c double"))
    new = profile(spark.createDataFrame([(1, None, "2.0", 5)], "a int, b string, c string, d int"))
    d = {r.column_name: r.change_type for r in schema_drift(old, new).collect()}
    assert d == {"b": "nullability_changed", "c": "retyped", "d": "added"}
    v = {r.column_name: (r.null_rate_delta, r.min_changed) for r in value_drift(old, new).collect()}
    assert v["b"] == (1.0, True) and v["a"] == (0.0, False)
    gone = {r.column_name: r.change_type for r in schema_drift(new, old).collect()}
    assert gone["d"] == "removed"


def test_snapshot_layout_and_version_bump(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    snap = snapshot(df, "src_x", 3)
    assert snap.columns == ["source_id", "column_name", "column_type", "is_nullable", "sample_values", "null_rate",
                            "min_value", "max_value", "schema_version", "analysed_at", "source_id_part"]
    stored = config_frame(spark)
    incoming = stored.withColumn("dq_rules_json", F.when(F.col("source_id") == "src_atm_sg", F.lit("[]")).otherwise(F.col("dq_rules_json")))
    v = {r.source_id: r.schema_version for r in bump_versions(stored, incoming).collect()}
    assert v == {"src_us_card_txns": 1, "src_in_card_txns": 1, "src_merchant_updates": 1, "src_atm_sg": 2}


def test_mutation_sequence_fixture(spark):
    """Load -> update -> delete, each state a committed snapshot (FIXTURES section 5)."""
    root = tempfile.mkdtemp(prefix="sluice-emp-")
    with open(os.path.join(root, "emp.csv"), "w") as f:
        f.write(EMP_CSV)
    raw = read_headerless(spark, os.path.join(root, "emp.csv"), "emp_id INT, emp_name STRING, dept STRING, salary DOUBLE")
    table = os.path.join(root, "emp_acid")
    commit_snapshot(raw, table)
    s1 = [tuple(r) for r in read_snapshot(spark, table).orderBy("emp_id").collect()]
    assert s1 == [(101, "ALICE", "Data Engineering", 75000.0), (102, "BOB", "Analytics", 68000.0), (103, "CHARLIE", "Operations", 55000.0)]
    commit_snapshot(update_rows(read_snapshot(spark, table), {"salary": 85000.0}, F.col("dept") == "Data Engineering"), table)
    s2 = [(r.emp_id, r.salary) for r in read_snapshot(spark, table).orderBy("emp_id").collect()]
    assert s2 == [(101, 85000.0), (102, 68000.0), (103, 55000.0)]
    commit_snapshot(delete_rows(read_snapshot(spark, table), F.col("emp_id") == 103), table)
    s3 = [(r.emp_id, r.salary) for r in read_snapshot(spark, table).orderBy("emp_id").collect()]
    assert s3 == [(101, 85000.0), (102, 68000.0)]
    assert latest_version(spark, table) == 3


def test_update_delete_null_condition_keeps_row(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "k int, d string")
    assert delete_rows(df, F.col("d") == "x").count() == 1
    assert [r.k for r in update_rows(df, {"k": 9}, F.col("d") == "x").orderBy("k").collect()] == [1, 9]


def test_upsert(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    u = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(tuple(r) for r in upsert(t, u, ["k"]).collect()) == [(1, "a"), (2, "B"), (3, "C")]
    dup = spark.createDataFrame([(2, "B"), (2, "BB")], "k int, v string")
    try:
        upsert(t, dup, ["k"])
        raise AssertionError("duplicate merge keys must be refused")
    except ValueError:
        pass


def test_catalog_and_checks(spark):
    """Set-up checks of FIXTURES section 6."""
    root = tempfile.mkdtemp(prefix="sluice-cat-")
    db = "sluice_test_catalog"
    create_all(spark, db, Layout(root))
    create_all(spark, db, Layout(root))  # idempotent
    config_frame(spark).write.insertInto(f"{db}.ingestion_config")
    names = {r.tableName for r in list_tables(spark, db).collect()}
    assert {"ingestion_config", "schema_registry", "dq_results", "dq_summary", "card_transactions_silver",
            "merchant_silver", "atm_silver", "fraud_flags_silver", "pipeline_lineage"} <= names
    assert table_type(spark, db, "ingestion_config") == "MANAGED"
    assert table_type(spark, db, "dq_results") == "EXTERNAL"
    conf = spark.table(f"{db}.ingestion_config")
    checks = {r.check: (r.actual, r.ok) for r in expectations(
        catalog_checks(spark, db) + config_checks(conf, 4, "src_atm_sg", "r014", "src_us_card_txns")).collect()}
    assert checks == {"config_table_managed": ("MANAGED", True), "results_table_external": ("EXTERNAL", True),
                      "active_sources": ("4", True), "row_once_after_update": ("1", True), "rule_r014_present": ("true", True)}
    listing = [(r.source_id, r.is_active, r.created_by, r.schema_version) for r in seed_listing(conf).collect()]
    assert [x[0] for x in listing] == ["src_atm_sg", "src_in_card_txns", "src_us_card_txns", "src_merchant_updates"]
    assert all(x[1:] == (True, "human", 1) for x in listing)
    drop_database(spark, db)
    assert os.path.isdir(os.path.join(root, "hive", "dq_results"))  # external files survive the drop


def test_merge_configs_bumps_and_commits(spark):
    from sluice.operators.mutate import merge_configs

    stored = config_frame(spark)
    incoming = stored.filter(F.col("source_id").isin("src_atm_sg", "src_us_card_txns")).withColumn(
        "dq_rules_json", F.when(F.col("source_id") == "src_atm_sg", F.lit("[]")).otherwise(F.col("dq_rules_json")))
    new_src = stored.filter(F.col("source_id") == "src_atm_sg").withColumn("source_id", F.lit("src_new"))
    merged = merge_configs(stored, incoming.unionByName(new_src))
    v = {r.source_id: r.schema_version for r in merged.collect()}
    assert v == {"src_us_card_txns": 1, "src_in_card_txns": 1, "src_merchant_updates": 1, "src_atm_sg": 2, "src_new": 1}
    path = tempfile.mkdtemp(prefix="sluice-cfg-") + "/ingestion_config"
    commit_snapshot(stored, path)
    commit_snapshot(merged, path)
    assert latest_version(spark, path) == 2 and read_snapshot(spark, path).count() == 5


def test_run_from_config_table(spark):
    from sluice.config import SEED_CONFIGS
    from sluice.plans.ingest import run_from_config
    from tests.fixtures import US_FEED, write_feed

    root = tempfile.mkdtemp(prefix="sluice-cfgrun-")
    write_feed(root, "card_transactions", "2026-01-01", "us_card_transactions_2026-01-01_001.csv", US_FEED)
    cfg = config_frame(spark, [c.with_root(root) for c in SEED_CONFIGS])
    res = {r.source_id: r.status for r in run_from_config(spark, cfg, "2026-01-01", Layout(root))}
    assert res == {"src_us_card_txns": "PARTIAL", "src_in_card_txns": "SKIPPED",
                   "src_merchant_updates": "SKIPPED", "src_atm_sg": "SKIPPED"}


def test_bucketed_silver_join_without_shuffle(spark):
    """Card and fraud silver bucketed on the transaction id: the FK join reads co-located buckets."""
    from dataclasses import replace as dc_replace

    from sluice.config import FRAUD_CONFIG, SEED_CONFIGS
    from sluice.operators.relate import fk_join
    from sluice.plans.ingest import run_source
    from tests.fixtures import FRAUD_FEED, US_FEED, write_feed

    root = tempfile.mkdtemp(prefix="sluice-bucket-")
    db = "sluice_bucket_test"
    write_feed(root, "card_transactions", "2026-01-01", "us_card_transactions_2026-01-01_001.csv", US_FEED)
    write_feed(root, "fraud_flags", "2026-01-01", "fraud_flags_2026-01-01_001.csv", FRAUD_FEED)
    create_all(spark, db, Layout(root), buckets=4)
    us = SEED_CONFIGS[0].with_root(root)
    fraud = dc_replace(FRAUD_CONFIG.with_root(root), is_active=True)
    assert run_source(spark, us, "2026-01-01", Layout(root), silver_table=f"{db}.card_transactions_silver").rows_written == 1
    assert run_source(spark, fraud, "2026-01-01", Layout(root), silver_table=f"{db}.fraud_flags_silver").rows_written == 2
    card = spark.table(f"{db}.card_transactions_silver").select("transaction_id", "amount_usd")
    flags = spark.table(f"{db}.fraud_flags_silver").select("flag_id", "transaction_ref")
    joined = fk_join(flags, card, "transaction_ref", "transaction_id")
    assert joined.count() == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force the shuffled-join planning path
    try:
        plan = flags.join(card, flags.transaction_ref == card.transaction_id)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
    drop_database(spark, db)


def test_merged_states_equal_a_full_profile(spark):
    from sluice.operators.registry import merge_states, profile, profile_states

    rows = [(i, float(i) * 1.5 - 40, f"v{i % 7}" if i % 11 else None, i % 2 == 0, dt.datetime(2024, 1, 1 + i % 28)) for i in range(300)]
    df = spark.createDataFrame(rows, "a long, b double, c string, d boolean, e timestamp")
    parts = [profile_states(df.filter(F.col("a") % 4 == k)) for k in range(3)] + [profile_states(df.filter(F.col("a") % 4 == 3)), profile_states(df.filter("false"))]
    states = parts[0]
    for p in parts[1:]:
        states = states.unionByName(p)
    merged = merge_states(states)
    want = sorted(map(tuple, profile(df).collect()))
    assert sorted(map(tuple, merged.select("column_name", "column_type", "is_nullable", "null_rate", "min_value", "max_value").collect())) == want
    import json

    samples = {r.column_name: json.loads(r.sample_values) for r in merged.collect()}
    assert set(samples["c"]) == {f"v{i}" for i in range(7)} and set(samples["d"]) == {"true", "false"} and len(samples["a"]) <= 10


def test_sketch_error_bound(spark):
    """Every value more frequent than the stated error is found, and no count is too high or low by more."""
    from sluice.operators.registry import SKETCH_ERROR, TRACKED

    n = 200_000
    df = spark.range(0, n, numPartitions=6).selectExpr(
        "case when id % 10 < 3 then 'hot' when id % 100 = 5 then concat('warm', id % 300) else cast(id as string) end v")
    found = df.groupBy((F.xxhash64("v") % 3).alias("day")).agg(F.call_function("approx_top_k_accumulate", "v", F.lit(TRACKED)).alias("s"))
    top = found.agg(F.call_function("approx_top_k_combine", "s", F.lit(TRACKED)).alias("s")).select(
        F.inline(F.call_function("approx_top_k_estimate", "s", F.lit(10)))).collect()
    exact = {r.v: r["count"] for r in df.groupBy("v").count().filter(F.col("count") > n * SKETCH_ERROR).collect()}
    got = {r["item"]: r["count"] for r in top}
    assert set(exact) <= set(got) and len(exact) > 1
    assert all(abs(got[v] - c) <= n * SKETCH_ERROR for v, c in exact.items())


def test_type_masks(spark):
    from sluice.operators.registry import infer_types

    columns = {
        "i": ["1", " -20 ", "+3", None], "big": ["1", "99999999999999999999"], "d": ["1", "2.5", "1.5e-3", ".5", "-.5E+7"],
        "t": ["2024-01-01", "2024-01-01 10:00:00.5", "2024-02-29T23:59"], "bad_t": ["2024-01-01", "2024-02-31"], "b": ["true", "FALSE", "True"],
        "s": ["true", "1"], "none": [None, None], "blank": ["", "1"], "mixed": ["2024-01-01", "2024"], "x": ["t", "f"], "nan": ["NaN", "1.0"],
    }
    want = {"i": "integer", "big": "double", "d": "double", "t": "timestamp", "bad_t": "string", "b": "boolean", "s": "string", "none": "string",
            "blank": "string", "mixed": "string", "x": "string", "nan": "string"}
    n = max(map(len, columns.values()))
    rows = [tuple(v[i] if i < len(v) else None for v in columns.values()) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    assert {r.column_name: r.column_type for r in infer_types(df).collect()} == want


def test_partition_scoped_rewrites(spark):
    from sluice.operators.mutate import delete_partitions, update_partitions, upsert_partitions
    from sluice.sinks.writers import overwrite_partitions

    path = tempfile.mkdtemp(prefix="sluice-mut-") + "/t"
    df = spark.createDataFrame([(1, "a", "d1"), (2, "b", "d1"), (3, "c", "d2"), (4, "d", "d3"), (5, "e", None)], "k int, v string, d string")
    overwrite_partitions(df, path, ["d"])
    schema = df.schema
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(path + "/*/part-*")}
    rows = lambda: sorted(map(tuple, spark.read.schema(schema).option("basePath", path).parquet(path).collect()))
    was = files()
    assert [v["d"] for v in update_partitions(spark, path, schema, ["d"], {"v": "z"}, F.col("k") == 1).values()] == ["d1"]
    assert rows() == [(1, "z", "d1"), (2, "b", "d1"), (3, "c", "d2"), (4, "d", "d3"), (5, "e", None)]
    now = files()
    assert {f for f in was if "d=d1" not in f} == {f for f in now if "d=d1" not in f} and all(now[f] == was[f] for f in now if f in was)
    # a row that moves pulls in the partition it moves to, whose rows stay
    assert sorted(v["d"] for v in update_partitions(spark, path, schema, ["d"], {"d": "d2"}, F.col("k") == 2).values()) == ["d1", "d2"]
    assert rows() == [(1, "z", "d1"), (2, "b", "d2"), (3, "c", "d2"), (4, "d", "d3"), (5, "e", None)]
    delete_partitions(spark, path, schema, ["d"], (F.col("d") == "d3") | F.col("d").isNull())
    assert rows() == [(1, "z", "d1"), (2, "b", "d2"), (3, "c", "d2")] and not os.path.exists(path + "/d=d3")
    up = spark.createDataFrame([(3, "n", "d1"), (9, "new", "d9")], "k int, v string, d string")
    upsert_partitions(spark, path, schema, ["d"], up, ["k"])
    assert rows() == [(1, "z", "d1"), (2, "b", "d2"), (3, "n", "d1"), (9, "new", "d9")]
    assert update_partitions(spark, path, schema, ["d"], {"v": "q"}, F.col("k") == 77) == {}
