"""Dedup (F1/F2) against a brute-force reference, with and without a hot key."""

import pandas as pd
from pyspark.sql import functions as F

from sluice.operators.dedup import DUP_FLAG, ROW_ID, dedup_latest, flag_duplicates, uniqueness_report, with_row_id
from tests.conftest import SF_SMALL

ORDER = ["l_shipdate", "l_partkey", "l_suppkey"]
KEYS = ["l_orderkey", "l_linenumber"]


def _brute(pdf: pd.DataFrame) -> set:
    s = pdf.sort_values(ORDER, ascending=False, na_position="last")
    w = s.drop_duplicates(KEYS, keep="first")
    return set(map(tuple, w[KEYS + ORDER].itertuples(index=False)))


def test_dedup_matches_brute_force(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    got = dedup_latest(li, KEYS, ORDER)
    rows = {tuple(r) for r in got.select(*KEYS, *ORDER).collect()}
    want = _brute(li.select(*KEYS, *ORDER).toPandas())
    assert rows == want
    assert got.count() == len(want)


def test_hot_key_third_of_rows(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    hot = F.col("l_partkey") % 3 == 0
    skewed = li.withColumn("l_orderkey", F.when(hot, F.lit(7)).otherwise(F.col("l_orderkey"))) \
               .withColumn("l_linenumber", F.when(hot, F.lit(1)).otherwise(F.col("l_linenumber")))
    n_hot = skewed.filter((F.col("l_orderkey") == 7) & (F.col("l_linenumber") == 1)).count()
    assert n_hot * 4 > li.count()  # the hot key holds about a third of all rows
    flagged = flag_duplicates(with_row_id(skewed), KEYS, ORDER)
    assert flagged.count() == li.count()  # every row comes out once
    winners = flagged.filter(~F.col(DUP_FLAG))
    assert winners.filter((F.col("l_orderkey") == 7) & (F.col("l_linenumber") == 1)).count() == 1
    rows = {tuple(r) for r in winners.select(*KEYS, *ORDER).collect()}
    assert rows == _brute(skewed.select(*KEYS, *ORDER).toPandas())


def test_exact_copies_keep_one(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), ("b", 2), (None, 3), (None, 3)], "k string, v int")
    out = flag_duplicates(with_row_id(df), ["k"], ["v"])
    res = sorted(((r.k, r.v, r[DUP_FLAG]) for r in out.drop(ROW_ID).collect()), key=lambda x: (x[0] or "", x[1], x[2]))
    assert sum(1 for k, v, d in res if k == "a" and not d) == 1
    assert [x for x in res if x[0] is None] == [(None, 3, False), (None, 3, False)]
    assert len(res) == 6


def test_uniqueness_report(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (3,), (3,), (3,)], "k int")
    r = uniqueness_report(df, ["k"]).first()
    assert (r.total_rows, r.distinct_keys, r.duplicate_keys, r.extra_copies) == (6, 3, 2, 3)


def test_latest_agrees_with_flags(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    a = flag_duplicates(with_row_id(li), KEYS, ORDER).filter(~F.col(DUP_FLAG)).select(*KEYS, *ORDER)
    b = dedup_latest(li, KEYS, ORDER)
    assert a.exceptAll(b.select(*KEYS, *ORDER)).count() == 0 and b.select(*KEYS, *ORDER).exceptAll(a).count() == 0
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Exchange hashpartitioning" not in plan  # few copies: winners are broadcast, no row is sorted or shuffled


def test_keys_that_share_a_hash_are_told_apart(spark, monkeypatch):
    from sluice.operators import dedup

    monkeypatch.setattr(dedup, "_hash", lambda keys: F.pmod(F.xxhash64(*keys), F.lit(3)))
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    assert {tuple(r) for r in dedup_latest(li, KEYS, ORDER).select(*KEYS, *ORDER).collect()} == _brute(li.select(*KEYS, *ORDER).toPandas())


def test_latest_keeps_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 3)], "k string, v int")
    assert sorted(((r.k or "", r.v) for r in dedup_latest(df, ["k"], ["v"]).collect())) == [("", 3), ("", 3), ("a", 2)]


def test_hot_key_and_null_keys_are_dealt_over_tasks(spark, monkeypatch):
    from sluice.operators import dedup

    monkeypatch.setattr(dedup, "PART_ROWS", 20, raising=False)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in settings}
    rows = spark.range(0, 3000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 3 == 2, F.col("id") % 500).alias("k"), ((F.col("id") * 7) % 3000).alias("v"))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = flag_duplicates(with_row_id(rows), ["k"], ["v"])
        found = out.withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(found) == 3000
    keyed = found[found.k.notna()]
    kept = keyed[~keyed[DUP_FLAG]]
    assert dict(zip(kept.k, kept.v, strict=True)) == keyed.groupby("k").v.max().to_dict() and len(kept) == keyed.k.nunique()
    assert not found[found.k.isna()][DUP_FLAG].any()
    for group in (found[found.k == -1], found[found.k.isna()]):  # 1000 rows each, no task has most of them
        assert len(group) == 1000 and group.task.value_counts().max() < 300
