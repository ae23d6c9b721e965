"""Poisson mixing: the inversion, the weights and odd rows."""

import math
from collections import Counter

from pyspark.sql import functions as F

from sluice.llm.mixing import DRAWS_AT_ONCE, dealt, identified, mix, poisson_count, poisson_table, source_rates

SCHEMA = "doc_id long, text string, source string, copy string"


def test_inversion_is_a_poisson_distribution(spark):
    rate, u = 2.5, [0.0, 0.05, 0.3, 0.5, 0.9, 0.999, 1 - 2**-52]

    def brute(x):
        term = total = math.exp(-rate)
        k = 0
        while total <= x and k < 200:
            k += 1
            term = term * rate / k
            if total + term == total:
                break
            total += term
        return k

    df = spark.createDataFrame([(x,) for x in u], "u double").select("u", poisson_count(F.col("u"), poisson_table(F.lit(rate))).alias("n"))
    assert [r["n"] for r in df.collect()][:-1] == [brute(x) for x in u][:-1]


def test_weights_are_met_and_the_order_is_global(spark):
    rows = [(i, "abcdefghij", "big" if i % 4 else "small", "x") for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mix(df, {"big": 1, "small": 3}, total=2.0).collect()
    share = Counter(r["source"] for r in out)
    assert abs(share["small"] / 6000 - 1) < 0.1 and abs(share["big"] / 2000 - 1) < 0.1
    assert [r["shuffle_key"] for r in out] == sorted(r["shuffle_key"] for r in out)
    assert len({(r["doc_id"], r["copy"]) for r in out}) == len(out)
    again = mix(df.repartition(7), {"big": 1, "small": 3}, total=2.0).collect()
    assert [(r["doc_id"], r["copy"]) for r in again] == [(r["doc_id"], r["copy"]) for r in out]


def test_high_rates_are_sums(spark):
    df = spark.createDataFrame([(i, "a", "rare", "x") for i in range(50)] + [(100, "b" * 1950, "rest", "x")], SCHEMA)
    rate = {r["source"]: r["rate"] for r in source_rates(df, {"rare": 1.0}).collect()}
    assert rate == {"rare": 40.0, "rest": 0.0}
    counts = Counter(r["doc_id"] for r in mix(df, {"rare": 1.0}).collect())
    assert abs(sum(counts.values()) / 2000 - 1) < 0.1 and 100 not in counts


def test_null_and_repeated_ids_draw_each_and_spread(spark):
    n = 6000
    for shared in (None, 7_000_000):
        for text in (lambda i: f"text {i:05d}", lambda i: "text 00000"):
            rows = [(i if i % 3 else shared, text(i) if i % 3 == 0 else f"text {i:05d}", "a" if i % 2 else "b", "x") for i in range(n)]
            df = spark.createDataFrame(rows, SCHEMA)
            out = mix(df, total=0.5).withColumn("part", F.spark_partition_id()).collect()
            hot = [r for r in out if r["doc_id"] == shared]
            assert abs(len(hot) / (n / 6) - 1) < 0.15, (shared, len(hot))
            for source in ("a", "b"):
                assert abs(sum(r["source"] == source for r in hot) / (n / 12) - 1) < 0.2
            parts = Counter(r["part"] for r in hot)
            assert len(parts) > 1 and max(parts.values()) < 2 * len(hot) / len(parts)
            keys = [r["shuffle_key"] for r in out]
            assert keys == sorted(keys) and len(set(keys)) == len(keys)
            again = mix(df.repartition(7), total=0.5).collect()
            assert [(r["doc_id"], r["text"], r["copy"], r["shuffle_key"]) for r in again] == [(r["doc_id"], r["text"], r["copy"], r["shuffle_key"]) for r in out]


def test_rows_with_an_id_of_their_own_are_as_without_the_others(spark):
    df = spark.createDataFrame([(i, "abcdefghij", "s", "x") for i in range(500)], SCHEMA)
    more = df.unionByName(spark.createDataFrame([(None, "abcdefghij", "s", "x"), (900, "abcdefghij", "s", "x"), (900, "bbcdefghij", "s", "x")], SCHEMA))
    rows = lambda out: [(r["doc_id"], r["copy"], r["shuffle_key"]) for r in out.where("doc_id < 500").collect()]
    assert rows(mix(df)) == rows(mix(more))


def test_numbers_go_on_across_blocks(spark, monkeypatch):
    monkeypatch.setattr("sluice.llm.mixing.BLOCK_BITS", 3)
    df = spark.createDataFrame([(None, "a", "s", "x")] * 100 + [(1, "a", "s", "x")] * 50 + [(2, "a", "s", "x")], SCHEMA)
    found = identified(df).collect()
    assert len({r["_order"] for r in found}) == 151
    assert len({r["_draw"] for r in found if r["doc_id"] is None}) == 100 and len({r["_draw"] for r in found if r["doc_id"] == 1}) == 25


def test_very_many_draws_are_dealt_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a", "rare", "x") for i in range(3)] + [(100, "b" * 997, "rest", "x")], SCHEMA)
    rows = lambda: [(r["doc_id"], r["copy"], r["shuffle_key"]) for r in mix(df, total=1.5).collect()]
    whole = rows()
    assert abs(sum(i < 100 for i, _, _ in whole) / 750 - 1) < 0.15
    monkeypatch.setattr("sluice.llm.mixing.DRAWS_AT_ONCE", 5)
    assert rows() == whole

    monkeypatch.setattr("sluice.llm.mixing.DRAWS_AT_ONCE", DRAWS_AT_ONCE)
    heavy = spark.createDataFrame([("1", 40_000)], "_draw string, _parts long").withColumn("_table", poisson_table(F.lit(8.0)))
    blocks = dealt(heavy, 42, 8).withColumn("part", F.spark_partition_id()).select("_block", "_count", "_first", "part").orderBy("_block").collect()
    assert len(blocks) == -(-40_000 // DRAWS_AT_ONCE) and max(r["_count"] for r in blocks) < 10 * DRAWS_AT_ONCE
    assert [r["_first"] for r in blocks] == [sum(r["_count"] for r in blocks[:k]) for k in range(len(blocks))]
    assert abs(sum(r["_count"] for r in blocks) / 320_000 - 1) < 0.02 and len({r["part"] for r in blocks}) > 1


def test_odd_rows(spark):
    rows = [(1, "abc", None, "x"), (None, "abcd", None, "x"), (2, None, "empty", "x"), (3, "", "empty", "x"), (4, "abcdefg", "s", "x"), (4, "abcdefg", "s", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mix(df, total=5.0)
    assert out.columns == ["doc_id", "text", "source", "copy", "shuffle_key"]
    found = Counter((r["doc_id"], r["source"]) for r in out.collect())
    assert all(i != 2 and i != 3 for i, _ in found) and (None, None) in found and (1, None) in found
    assert found[(4, "s")] % 2 == 0
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mix(df, {}).collect() == []
