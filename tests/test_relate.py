"""Foreign-key joins with and without a hot key, against plain joins."""

from pyspark.sql import functions as F

from sluice.operators.relate import fk_join, fk_orphans, flagged_only, group_counts, union_sources
from tests.conftest import SF_SMALL


def _hot_key(spark) -> int:
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    return orders.filter(F.col("o_orderstatus") != "P").agg(F.min("o_orderkey")).first()[0]


def _sides(spark, hot: bool):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    if hot:  # a third of all flags point at one transaction
        li = li.withColumn("l_orderkey", F.when(F.col("l_partkey") % 3 == 0, F.lit(_hot_key(spark))).otherwise(F.col("l_orderkey")))
    flags = li.select(F.col("l_orderkey").alias("transaction_ref"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("p"))
    txns = spark.read.parquet(f"{SF_SMALL}/orders.parquet").filter(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_totalprice").alias("amount"))
    return flags, txns


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_all_join_types_with_and_without_a_hot_key(spark):
    for hot in (False, True):
        flags, txns = _sides(spark, hot)
        plain = flags.join(txns, flags.transaction_ref == txns.transaction_id, "inner")
        split = fk_join(flags, txns, "transaction_ref", "transaction_id")
        assert _same(plain.select(sorted(plain.columns)), split.select(sorted(split.columns)))
        left = fk_join(flags, txns, "transaction_ref", "transaction_id", how="left")
        assert left.count() == flags.count()
        anti = flags.join(txns, flags.transaction_ref == txns.transaction_id, "left_anti")
        assert _same(anti, fk_orphans(flags, txns, "transaction_ref", "transaction_id"))
        semi = txns.join(flags, txns.transaction_id == flags.transaction_ref, "left_semi")
        assert _same(semi, flagged_only(txns, flags, "transaction_id", "transaction_ref"))


def test_answers_do_not_depend_on_the_join_type(spark):
    """Every join type equals DuckDB's, on skewed and NULL keys."""
    import duckdb

    flags, txns = _sides(spark, True)
    flags = flags.withColumn("transaction_ref", F.when(F.col("p") % 11 != 0, F.col("transaction_ref")))
    con = duckdb.connect()
    con.register("f", flags.toPandas())
    con.register("t", txns.toPandas())
    for how in ("inner", "left", "right", "full"):
        got = fk_join(flags, txns, "transaction_ref", "transaction_id", how).count()
        assert got == con.execute(f"SELECT count(*) FROM f {how} JOIN t ON f.transaction_ref = t.transaction_id").fetchone()[0]


def test_union_and_counts(spark):
    a = spark.createDataFrame([(1, "x")], "id int, name string")
    b = spark.createDataFrame([(2,)], "id int")
    u = union_sources({"s1": a, "s2": b})
    assert sorted((r.id, r.name, r.source_id) for r in u.collect()) == [(1, "x", "s1"), (2, None, "s2")]
    g = group_counts(u, ["source_id"], {"named": F.col("name").isNotNull()}).collect()
    assert [(r.source_id, r.rows, r.named) for r in g] == [("s1", 1, 1), ("s2", 1, 0)]
