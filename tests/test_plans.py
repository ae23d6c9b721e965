"""Plan shape: the properties that matter at scale, read from the physical plan."""

import tempfile

from pyspark.sql import functions as F

from sluice.config import Rule
from sluice.functions.rules import compile_rules
from sluice.operators import quality
from sluice.operators.registry import profile
from sluice.sinks.writers import overwrite_partitions
from sluice.sources.tables import read_table
from tests.conftest import SF_SMALL


import re

SHUFFLE = re.compile(r"(?<!Broadcast)Exchange ")


def _shuffles(plan: str) -> int:
    return len(SHUFFLE.findall(plan))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


RULES = (
    Rule("q1", "nn", "o_orderkey", "not_null", 1.0),
    Rule("q2", "rng", "o_totalprice", "range", 0.9, expression="o_totalprice > 0 AND o_totalprice < 400000"),
    Rule("q3", "av", "o_orderstatus", "allowed_values", 0.9, values=("F", "O")),
)


def test_all_rule_metrics_one_scan_one_exchange(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    m = quality.rule_metrics_direct(o, compile_rules(o, RULES))
    plan = _plan(m)
    assert _shuffles(plan) == 1  # the per-rule description is a broadcast of a local table
    assert plan.count("FileScan") == 1
    # column pruning: only the rule columns are read
    assert "o_custkey" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_profile_is_one_aggregate(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    plan = _plan(profile(o))
    assert _shuffles(plan) == 1 and plan.count("FileScan") == 1


def test_samples_limit_before_shuffle(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    compiled = compile_rules(o, RULES)
    s = quality.sample_failures(quality.with_verdict(o, compiled), compiled, "o_orderkey", ["o_orderkey", "o_orderstatus"])
    plan = _plan(s)
    # row_number() <= 3 becomes a partial per-task limit ahead of the exchange
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_partition_filters_reach_the_scan(spark):
    path = tempfile.mkdtemp(prefix="sluice-part-") + "/t"
    e = spark.read.parquet(f"{SF_SMALL}/events.parquet").withColumns(
        {"processing_date": F.date_format("ts", "yyyy-MM-dd"), "source_id": F.lit("s")})
    overwrite_partitions(e, path, ["processing_date", "source_id"])
    schema = spark.read.parquet(path).schema
    df = read_table(spark, path, schema, {"processing_date": "2024-01-15"}, ["event_id"])
    plan = _plan(df)
    assert "PartitionFilters: [isnotnull(processing_date" in plan and "2024-01-15" in plan
    assert "ReadSchema: struct<event_id:bigint>" in plan


def test_filter_pushed_to_parquet(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    from sluice.operators.mapping import equality_filter

    plan = _plan(equality_filter(o, "o_orderstatus", "F").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan
