"""Unit tests per operator on literal rows (null, empty, boundary, bad-cast cases)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.config import Rule, config_frame, has_rule, mapping_frame, rules_frame, validate_configs
from sluice.functions.casting import safe_cast
from sluice.functions.masking import is_masked, mask_sha256
from sluice.functions.rules import compile_rules, rule_expression_text
from sluice.functions.timefmt import lenient_pattern, parse_timestamp, to_utc
from sluice.operators import quality
from sluice.operators.convert import convert_currency, normalise_status
from sluice.operators.mapping import CAST_FAILURES, conform, map_columns, pad_columns


def test_rule_null_semantics(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-1.0,)], "amount double")
    rules = [Rule("r1", "nn", "amount", "not_null", 1.0),
             Rule("r2", "pos", "amount", "range", 1.0, expression="amount > 0"),
             Rule("r3", "av", "amount", "allowed_values", 1.0, values=("5.0",)),
             Rule("r4", "re", "amount", "regex", 1.0, expression="^5")]
    v = quality.with_verdict(df, compile_rules(df, rules))
    got = [list(r[quality.FAILED]) for r in v.collect()]
    assert got == [["r1"], [], ["r2", "r3", "r4"]]  # NULL fails only not_null


def test_range_bounds_open_and_closed(spark):
    df = spark.createDataFrame([(50000.0,), (20000.0,), (0.0,)], "a double")
    rules = [Rule("o", "open", "a", "range", 1.0, expression="a > 0 AND a < 50000"),
             Rule("c", "closed", "a", "range", 1.0, expression="a > 0 AND a <= 20000")]
    v = quality.with_verdict(df, compile_rules(df, rules))
    assert [list(r[quality.FAILED]) for r in v.collect()] == [["o", "c"], [], ["o", "c"]]


def test_custom_modulo_and_unknown_column_is_setup_error(spark):
    df = spark.createDataFrame([(100.0,), (75.0,)], "amount_sgd double")
    rules = [Rule("r15", "m50", "amount_sgd", "custom", 0.96, expression="amount_sgd % 50 = 0"),
             Rule("bad", "bad", "nope", "custom", 1.0, expression="nope > 1")]
    compiled = compile_rules(df, rules)
    assert compiled[0].error is None and compiled[1].error is not None
    broken = compile_rules(df, [Rule("p", "p", "amount_sgd", "custom", 1.0, expression="amount_sgd >>> (")])
    assert broken[0].error is not None
    m = quality.rule_metrics_direct(df, compiled).orderBy("rule_id").collect()
    assert (m[0].rule_id, m[0].passed_rows, m[0].rule_passed) == ("bad", None, False)
    assert (m[1].failed_rows, m[1].pass_rate, m[1].rule_passed) == (1, 0.5, False)


def test_metrics_empty_input_pass(spark):
    df = spark.createDataFrame([], "a double")
    m = quality.rule_metrics_direct(df, compile_rules(df, [Rule("r", "r", "a", "not_null", 1.0)])).first()
    assert (m.total_rows, m.pass_rate, m.rule_passed) == (0, 1.0, True)


def test_expression_text():
    assert rule_expression_text(Rule("a", "a", "s", "allowed_values", 1, values=("X", "Y"))) == "s IN ('X', 'Y')"
    assert rule_expression_text(Rule("a", "a", "s", "regex", 1, expression="^[A-Z]{2}$")) == "s RLIKE '^[A-Z]{2}$'"
    assert rule_expression_text(Rule("a", "a", "s", "not_null", 1)) == "s IS NOT NULL"


def test_safe_cast_guards(spark):
    df = spark.createDataFrame([("12",), ("abc",), ("NaN",), ("5d",), (" 7 ",), (None,), ("1e3",)], "x string")
    out = df.select(safe_cast(F.col("x"), T.DoubleType()).alias("d"), safe_cast(F.col("x"), T.IntegerType()).alias("i"))
    rows = [(r.d, r.i) for r in out.collect()]
    assert rows == [(12.0, 12), (None, None), (None, None), (None, None), (7.0, 7), (None, None), (1000.0, None)]


def test_safe_cast_boolean_strict(spark):
    df = spark.createDataFrame([("true",), ("FALSE",), ("1",), ("Y",)], "x string")
    assert [r[0] for r in df.select(safe_cast(F.col("x"), T.BooleanType())).collect()] == [True, False, None, None]


def test_conform_maps_pads_and_lists_cast_failures(spark):
    raw = spark.createDataFrame([("U1", "abc", "2026-01-01 10:00:00", "x")], "id string, amt string, ts string, extra string")
    target = T.StructType([T.StructField("transaction_id", T.StringType()), T.StructField("amount", T.DoubleType()),
                           T.StructField("ts", T.TimestampType()), T.StructField("missing", T.IntegerType())])
    out = conform(raw, {"id": "transaction_id", "amt": "amount", "ts": "ts"}, target, {"ts": "yyyy-MM-dd HH:mm:ss"})
    r = out.first()
    assert out.columns == ["transaction_id", "amount", "ts", "missing", CAST_FAILURES]
    assert r.amount is None and r.missing is None and list(r[CAST_FAILURES]) == ["cast:amount"]
    assert r.ts == dt.datetime(2026, 1, 1, 10, 0)


def test_map_and_pad(spark):
    df = spark.createDataFrame([(1, "a", "Y")], "txn_ref int, vendor string, upi_flag string")
    m = map_columns(df, {"txn_ref": "transaction_id", "vendor": "merchant_name"})
    assert m.columns == ["transaction_id", "merchant_name"]  # unmapped upi_flag dropped
    p = pad_columns(m, [T.StructField("transaction_id", T.IntegerType()), T.StructField("is_international", T.IntegerType())])
    assert p.first().is_international is None and dict(p.dtypes)["is_international"] == "int"


def test_timestamp_patterns(spark):
    assert lenient_pattern("yyyy-MM-dd'T'HH:mm:ss") == "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
    assert lenient_pattern("dd/MM/yyyy HH:mm") == "dd/MM/yyyy HH:mm"
    df = spark.createDataFrame([("2026-01-01T10:00:00.123456",), ("2026-01-01T10:00:00",), ("junk",)], "t string")
    got = [r[0] for r in df.select(parse_timestamp(F.col("t"), "yyyy-MM-dd'T'HH:mm:ss")).collect()]
    assert got == [dt.datetime(2026, 1, 1, 10, 0, 0, 123456), dt.datetime(2026, 1, 1, 10, 0), None]


def test_utc_normalisation(spark):
    df = spark.createDataFrame([("2026-01-01 09:05:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    assert df.select(to_utc(F.col("t"), "Asia/Kolkata")).first()[0] == dt.datetime(2026, 1, 1, 3, 35)


def test_currency_and_status(spark):
    df = spark.createDataFrame([("a", 1000.0, "success"), ("b", 5.0, "weird")], "id string, original_amount double, status string")
    rates = spark.createDataFrame([("INR", dt.date(2025, 1, 1), 0.011), ("INR", dt.date(2026, 1, 1), 0.012),
                                   ("INR", dt.date(2027, 1, 1), 0.5)], "currency string, as_of_date date, rate_to_usd double")
    out = normalise_status(convert_currency(df, rates, "original_amount", F.lit("INR"), as_of="2026-06-01"), "status")
    rows = {r.id: r for r in out.collect()}
    assert rows["a"].amount_usd == 12.0 and rows["a"].source_currency == "INR" and rows["a"].status == "APPROVED"
    assert rows["b"].amount_usd == 0.06 and rows["b"].status == "weird"


def test_masking(spark):
    df = spark.createDataFrame([("4000000000000001",)], "c string")
    r = df.select(mask_sha256(F.col("c")).alias("h")).select("h", is_masked(F.col("h")).alias("ok")).first()
    import hashlib

    assert r.h == hashlib.sha256(b"4000000000000001").hexdigest()[:16] and r.ok


def test_config_json_parsing_and_validation(spark):
    cfg = config_frame(spark)
    assert rules_frame(cfg).count() == 18
    assert mapping_frame(cfg).filter("source_id = 'src_in_card_txns'").count() == 6
    assert has_rule(cfg, "r014").filter("has_rule").select("source_id").first()[0] == "src_atm_sg"
    assert validate_configs(cfg).count() == 0
    bad = cfg.withColumn("dq_rules_json", F.lit(
        '[{"rule_id":"x1","rule_name":"a","column":"zzz","type":"rangee","threshold":1.5},'
        '{"rule_id":"x1","rule_name":"b","column":"amount_usd","type":"allowed_values","threshold":1}]'))
    problems = {(r.source_id, r.rule_id, r.problem) for r in validate_configs(bad.filter("source_id='src_us_card_txns'")).collect()}
    assert ("src_us_card_txns", "x1", "duplicate rule id") in problems
    assert ("src_us_card_txns", "x1", "unknown rule type: rangee") in problems
    assert ("src_us_card_txns", "x1", "threshold outside [0, 1]") in problems
    assert ("src_us_card_txns", "x1", "column not mapped: zzz") in problems
    assert ("src_us_card_txns", "x1", "values missing") in problems


def test_summary_row_level_rejects(spark):
    # a row failing two rules is rejected once
    df = spark.createDataFrame([(None, "BAD"), ("a", "OK")], "id string, s string")
    rules = [Rule("r1", "nn", "id", "not_null", 1.0), Rule("r2", "av", "s", "allowed_values", 0.5, values=("OK",))]
    compiled = compile_rules(df, rules)
    v = quality.with_verdict(df, compiled)
    s = quality.summary(quality.quality_counts(v, compiled), compiled).first()
    assert (s.total_rows_ingested, s.total_rows_passed, s.total_rows_rejected) == (2, 1, 1)
    assert (s.rules_checked, s.rules_passed, s.rules_failed, s.ingestion_status) == (2, 1, 1, "PARTIAL")


@pytest.mark.parametrize("written,failed,status", [(0, 0, "FAILED"), (3, 1, "PARTIAL"), (3, 0, "SUCCESS")])
def test_status(spark, written, failed, status):
    df = spark.range(1).select(F.lit(written).alias("w"), F.lit(failed).alias("f"))
    assert df.select(quality.ingestion_status(F.col("w"), F.col("f"))).first()[0] == status
