"""Driver queries: each engine operator run over the shared test tables.

The financial feeds of the data model are not among the test tables, so the
operators run on stand-ins (orders as card transactions, customer as merchant
reference data, lineitem as a feed with duplicate keys, events as fraud
flags, part as a regex target).  Every query reads whole tables; each has an
equivalent SQL text in ``sluice.plans.oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.config import Rule
from sluice.functions.rules import compile_rules
from sluice.operators import quality
from sluice.operators.mapping import map_columns
from sluice.plans.assess import assess
from sluice.session import ensure_settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_settings(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------------------
# Stand-in feeds (raw name -> silver name)
# ---------------------------------------------------------------------------
ORDERS_MAP = {
    "o_orderkey": "transaction_id",
    "o_custkey": "card_identifier",
    "o_totalprice": "original_amount",
    "o_orderdate": "transaction_ts",
    "o_orderstatus": "status",
}
CUSTOMER_MAP = {
    "c_custkey": "merchant_id",
    "c_name": "business_name",
    "c_mktsegment": "merchant_category",
    "c_acctbal": "account_balance",
    "c_nationkey": "nation_id",
}
LINEITEM_MAP = {
    "l_orderkey": "withdrawal_id",
    "l_linenumber": "line_no",
    "l_partkey": "atm_id",
    "l_suppkey": "location_id",
    "l_quantity": "amount_sgd",
    "l_shipdate": "withdrawal_ts",
    "l_returnflag": "dispense_status",
}
EVENTS_MAP = {
    "event_id": "flag_id",
    "user_id": "reference",
    "value": "score",
    "event_type": "flag_type",
    "ts": "flagged_at",
}
PART_MAP = {"p_partkey": "part_id", "p_brand": "brand", "p_name": "part_name"}

ORDER_RULES = (
    Rule("q001", "transaction_id_not_null", "transaction_id", "not_null", 1.0),
    Rule("q002", "amount_positive", "original_amount", "range", 0.99, expression="original_amount > 0 AND original_amount < 400000"),
    Rule("q003", "status_valid", "status", "allowed_values", 0.98, values=("F", "O")),
    Rule("q004", "status_format", "status", "regex", 0.99, expression="^[A-Z]$"),
    Rule("q005", "card_even", "card_identifier", "custom", 0.4, expression="card_identifier % 2 = 0"),
)
CUSTOMER_RULES = (
    Rule("m001", "merchant_id_not_null", "merchant_id", "not_null", 1.0),
    Rule("m002", "balance_positive", "account_balance", "range", 0.95, expression="account_balance > 0"),
    Rule("m003", "segment_valid", "merchant_category", "allowed_values", 0.5,
         values=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")),
)
LINEITEM_RULES = (
    Rule("a001", "withdrawal_id_not_null", "withdrawal_id", "not_null", 1.0),
    Rule("a002", "amount_multiple_of_5", "amount_sgd", "custom", 0.2, expression="amount_sgd % 5 = 0"),
    Rule("a003", "amount_positive", "amount_sgd", "range", 0.99, expression="amount_sgd > 0 AND amount_sgd <= 45"),
)
LINEITEM_KEYS = ["withdrawal_id", "line_no"]
LINEITEM_ORDER = ["withdrawal_ts", "atm_id", "location_id"]

METRIC_COLUMNS = (
    "rule_id", "rule_name", "rule_type", "rule_expression", "column_name",
    "total_rows", "passed_rows", "failed_rows", "pass_rate", "threshold", "rule_passed",
)


def orders_feed(spark, sf_dir) -> DataFrame:
    return map_columns(table(spark, sf_dir, "orders"), ORDERS_MAP)


def customer_feed(spark, sf_dir) -> DataFrame:
    return map_columns(table(spark, sf_dir, "customer"), CUSTOMER_MAP)


def lineitem_feed(spark, sf_dir) -> DataFrame:
    return map_columns(table(spark, sf_dir, "lineitem"), LINEITEM_MAP)


def events_feed(spark, sf_dir) -> DataFrame:
    return map_columns(table(spark, sf_dir, "events"), EVENTS_MAP)


STANDIN_FEEDS = {
    "src_orders": orders_feed,
    "src_customer": customer_feed,
    "src_lineitem": lineitem_feed,
    "src_events": events_feed,
}


def standin_configs():
    """Config rows describing the stand-in feeds (parquet tables)."""
    from sluice.config import SourceConfig

    def cfg(source_id, name, stype, tbl, mapping, pk, date_col, rules, target, active=True):
        return SourceConfig(
            source_id=source_id, source_name=name, source_type=stype,
            raw_path="{root}/" + tbl + ".parquet", file_format="parquet", delimiter=",", has_header=True,
            date_column=date_col, date_format="yyyy-MM-dd HH:mm:ss", primary_key_column=pk,
            target_table=target, silver_path="{root}/silver/" + tbl + "/", rejected_path="{root}/rejected/" + tbl + "/",
            rules=tuple(rules), column_mapping=tuple(mapping.items()), is_active=active,
        )

    return (
        cfg("src_orders", "Orders as card transactions", "card_transactions", "orders", ORDERS_MAP, "o_orderkey", "o_orderdate", ORDER_RULES, "card_transactions_silver"),
        cfg("src_customer", "Customers as merchants", "merchant", "customer", CUSTOMER_MAP, "c_custkey", "c_custkey", CUSTOMER_RULES, "merchant_silver"),
        cfg("src_lineitem", "Line items as ATM withdrawals", "atm", "lineitem", LINEITEM_MAP, "l_orderkey", "l_shipdate", LINEITEM_RULES, "atm_silver"),
        cfg("src_events", "Events as fraud flags", "fraud_flags", "events", EVENTS_MAP, "event_id", "ts", (), "fraud_flags_silver", active=False),
    )


def standin_config_frame(spark) -> DataFrame:
    from sluice.config import config_frame

    return config_frame(spark, standin_configs())


def _metrics(df: DataFrame, rules) -> DataFrame:
    m = quality.rule_metrics_direct(df, compile_rules(df, rules))
    return m.withColumn("pass_rate", F.round("pass_rate", 4)).select(*METRIC_COLUMNS)


# ---------------------------------------------------------------------------
# Rule types, metrics, verdict, samples, summary
# ---------------------------------------------------------------------------
@query
def dq_metrics_all(spark, sf_dir):
    """Five rules of five types over one source, one aggregate."""
    return _metrics(orders_feed(spark, sf_dir), ORDER_RULES)


@query
def dq_not_null(spark, sf_dir):
    """not_null with a tolerance threshold (``error`` events read as NULL)."""
    df = events_feed(spark, sf_dir).withColumn("flag_type", F.nullif(F.col("flag_type"), F.lit("error")))
    rules = (Rule("n001", "flag_type_not_null", "flag_type", "not_null", 0.75),
             Rule("n002", "flag_id_not_null", "flag_id", "not_null", 1.0))
    return _metrics(df, rules)


@query
def dq_range(spark, sf_dir):
    """Open and closed bounds."""
    rules = (Rule("g001", "amount_open_range", "original_amount", "range", 0.8, expression="original_amount > 0 AND original_amount < 400000"),
             Rule("g002", "amount_closed_range", "original_amount", "range", 0.5, expression="original_amount >= 100000 AND original_amount <= 300000"))
    return _metrics(orders_feed(spark, sf_dir), rules)


@query
def dq_allowed_values(spark, sf_dir):
    """Membership in a value list."""
    rules = (Rule("v001", "status_final_or_open", "status", "allowed_values", 0.9, values=("F", "O")),
             Rule("v002", "status_any", "status", "allowed_values", 1.0, values=("F", "O", "P")))
    return _metrics(orders_feed(spark, sf_dir), rules)


@query
def dq_regex(spark, sf_dir):
    """Anchored pattern on text."""
    df = map_columns(table(spark, sf_dir, "part"), PART_MAP)
    rules = (Rule("x001", "brand_one_digit", "brand", "regex", 0.5, expression="^Brand#[0-9]$"),
             Rule("x002", "brand_format", "brand", "regex", 0.99, expression="^Brand#[0-9]+$"))
    return _metrics(df, rules)


@query
def dq_custom(spark, sf_dir):
    """E5: free SQL predicate (modulo on doubles)."""
    rules = (Rule("c001", "amount_multiple_of_5", "amount_sgd", "custom", 0.2, expression="amount_sgd % 5 = 0"),
             Rule("c002", "tax_small", "amount_sgd", "custom", 0.9, expression="amount_sgd * 2 < 90"))
    return _metrics(lineitem_feed(spark, sf_dir), rules)


@query
def dq_row_verdict(spark, sf_dir):
    """E6 + E14: per-row failed rule list and pass flag."""
    df = orders_feed(spark, sf_dir)
    v = quality.with_verdict(df, compile_rules(df, ORDER_RULES))
    return v.select(
        "transaction_id",
        F.array_join(quality.FAILED, ",").alias("failed_rules"),
        quality.passed(v).alias("dq_passed"),
    )


@query
def dq_sample_failures(spark, sf_dir):
    """E9 + D3: up to three failing rows per rule as JSON text."""
    df = orders_feed(spark, sf_dir)
    v = quality.with_verdict(df, compile_rules(df, ORDER_RULES))
    return quality.sample_failures(
        v, compile_rules(df, ORDER_RULES), "transaction_id", ["transaction_id", "card_identifier", "status"]
    )


@query
def dq_summary(spark, sf_dir):
    """E11 + E12: one summary row per source (orders, customer)."""
    out = None
    for source_id, df, rules, keys in (
        ("src_orders", orders_feed(spark, sf_dir), ORDER_RULES, ["transaction_id"]),
        ("src_customer", customer_feed(spark, sf_dir), CUSTOMER_RULES, ["merchant_id"]),
    ):
        compiled = compile_rules(df, rules)
        v = assess(df, compiled, keys=keys, order=[])
        s = quality.summary(quality.quality_counts(v, compiled), compiled)
        s = s.select(F.lit(source_id).alias("source_id"), "*").withColumn("overall_pass_rate", F.round("overall_pass_rate", 4))
        out = s if out is None else out.unionByName(s)
    return out


# ---------------------------------------------------------------------------
# Mapping, casts, time, currency, status, audit, masking, filters
# ---------------------------------------------------------------------------
@query
def column_mapping(spark, sf_dir):
    """C1 + C2: rename to silver names, drop unmapped, pad missing targets."""
    from sluice.operators.mapping import pad_columns
    from sluice.schemas import data_fields

    return pad_columns(orders_feed(spark, sf_dir), data_fields("card_transactions_silver"))


@query
def safe_cast(spark, sf_dir):
    """Text feed cast to a target schema; failures listed per row."""
    from pyspark.sql import types as T

    from sluice.operators.mapping import CAST_FAILURES, conform

    raw = table(spark, sf_dir, "part").select(*[F.col(c).cast("string").alias(c) for c in ("p_partkey", "p_name", "p_size", "p_retailprice")])
    target = T.StructType([
        T.StructField("part_id", T.LongType()),
        T.StructField("part_name", T.DoubleType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("retail_price", T.DoubleType()),
    ])
    mapping = {"p_partkey": "part_id", "p_name": "part_name", "p_size": "size", "p_retailprice": "retail_price"}
    out = conform(raw, mapping, target)
    return out.withColumn("cast_failures", F.array_join(CAST_FAILURES, ",")).drop(CAST_FAILURES)


def _orders_text_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    txt = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(
        F.date_format("o_orderdate", "dd/MM/yyyy HH:mm"))
    return o.select(F.col("o_orderkey").alias("transaction_id"), txt.alias("raw_ts"))


@query
def timestamp_parse(spark, sf_dir):
    """C4: per-source pattern (``dd/MM/yyyy HH:mm``); other shapes give NULL."""
    from sluice.functions.timefmt import parse_timestamp

    df = _orders_text_dates(spark, sf_dir)
    return df.withColumn("transaction_ts", parse_timestamp(F.col("raw_ts"), "dd/MM/yyyy HH:mm").cast("timestamp_ntz"))


@query
def date_parse(spark, sf_dir):
    """Date from a date-only pattern; other shapes give NULL."""
    from sluice.functions.timefmt import parse_date

    df = _orders_text_dates(spark, sf_dir)
    return df.withColumn("onboarded_date", parse_date(F.col("raw_ts"), "yyyy-MM-dd"))


@query
def iso_fraction_parse(spark, sf_dir):
    """C4, trap: ISO text with and without microseconds under one seconds pattern."""
    from sluice.functions.timefmt import parse_timestamp

    e = table(spark, sf_dir, "events")
    txt = F.when(F.col("event_id") % 2 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select(
        F.col("event_id").alias("flag_id"),
        parse_timestamp(txt, "yyyy-MM-dd'T'HH:mm:ss").cast("timestamp_ntz").alias("flagged_at"),
    )


@query
def utc_normalise(spark, sf_dir):
    """Naive Asia/Kolkata wall-clock times to UTC."""
    from sluice.functions.timefmt import to_utc

    e = events_feed(spark, sf_dir)
    return e.select("flag_id", "flagged_at", to_utc(F.col("flagged_at").cast("timestamp"), "Asia/Kolkata").cast("timestamp_ntz").alias("flagged_at_utc"))


# FIXED VALUES (stand-in only): currency per order status and a rates table.
STANDIN_CURRENCY = {"F": "USD", "O": "INR", "P": "SGD"}
STANDIN_RATES = [
    ("USD", "2020-01-01", 1.0),
    ("INR", "2020-01-01", 0.0125),
    ("INR", "2024-01-01", 0.012),
    ("INR", "2025-01-01", 0.0115),
    ("SGD", "2020-01-01", 0.74),
]


def rates_frame(spark) -> DataFrame:
    from sluice.session import local_frame

    return local_frame(spark, STANDIN_RATES, "currency string, as_of_date string, rate_to_usd double").withColumn(
        "as_of_date", F.to_date("as_of_date"))


@query
def currency_convert(spark, sf_dir):
    """Amounts to USD at the rate in force on the processing date."""
    from sluice.operators.convert import convert_currency

    o = orders_feed(spark, sf_dir)
    cur = F.create_map(*[F.lit(x) for kv in STANDIN_CURRENCY.items() for x in kv])[F.col("status")]
    out = convert_currency(o, rates_frame(spark), "original_amount", cur, as_of="2024-06-30")
    return out.select("transaction_id", "source_currency", "original_amount", "amount_usd")


@query
def status_normalise(spark, sf_dir):
    """Feed status vocabulary to silver vocabulary; unknown values kept."""
    from sluice.operators.convert import normalise_status

    o = orders_feed(spark, sf_dir).select("transaction_id", F.col("status").alias("raw_status"))
    return normalise_status(o, "raw_status", {"F": "APPROVED", "O": "PENDING"}, out="status")


@query
def audit_columns(spark, sf_dir):
    """Audit and partition columns with fixed run literals."""
    from sluice.operators.mapping import with_audit_columns

    o = orders_feed(spark, sf_dir).select("transaction_id", "status")
    stamp = F.to_timestamp(F.lit("2024-01-01 06:00:00"))
    out = with_audit_columns(o, "run-0001", "2024-01-01", "src_orders", ingested_at=stamp)
    return out.withColumn("ingested_at", F.col("ingested_at").cast("timestamp_ntz"))


@query
def mask_hash(spark, sf_dir):
    """Truncated SHA-256 and its format check."""
    from sluice.functions.masking import is_masked, mask_sha256

    c = table(spark, sf_dir, "customer")
    m = mask_sha256(F.col("c_name"))
    return c.select(F.col("c_custkey").alias("merchant_id"), m.alias("name_hash"), is_masked(m).alias("hash_ok"))


@query
def filter_project(spark, sf_dir):
    """C11 + C12 + C13: equality filter, aliased literal, query timestamp."""
    from sluice.operators.mapping import equality_filter, with_current_timestamp, with_literals

    o = equality_filter(orders_feed(spark, sf_dir), "status", "F").select("transaction_id", "status")
    o = with_current_timestamp(with_literals(o, {"feed": "card"}))
    return o.withColumn("stamped", F.col("stamped_at").isNotNull()).drop("stamped_at")


# ---------------------------------------------------------------------------
# JSON
# ---------------------------------------------------------------------------
@query
def json_object_parse(spark, sf_dir):
    """D2 on a data column: a JSON object to one (key, value) row per entry."""
    from sluice.config import MAPPING_SCHEMA

    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.explode(F.from_json("props", MAPPING_SCHEMA)).alias("prop_key", "prop_value"))


@query
def config_rules_parse(spark, sf_dir):
    """D1 + D5 + A8: rules exploded from the config table drive the run.

    The stand-in config rows are parsed on the executors, the active ones are
    collected (one row per source), and each rule's failures are measured on
    its source table.
    """
    from sluice.config import active_configs, has_rule, rules_frame

    cfg = standin_config_frame(spark)
    parsed = rules_frame(cfg).select("source_id", "rule_id", F.col("type").alias("rule_type"), "threshold")
    probe = has_rule(cfg, "q003").select("source_id", F.col("has_rule").alias("has_q003"))
    measured = None
    for c in active_configs(cfg):
        df = STANDIN_FEEDS[c.source_id](spark, sf_dir)
        m = quality.rule_metrics_direct(df, compile_rules(df, c.rules)).select(
            F.lit(c.source_id).alias("source_id"), "rule_id", "failed_rows")
        measured = m if measured is None else measured.unionByName(m)
    return parsed.join(probe, "source_id").join(measured, ["source_id", "rule_id"], "left")


# ---------------------------------------------------------------------------
# Dedup, union, joins, counts, sort
# ---------------------------------------------------------------------------
@query
def dedup_latest(spark, sf_dir):
    """one row per key, the newest (then greatest) copy wins."""
    from sluice.operators.dedup import dedup_latest as dedup

    li = lineitem_feed(spark, sf_dir)
    return dedup(li, LINEITEM_KEYS, LINEITEM_ORDER)


@query
def dup_report(spark, sf_dir):
    """keys with more than one row."""
    from sluice.operators.dedup import duplicate_keys

    return duplicate_keys(lineitem_feed(spark, sf_dir), LINEITEM_KEYS)


@query
def key_uniqueness(spark, sf_dir):
    """rows vs distinct keys in one row."""
    from sluice.operators.dedup import uniqueness_report

    return uniqueness_report(lineitem_feed(spark, sf_dir), LINEITEM_KEYS)


@query
def union_sources(spark, sf_dir):
    """two feeds in one table, told apart by ``source_id``."""
    from sluice.operators.relate import union_sources as union

    c = map_columns(table(spark, sf_dir, "customer"), {"c_custkey": "party_id", "c_name": "name", "c_acctbal": "balance", "c_mktsegment": "segment"})
    s = map_columns(table(spark, sf_dir, "supplier"), {"s_suppkey": "party_id", "s_name": "name", "s_acctbal": "balance"})
    return union({"src_customer": c, "src_supplier": s})


def _fk_sides(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("transaction_ref"), F.col("l_linenumber").alias("flag_line"), F.col("l_quantity").alias("fraud_score"))
    # Only settled orders (status F or O) reach the transactions table; flags on
    # pending orders are the orphans.
    txns = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"))
    return flags, txns


@query
def fk_join(spark, sf_dir):
    """flags to transactions, 1:N equi-join."""
    from sluice.operators.relate import fk_join as join

    flags, txns = _fk_sides(spark, sf_dir)
    return join(flags, txns, "transaction_ref", "transaction_id")


@query
def fk_orphans(spark, sf_dir):
    """flags whose transaction does not exist."""
    from sluice.operators.relate import fk_orphans as orphans

    flags, txns = _fk_sides(spark, sf_dir)
    return orphans(flags, txns, "transaction_ref", "transaction_id")


@query
def fk_semi(spark, sf_dir):
    """transactions with at least one flag."""
    from sluice.operators.relate import flagged_only

    flags, txns = _fk_sides(spark, sf_dir)
    return flagged_only(txns, flags, "transaction_id", "transaction_ref")


@query
def dashboard_counts(spark, sf_dir):
    """F8 + F9 + F10: counts per day and type, with a predicate, sorted."""
    from sluice.operators.relate import group_counts

    e = events_feed(spark, sf_dir).withColumn("flag_date", F.to_date("flagged_at"))
    return group_counts(e, ["flag_date", "flag_type"], {"high_score_rows": F.col("score") > 50})


@query
def reconcile(spark, sf_dir):
    """G1 + G2: rows read = written + rejected, with rules and dedup."""
    from sluice.operators.lineage import row_counts

    li = lineitem_feed(spark, sf_dir)
    compiled = compile_rules(li, LINEITEM_RULES)
    v = assess(li, compiled, keys=LINEITEM_KEYS, order=LINEITEM_ORDER)
    return row_counts(v)


# ---------------------------------------------------------------------------
# H1-H7: registry and drift
# ---------------------------------------------------------------------------
def _round_rate(df: DataFrame, col: str = "null_rate") -> DataFrame:
    return df.withColumn(col, F.round(col, 4))


@query
def profile_columns(spark, sf_dir):
    """H1: one row per column -- type, nullability, null rate, min, max."""
    from sluice.operators.registry import profile

    return _round_rate(profile(orders_feed(spark, sf_dir)))


@query
def sample_values(spark, sf_dir):
    """H2: up to ten values per column, most frequent first."""
    from sluice.operators.registry import sample_values as samples

    p = map_columns(table(spark, sf_dir, "part"), {"p_brand": "brand", "p_type": "part_type", "p_size": "size", "p_partkey": "part_id"})
    return samples(p)


@query
def infer_types(spark, sf_dir):
    """H3: narrowest logical type of text columns."""
    from sluice.operators.registry import infer_types as infer

    p = table(spark, sf_dir, "part")
    o = table(spark, sf_dir, "orders")
    text_p = p.select(*[F.col(c).cast("string").alias(c) for c in p.columns])
    text_o = o.select(F.col("o_orderkey").cast("string").alias("o_orderkey"),
                      F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
                      F.when(F.col("o_orderstatus") == "F", "true").otherwise("false").alias("o_is_final"),
                      F.col("o_totalprice").cast("string").alias("o_totalprice"))
    return infer(text_p).unionByName(infer(text_o))


def _orders_snapshots(spark, sf_dir):
    """Two snapshots of the orders feed: before 1998, and from 1998 with a changed schema."""
    from sluice.operators.registry import profile

    o = orders_feed(spark, sf_dir)
    old = o.filter(F.col("transaction_ts") < F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
    new = (o.filter(F.col("transaction_ts") >= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
           .withColumn("original_amount", F.col("original_amount").cast("string"))
           .withColumn("status", F.when(F.col("status") != "P", F.col("status")))
           .drop("card_identifier")
           .withColumn("channel", F.lit("web")))
    return profile(old), profile(new)


@query
def schema_drift(spark, sf_dir):
    """H5: added / removed / retyped / nullability-changed columns."""
    from sluice.operators.registry import schema_drift as drift

    old, new = _orders_snapshots(spark, sf_dir)
    return drift(old, new)


@query
def value_drift(spark, sf_dir):
    """H6: null-rate and min/max change between snapshots."""
    from sluice.operators.registry import value_drift as drift

    old, new = _orders_snapshots(spark, sf_dir)
    return drift(old, new).withColumn("null_rate_delta", F.round("null_rate_delta", 4))


@query
def registry_version_match(spark, sf_dir):
    """F7 + H4 + H7: registry snapshots joined to the config's current version."""
    from sluice.config import config_frame
    from sluice.operators.registry import bump_versions, snapshot
    from sluice.operators.relate import version_match

    o = orders_feed(spark, sf_dir)
    stamp = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    v1 = snapshot(o.filter(F.col("transaction_ts") < F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")), "src_orders", 1, stamp, with_samples=False)
    v2 = snapshot(o.filter(F.col("transaction_ts") >= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")), "src_orders", 2, stamp, with_samples=False)
    registry = v1.unionByName(v2)
    stored = config_frame(spark, standin_configs())
    changed_rules = F.when(F.col("source_id") == "src_orders", F.concat(F.col("dq_rules_json"), F.lit(" "))).otherwise(F.col("dq_rules_json"))
    incoming = stored.withColumn("dq_rules_json", changed_rules)
    current = bump_versions(stored, incoming)
    return _round_rate(version_match(registry, current).select(
        "source_id", "column_name", "column_type", "null_rate", "min_value", "max_value", "schema_version"))


# ---------------------------------------------------------------------------
# Snapshots and mutation
# ---------------------------------------------------------------------------
@query
def snapshot_latest(spark, sf_dir):
    """Reference data overwritten per run -- newest snapshot per source."""
    from sluice.sources.tables import latest_snapshot

    c = customer_feed(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("merchant_id"),
                                              F.date_format("o_orderdate", "yyyy").alias("processing_date"))
    snaps = o.join(c, "merchant_id").withColumn("source_id", F.concat(F.lit("seg_"), F.lower("merchant_category")))
    return latest_snapshot(snaps).groupBy("source_id", "processing_date").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("merchant_id").alias("merchants"))


@query
def update_rows(spark, sf_dir):
    """UPDATE ... SET ... WHERE."""
    from sluice.operators.mutate import update_rows as update

    c = customer_feed(spark, sf_dir)
    return update(c, {"account_balance": 0.0, "business_name": F.upper("business_name")}, F.col("merchant_category") == "BUILDING")


@query
def delete_rows(spark, sf_dir):
    """DELETE ... WHERE (a NULL condition keeps the row)."""
    from sluice.operators.mutate import delete_rows as delete

    return delete(customer_feed(spark, sf_dir), F.col("account_balance") < 0)


@query
def upsert_rows(spark, sf_dir):
    """MERGE by key -- matched rows updated, new keys inserted."""
    from sluice.operators.mutate import upsert

    c = customer_feed(spark, sf_dir)
    target = c.filter(F.col("account_balance") >= 0)
    updates = c.filter(F.col("merchant_category") == "BUILDING").withColumn("account_balance", F.col("account_balance") + 100)
    return upsert(target, updates, ["merchant_id"])


@query
def truncate_reload(spark, sf_dir):
    """I4 + I5: load, update, delete as committed versions; read the newest."""
    from sluice.operators.mutate import commit_snapshot, delete_rows as delete, read_snapshot, update_rows as update
    from sluice.session import scratch_path

    path = scratch_path(spark, "snapshots", "customer")
    c = customer_feed(spark, sf_dir)
    commit_snapshot(c, path)
    s1 = read_snapshot(spark, path)
    commit_snapshot(update(s1, {"account_balance": 85000.0}, F.col("merchant_category") == "MACHINERY"), path)
    s2 = read_snapshot(spark, path)
    commit_snapshot(delete(s2, F.col("account_balance") < 0), path)
    return read_snapshot(spark, path)


STANDIN_TABLES = {"src_orders": "orders", "src_customer": "customer", "src_lineitem": "lineitem", "src_events": "events"}


@query
def config_mapping_parse(spark, sf_dir):
    """D2 + A8: the mapping JSON exploded to rows, joined to each raw column's
    non-null count in its source table (one aggregate per source)."""
    from sluice.config import mapping_frame

    cfg = standin_config_frame(spark)
    mapped = mapping_frame(cfg)
    counts = None
    for c in standin_configs():
        t = table(spark, sf_dir, STANDIN_TABLES[c.source_id])
        raws = [r for r, _ in c.column_mapping]
        wide = t.agg(*[F.count(F.col(r)).alias(r) for r in raws])
        long = wide.select(F.inline(F.array(*[F.struct(F.lit(r).alias("raw_column"), F.col(r).alias("non_null_rows"))
                                             for r in raws]))).withColumn("source_id", F.lit(c.source_id))
        counts = long if counts is None else counts.unionByName(long)
    return mapped.join(counts, ["source_id", "raw_column"], "left")
