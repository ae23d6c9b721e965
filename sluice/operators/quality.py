"""Data-quality verdicts and metrics.

Plan shape: every rule of a source is evaluated in one projection (the row
verdict, a narrow stage), and all rule metrics come from ONE aggregate over
that verdict -- a single scan and a single one-row exchange, never a job per
rule.  Samples explode only failing rows and use a row-number-limited window,
which Spark splits into a map-side partial limit before the shuffle, so a rule
failed by a third of all rows still sends at most three rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.rules import ERROR_PREFIX, CompiledRule
from sluice.session import local_frame

FAILED = "failed_rules"
CAST_PREFIX = "cast:"
DUP_PREFIX = "dup:"


# ---------------------------------------------------------------------------
# Row verdict and split
# ---------------------------------------------------------------------------
def verdict_array(compiled: list[CompiledRule], extra: list[Column] = ()) -> Column:
    """Array of failed reasons of a row: cast failures first, then rule ids."""
    parts = list(extra) + [c.reason for c in compiled if c.error is None]
    if not parts:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*parts))


def with_verdict(df: DataFrame, compiled: list[CompiledRule], extra: list[Column] = ()) -> DataFrame:
    return df.withColumn(FAILED, verdict_array(compiled, extra))


def passed(df: DataFrame) -> Column:
    return F.size(F.col(FAILED)) == 0


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows passing every check, rows failing at least one)."""
    ok = passed(df)
    return df.filter(ok), df.filter(~ok)


# ---------------------------------------------------------------------------
# Metrics from one aggregate
# ---------------------------------------------------------------------------
def quality_counts(verdict: DataFrame, compiled: list[CompiledRule], by: list[str] = ()) -> DataFrame:
    """One-row aggregate over a verdict: row totals and failures per rule; a row per group with ``by``.

    Reads only the ``failed_rules`` column (and those of ``by``).
    """
    fr = F.col(FAILED)
    aggs = [
        F.count(F.lit(1)).alias("_total"),
        F.count_if(F.size(fr) == 0).alias("_passed"),
    ]
    for i, c in enumerate(compiled):
        reasons = [c.rule.rule_id, ERROR_PREFIX + c.rule.rule_id]
        aggs.append(F.count_if(F.arrays_overlap(fr, F.array(*map(F.lit, reasons)))).alias(f"_f{i}"))
    return verdict.groupBy(*by).agg(*aggs)


def total_counts(parts: DataFrame, compiled: list[CompiledRule]) -> DataFrame:
    """The one-row counts of groups that ``quality_counts`` counted apart."""
    names = ["_total", "_passed", *[f"_f{i}" for i in range(len(compiled))]]
    return parts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def _pass_rate(passed_rows: Column, total: Column) -> Column:
    # Empty input: nothing violates the rule.
    return F.when(total == 0, F.lit(1.0)).otherwise(passed_rows.cast("double") / total.cast("double"))


RULE_INFO = (
    "_i int, rule_id string, rule_name string, rule_type string, rule_expression string, "
    "column_name string, threshold double, setup_error string"
)


def rule_metrics(counts: DataFrame, compiled: list[CompiledRule]) -> DataFrame:
    """E7 + E8 + E10: one row per rule from the one-row ``quality_counts``.

    The failure counts are exploded from the one-row aggregate and joined
    (broadcast, one row per rule) to the rules' static description.
    """
    spark = counts.sparkSession
    info = local_frame(
        spark,
        [(i, c.rule.rule_id, c.rule.rule_name, c.rule.type, c.text, c.rule.column, float(c.rule.threshold), c.error)
         for i, c in enumerate(compiled)],
        RULE_INFO,
    )
    fails = [F.col(f"_f{i}") if c.error is None else F.lit(None).cast("bigint") for i, c in enumerate(compiled)]
    if not fails:
        fails = [F.lit(None).cast("bigint")]
    per_rule = counts.select(F.col("_total").alias("total_rows"), F.posexplode(F.array(*fails)).alias("_i", "failed_rows"))
    total, failed = F.col("total_rows"), F.col("failed_rows")
    ok_rows = total - failed
    rate = _pass_rate(ok_rows, total)
    return per_rule.join(F.broadcast(info), "_i").select(
        "rule_id", "rule_name", "rule_type", "rule_expression", "column_name", "total_rows",
        ok_rows.alias("passed_rows"), "failed_rows", F.when(failed.isNotNull(), rate).alias("pass_rate"), "threshold",
        F.coalesce(F.when(failed.isNotNull(), rate) >= F.col("threshold"), F.lit(False)).alias("rule_passed"),
        "setup_error",
    )


def rule_metrics_direct(df: DataFrame, compiled: list[CompiledRule]) -> DataFrame:
    """E7 on un-verdicted rows: the predicates go straight into the aggregate."""
    aggs = [F.count(F.lit(1)).alias("_total")]
    for i, c in enumerate(compiled):
        aggs.append(F.count_if(~c.ok).alias(f"_f{i}"))
    return rule_metrics(df.agg(*aggs), compiled)


def ingestion_status(rows_written: Column, rules_failed: Column) -> Column:
    """FAILED if nothing was written, PARTIAL if a gate failed, else SUCCESS."""
    return (
        F.when(rows_written == 0, F.lit("FAILED"))
        .when(rules_failed > 0, F.lit("PARTIAL"))
        .otherwise(F.lit("SUCCESS"))
    )


def summary(counts: DataFrame, compiled: list[CompiledRule]) -> DataFrame:
    """E11 + E12 from the one-row ``quality_counts`` (no rule-failure sums).

    ``total_rows_rejected`` is a row-level count: a row failing several
    rules is rejected once, and duplicates count although no rule failed.
    """
    total, ok = F.col("_total"), F.col("_passed")
    gate_flags = []
    for i, c in enumerate(compiled):
        if c.error is None:
            rate = _pass_rate(total - F.col(f"_f{i}"), total)
            gate_flags.append((rate >= F.lit(float(c.rule.threshold))).cast("int"))
        else:
            gate_flags.append(F.lit(0))
    rules_passed = sum(gate_flags[1:], gate_flags[0]) if gate_flags else F.lit(0)
    checked = F.lit(len(compiled))
    return counts.select(
        total.alias("total_rows_ingested"),
        ok.alias("total_rows_passed"),
        (total - ok).alias("total_rows_rejected"),
        _pass_rate(ok, total).alias("overall_pass_rate"),
        checked.cast("int").alias("rules_checked"),
        rules_passed.cast("int").alias("rules_passed"),
        (checked - rules_passed).cast("int").alias("rules_failed"),
    ).withColumn("ingestion_status", ingestion_status(F.col("total_rows_passed"), F.col("rules_failed")))


# ---------------------------------------------------------------------------
# Sample failures
# ---------------------------------------------------------------------------
def sample_failures(
    verdict: DataFrame,
    compiled: list[CompiledRule],
    order_key: str,
    sample_columns: list[str] | None = None,
    per_rule: int = 3,
) -> DataFrame:
    """Up to ``per_rule`` failing rows per rule as a JSON array (by ``order_key``).

    Returns ``(rule_id, sample_failures)`` for rules with at least one failure.
    """
    ids = [c.rule.rule_id for c in compiled if c.error is None]
    cols = sample_columns or [c for c in verdict.columns if c != FAILED]
    row = F.struct(*[F.col(c) for c in cols])
    failing = verdict.filter(F.size(F.col(FAILED)) > 0).select(
        F.explode(F.transform(FAILED, lambda r: F.regexp_replace(r, f"^{ERROR_PREFIX}", ""))).alias("rule_id"),
        F.col(order_key).alias("_k"),
        row.alias("_row"),
    ).filter(F.col("rule_id").isin(*ids))
    w = Window.partitionBy("rule_id").orderBy(F.col("_k").asc_nulls_last(), F.col("_row"))
    # JSON is rendered only for the rows that survive the limit.
    top = (failing.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per_rule)
           .withColumn("_row", F.to_json("_row")))
    return top.groupBy("rule_id").agg(
        F.concat(
            F.lit("["),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_row"))), lambda x: x["_row"]),
                ",",
            ),
            F.lit("]"),
        ).alias("sample_failures")
    )
