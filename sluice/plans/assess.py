"""The verdict of an ingestion run: casts, rules and dedup in one plan.

``assess`` turns conformed rows (typed silver columns plus
``_cast_failures``) into rows with ``failed_rules``:

1. cast failures (``cast:<column>``) and failed rule ids, one projection;
2. among rows that passed everything, extra copies of a primary key get
   ``dup:<key>`` (dedup runs after the rules, so a bad newer copy never
   evicts a good one).

Every input row comes out exactly once, so ``rows read = rows passed +
rows rejected`` holds by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.rules import CompiledRule
from sluice.operators.dedup import DUP_FLAG, ROW_ID, flag_duplicates, with_row_id
from sluice.operators.mapping import CAST_FAILURES
from sluice.operators.quality import DUP_PREFIX, FAILED, verdict_array


def rule_verdict(df: DataFrame, compiled: list[CompiledRule]) -> DataFrame:
    """Cast failures first, then failed rule ids."""
    rules = verdict_array(compiled)
    if CAST_FAILURES in df.columns:
        arr = F.concat(F.col(CAST_FAILURES), rules)
        return df.withColumn(FAILED, arr).drop(CAST_FAILURES)
    return df.withColumn(FAILED, rules)


def dedup_verdict(
    v: DataFrame,
    keys: list[str],
    order: list[Column | str] | None = None,
    scratch: str | None = None,
) -> DataFrame:
    """Step 2 on a rule verdict: extra copies of a key among passing rows get ``dup:<key>``."""
    had_id = ROW_ID in v.columns
    if not had_id:
        v = with_row_id(v)
    # A row that failed takes no part: its key counts as NULL for the dedup.
    ok = F.size(F.col(FAILED)) == 0
    marked = v.withColumns({f"_pk{i}": F.when(ok, F.col(k)) for i, k in enumerate(keys)})
    flagged = flag_duplicates(marked, [f"_pk{i}" for i in range(len(keys))], order or [], scratch)
    dup_reason = F.array(F.lit(DUP_PREFIX + ",".join(keys)))
    out = flagged.withColumn(FAILED, F.when(F.col(DUP_FLAG), dup_reason).otherwise(F.col(FAILED))).select(*v.columns)
    return out if had_id else out.drop(ROW_ID)


def assess(
    df: DataFrame,
    compiled: list[CompiledRule],
    keys: list[str] | None = None,
    order: list[Column | str] | None = None,
) -> DataFrame:
    """Full verdict: ``failed_rules`` from casts, rules and dedup.

    ``keys``: primary key (silver names); ``order``: winner order for copies,
    greatest first.  Without keys no dedup is done.
    """
    v = rule_verdict(df, compiled)
    if not keys:
        return v
    return dedup_verdict(v, keys, order)
