"""Column mapping, padding, safe casting and audit columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.casting import cast_failed, safe_cast
from sluice.operators.quality import CAST_PREFIX

CAST_FAILURES = "_cast_failures"


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def map_columns(df: DataFrame, mapping: dict[str, str] | list[tuple[str, str]]) -> DataFrame:
    """Rename raw columns to silver names; unmapped raw columns are dropped.

    Mapped raw columns missing from ``df`` are skipped here (see ``pad_columns``).
    """
    pairs = mapping.items() if isinstance(mapping, dict) else mapping
    present = set(df.columns)
    return df.select(*[F.col(_q(raw)).alias(silver) for raw, silver in pairs if raw in present])


def pad_columns(df: DataFrame, target: T.StructType | list[T.StructField], keep: list[str] = ()) -> DataFrame:
    """Order columns as the target; absent targets become typed NULLs."""
    fields = target.fields if isinstance(target, T.StructType) else target
    present = set(df.columns)
    cols = [F.col(_q(f.name)) if f.name in present else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    return df.select(*cols, *[F.col(_q(k)) for k in keep if k in present])


def conform(
    df: DataFrame,
    mapping: dict[str, str] | list[tuple[str, str]],
    target: T.StructType | list[T.StructField],
    formats: dict[str, str] | None = None,
    keep: list[str] = (),
) -> DataFrame:
    """C1 + C2 + C3 in one projection.

    Raw text columns are renamed, cast to the target types (``formats`` gives
    a datetime pattern per silver column), and padded; ``_cast_failures``
    lists ``cast:<column>`` for every non-blank value that did not cast.
    ``keep`` columns pass through unchanged.
    """
    fields = target.fields if isinstance(target, T.StructType) else target
    formats = formats or {}
    pairs = list(mapping.items() if isinstance(mapping, dict) else mapping)
    present = set(df.columns)
    raw_of = {silver: raw for raw, silver in pairs if raw in present}
    out, reasons = [], []
    for f in fields:
        if f.name in raw_of:
            raw = F.col(_q(raw_of[f.name]))
            typed = safe_cast(raw, f.dataType, formats.get(f.name))
            if not isinstance(f.dataType, T.StringType):
                reasons.append(F.when(cast_failed(raw, typed), F.lit(CAST_PREFIX + f.name)))
        else:
            typed = F.lit(None).cast(f.dataType)
        out.append(typed.alias(f.name))
    failures = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
    return df.select(*out, failures.alias(CAST_FAILURES), *[F.col(_q(k)) for k in keep if k in present])


def with_audit_columns(
    df: DataFrame,
    run_id: str,
    processing_date: str,
    source_id: str,
    ingested_at: Column | None = None,
    passed: Column | None = None,
) -> DataFrame:
    """``dq_passed, run_id, ingested_at`` plus the partition columns."""
    return df.withColumns(
        {
            "dq_passed": passed if passed is not None else F.lit(True),
            "run_id": F.lit(run_id),
            "ingested_at": ingested_at if ingested_at is not None else F.current_timestamp(),
            "processing_date": F.lit(processing_date),
            "source_id": F.lit(source_id),
        }
    )


def equality_filter(df: DataFrame, column: str, value) -> DataFrame:
    """C11: ``WHERE column = value``."""
    return df.filter(F.col(_q(column)) == F.lit(value))


def with_literals(df: DataFrame, literals: dict[str, object]) -> DataFrame:
    """Aliased literal projection."""
    return df.withColumns({name: F.lit(v) for name, v in literals.items()})


def with_current_timestamp(df: DataFrame, name: str = "stamped_at") -> DataFrame:
    """The query's current timestamp (one value for the whole query)."""
    return df.withColumn(name, F.current_timestamp())
