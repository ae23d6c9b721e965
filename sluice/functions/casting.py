"""Safe casting of raw text to target types, with failure accounting.

Spark 4 runs in ANSI mode, where ``cast('abc' as double)`` raises, and
``try_cast`` alone is too lenient (it takes ``NaN`` and ``5d`` as doubles,
``1``/``Y`` as booleans).  Every numeric cast is therefore guarded by an
anchored pattern; values that do not match become NULL and are counted as
cast failures.  The same patterns are valid in Java and RE2, so SQL oracles
can reuse them verbatim.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.timefmt import parse_date, parse_timestamp

INTEGER_PATTERN = r"^[+-]?[0-9]+$"
DECIMAL_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
BOOLEAN_WORDS = ("true", "false")
ISO_TIMESTAMP_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,9})?)?)?$"



def _text(raw: Column) -> Column:
    return F.trim(raw.cast("string"))


def safe_cast(raw: Column, dtype: T.DataType, fmt: str | None = None) -> Column:
    """Cast raw text to ``dtype``; anything that does not parse is NULL."""
    txt = _text(raw)
    if isinstance(dtype, T.StringType):
        return raw.cast("string")
    if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return F.when(txt.rlike(INTEGER_PATTERN), txt.try_cast(dtype))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(txt.rlike(DECIMAL_PATTERN), txt.try_cast(dtype))
    if isinstance(dtype, T.DecimalType):
        return F.when(txt.rlike(DECIMAL_PATTERN), txt.try_cast(dtype))
    if isinstance(dtype, T.BooleanType):
        return F.when(F.lower(txt).isin(*BOOLEAN_WORDS), F.lower(txt) == F.lit("true"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        if fmt:
            return parse_timestamp(txt, fmt)
        return F.when(txt.rlike(ISO_TIMESTAMP_PATTERN), txt.try_cast(dtype))
    if isinstance(dtype, T.DateType):
        if fmt:
            return parse_date(txt, fmt)
        return F.when(txt.rlike(ISO_TIMESTAMP_PATTERN), F.to_date(txt.try_cast("timestamp")))
    return raw.try_cast(dtype)


def cast_failed(raw: Column, typed: Column) -> Column:
    """True when a non-blank raw value did not survive the cast."""
    return raw.isNotNull() & (F.trim(raw.cast("string")) != F.lit("")) & typed.isNull()


#: Bit of each logical type in a type mask, in the order in which a type is chosen.
TYPE_BITS = {"integer": 1, "double": 2, "boolean": 4, "timestamp": 8}


def type_tests(raw: Column) -> dict[str, Column]:
    """H3: does a value read as each logical type?  (NULL stays NULL.)

    Each test begins with the trimmed text, unconditionally, so that Spark
    computes it once for all of them.
    """
    txt = _text(raw)
    fits = lambda kind: txt.isNull() | txt.try_cast(kind).isNotNull()
    return {
        "integer": txt.rlike(INTEGER_PATTERN) & fits("bigint"),
        "double": txt.rlike(DECIMAL_PATTERN),
        "boolean": F.lower(txt).isin(*BOOLEAN_WORDS),
        "timestamp": txt.rlike(ISO_TIMESTAMP_PATTERN) & fits("timestamp"),
    }


def mask_aggregates(raw: Column, name: str) -> list[Column]:
    """A column's type mask as aggregates: one small one per type, which compiles well; ``mask_of`` puts them together."""
    return [F.bool_and(test).alias(f"{name}_{t}") for t, test in type_tests(raw).items()]


def mask_of(name: str) -> Column:
    """The types that all values read as, a bit each; NULL if there were no values."""
    bits = [F.when(F.col(f"{name}_{t}"), F.lit(bit)).otherwise(F.lit(0)) for t, bit in TYPE_BITS.items()]
    return F.when(F.col(f"{name}_integer").isNotNull(), sum(bits[1:], bits[0]))


def type_of_mask(mask: Column) -> Column:
    """The narrowest logical type of a column whose values' masks were combined; ``string`` if there were none."""
    pick = F.when(mask.isNull(), F.lit("string"))
    for name, bit in TYPE_BITS.items():
        pick = pick.when(mask.bitwiseAND(F.lit(bit)) > 0, F.lit(name))
    return pick.otherwise(F.lit("string"))


def logical_type_name(dtype: T.DataType) -> str:
    """Registry type name of a Spark type (``string, integer, double, timestamp, boolean``)."""
    if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return "integer"
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "double"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "string"
