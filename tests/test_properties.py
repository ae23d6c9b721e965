"""Property tests: guarded casts agree with a plain-Python reading of the same text."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.casting import DECIMAL_PATTERN, INTEGER_PATTERN, safe_cast

TEXT = st.one_of(
    st.from_regex(r"\A[ ]?[+-]?[0-9]{1,12}([.][0-9]{0,6})?([eE][+-]?[0-9]{1,2})?[ ]?\Z"),
    st.text(alphabet="0123456789.+-eEabcNnIif ", max_size=12),
    st.none(),
)


def _py_double(s):
    if s is None:
        return None
    t = s.strip()
    return float(t) if re.fullmatch(DECIMAL_PATTERN[1:-1], t) else None


def _py_int(s):
    if s is None:
        return None
    t = s.strip()
    if not re.fullmatch(INTEGER_PATTERN[1:-1], t):
        return None
    v = int(t)
    return v if -(2**31) <= v < 2**31 else None


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TEXT, min_size=200, max_size=400))
def test_safe_cast_matches_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = df.select(
        "x",
        safe_cast(F.col("x"), T.DoubleType()).alias("d"),
        safe_cast(F.col("x"), T.IntegerType()).alias("i"),
    ).collect()
    for r in got:
        assert r.d == _py_double(r.x), r.x
        assert r.i == _py_int(r.x), r.x
