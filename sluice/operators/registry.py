"""Schema registry: column profiles, snapshots and drift (H1-H7).

* ``profile`` computes type, observed nullability, null rate, min and max of
  every column in ONE aggregate (one scan, one one-row exchange) and unpivots
  the result to one row per column;
* ``sample_values`` gives up to ten values per column, most frequent first
  (ties by value), from a (column, value) count that is combined map-side;
* ``infer_types`` finds the narrowest logical type of text columns in one
  wide aggregate;
* ``profile_states`` keeps a day's profile as states that ``merge_states``
  puts together, so no older day is read again;
* ``schema_drift`` / ``value_drift`` compare two snapshots column by column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.casting import logical_type_name, mask_aggregates, mask_of, type_of_mask


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _as_text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return c.cast("string")


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """H1: ``column_name, column_type, is_nullable, null_rate, min_value, max_value``.

    min/max are computed in the column's own type, then rendered as text.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(fields):
        c = F.col(_q(f.name))
        aggs += [F.count(c).alias(f"_k{i}"), F.min(c).alias(f"_lo{i}"), F.max(c).alias(f"_hi{i}")]
    wide = df.agg(*aggs)
    n = F.col("_n")
    rows = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(logical_type_name(f.dataType)).alias("column_type"),
            (F.col(f"_k{i}") < n).alias("is_nullable"),
            F.when(n == 0, F.lit(0.0)).otherwise((n - F.col(f"_k{i}")) / n).alias("null_rate"),
            _as_text(F.col(f"_lo{i}"), f.dataType).alias("min_value"),
            _as_text(F.col(f"_hi{i}"), f.dataType).alias("max_value"),
        )
        for i, f in enumerate(fields)
    ]
    return wide.select(F.inline(F.array(*rows)))


def sample_values(df: DataFrame, columns: list[str] | None = None, k: int = 10) -> DataFrame:
    """H2: ``column_name, sample_values`` -- JSON text of up to ``k`` values.

    Values are ranked by frequency (desc) then value (asc).  The (column,
    value) counts are combined map-side, and the top-k filter becomes a
    partial per-task limit before the shuffle, so neither a hot value nor a
    wide column lands whole in one task.  Exact frequencies need one shuffle
    of each column's distinct values; runs keep sketches instead
    (``profile_states``).
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    pairs = F.array(*[F.struct(F.lit(f.name).alias("c"), _as_text(F.col(_q(f.name)), f.dataType).alias("v")) for f in fields])
    long = df.select(F.inline(pairs)).filter(F.col("v").isNotNull())
    counts = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("c").orderBy(F.col("n").desc(), F.col("v").asc())
    top = counts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return top.groupBy(F.col("c").alias("column_name")).agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"])).alias("sample_values")
    )


def infer_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """H3: narrowest logical type whose pattern every non-null value matches.

    One wide aggregate over one scan, whose row holds a mask of the types that
    all values of a column fit, then a row per column.  All-null or empty
    columns read as ``string``.
    """
    cols = [c for c in df.columns if columns is None or c in columns]
    wide = df.agg(*[a for i, c in enumerate(cols) for a in mask_aggregates(F.col(_q(c)).cast("string"), f"_m{i}")])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), type_of_mask(mask_of(f"_m{i}")).alias("column_type")) for i, c in enumerate(cols)
    ])))


#: Values that a top-k sketch tracks.  With this many or fewer distinct values counts are exact; otherwise a
#: count may be low by up to 3.5 / 2048 of the rows, and any more frequent value is sure to be found.
TRACKED = 1024
SKETCH_ERROR = 3.5 / 2048


def profile_states(df: DataFrame, columns: list[str] | None = None, raw: bool = False) -> DataFrame:
    """H1 + H2 as aggregate states that can be merged: a row per column, from one aggregate over one scan.

    ``rows``, ``nulls``, ``min_value`` and ``max_value`` (as text), ``mask``
    (for ``raw`` text columns: the types that all values fit, see ``mask_of``) and ``top``, a
    sketch of the most frequent values of bounded size.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, f in enumerate(fields):
        c = F.col(_q(f.name))
        text = _as_text(c, f.dataType)
        aggs += [F.count(c).alias(f"_k{i}"), F.min(c).alias(f"_lo{i}"), F.max(c).alias(f"_hi{i}"),
                 F.call_function("approx_top_k_accumulate", text, F.lit(TRACKED)).alias(f"_t{i}")]
        if raw:
            aggs += mask_aggregates(text, f"_m{i}")
    rows = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(None if raw else logical_type_name(f.dataType)).cast("string").alias("column_type"),
            F.col("_n").alias("rows"),
            (F.col("_n") - F.col(f"_k{i}")).alias("nulls"),
            _as_text(F.col(f"_lo{i}"), f.dataType).alias("min_value"),
            _as_text(F.col(f"_hi{i}"), f.dataType).alias("max_value"),
            (mask_of(f"_m{i}") if raw else F.lit(None).cast("int")).alias("mask"),
            F.col(f"_t{i}").alias("top"),
        )
        for i, f in enumerate(fields)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def merge_states(states: DataFrame, by: list[str] = (), k: int = 10) -> DataFrame:
    """H1 + H2 of all rows behind a table of states (days, sources), without reading those rows again.

    A profile row per group of ``by`` and column, plus ``sample_values``: the
    most frequent values by the merged sketches, then min and max if these are
    fewer than ``k``.  Days that disagree on a type make the column ``string``.
    """
    keys = [*by, "column_name"]
    kind = F.when(F.count("mask") > 0, type_of_mask(F.bit_and("mask"))).when(
        F.min("column_type") == F.max("column_type"), F.min("column_type")).otherwise(F.lit("string"))
    # Texts of numbers are compared as numbers.
    typed = states.withColumn("_as", F.coalesce("column_type", F.lit("string")))
    def least(value: str, agg):
        v = F.col(value)
        whole = F.when(F.col("_as") == "integer", v.try_cast("decimal(38,0)"))
        double = F.when(F.col("_as") == "double", v.try_cast("double"))
        return agg(F.when(v.isNotNull(), F.struct(whole.alias("a"), double.alias("b"), v.alias("v"))))["v"]

    merged = typed.groupBy(*keys).agg(
        kind.alias("column_type"), F.sum("rows").alias("_n"), F.sum("nulls").alias("_z"),
        least("min_value", F.min).alias("min_value"), least("max_value", F.max).alias("max_value"),
        F.call_function("approx_top_k_combine", F.col("top"), F.lit(TRACKED)).alias("_top"),
    )
    found = F.filter(F.transform(F.call_function("approx_top_k_estimate", F.col("_top"), F.lit(k + 1)), lambda x: x["item"]), lambda v: v.isNotNull())
    ends = F.array_compact(F.array("min_value", "max_value"))
    samples = F.slice(F.array_distinct(F.concat(F.slice(found, 1, k), ends)), 1, k)
    return merged.select(
        *keys, "column_type", (F.col("_z") > 0).alias("is_nullable"),
        F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(F.col("_z") / F.col("_n")).alias("null_rate"),
        "min_value", "max_value", F.to_json(samples).alias("sample_values"),
    )


def registry_rows(merged: DataFrame, source_id: str, schema_version: int, analysed_at: Column | None = None) -> DataFrame:
    """H4: merged profiles in the layout of the schema registry."""
    return merged.select(
        F.lit(source_id).alias("source_id"), "column_name", "column_type", "is_nullable", "sample_values",
        "null_rate", "min_value", "max_value",
        F.lit(schema_version).cast("int").alias("schema_version"),
        (analysed_at if analysed_at is not None else F.current_timestamp()).alias("analysed_at"),
        F.lit(source_id).alias("source_id_part"),
    )


def raw_drift(raw_registry: DataFrame) -> DataFrame:
    """H5 of raw feeds: each source's newest raw profile against the one before it (a row per column of either)."""
    return drift_from_registry(raw_registry.withColumn("schema_version", F.unix_micros("analysed_at")))


def snapshot(
    df: DataFrame,
    source_id: str,
    schema_version: int,
    analysed_at: Column | None = None,
    with_samples: bool = True,
) -> DataFrame:
    """H1 + H2 as registry rows (``schema_registry`` layout, H4 appends it)."""
    prof = profile(df)
    if with_samples:
        prof = prof.join(sample_values(df), "column_name", "left")
    else:
        prof = prof.withColumn("sample_values", F.lit(None).cast("string"))
    return prof.select(
        F.lit(source_id).alias("source_id"), "column_name", "column_type", "is_nullable", "sample_values",
        "null_rate", "min_value", "max_value",
        F.lit(schema_version).cast("int").alias("schema_version"),
        (analysed_at if analysed_at is not None else F.current_timestamp()).alias("analysed_at"),
        F.lit(source_id).alias("source_id_part"),
    )


def _pair(old: DataFrame, new: DataFrame) -> DataFrame:
    cols = ("column_type", "is_nullable", "null_rate", "min_value", "max_value")
    o = old.select("column_name", *[F.col(c).alias(f"old_{c}") for c in cols])
    n = new.select("column_name", *[F.col(c).alias(f"new_{c}") for c in cols])
    return o.join(n, "column_name", "full_outer")


def _changes() -> Column:
    """Names of the schema changes of a column; a retyped one may have changed its nullability as well."""
    old, new = F.col("old_column_type"), F.col("new_column_type")
    both = old.isNotNull() & new.isNotNull()
    return F.array_compact(F.array(
        F.when(old.isNull(), F.lit("added")),
        F.when(new.isNull(), F.lit("removed")),
        F.when(both & (old != new), F.lit("retyped")),
        F.when(both & (F.col("old_is_nullable") != F.col("new_is_nullable")), F.lit("nullability_changed")),
    ))


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """H5: one row per change -- added / removed / retyped / nullability_changed."""
    return _pair(old, new).select(
        "column_name", F.explode(_changes()).alias("change_type"),
        "old_column_type", "new_column_type", "old_is_nullable", "new_is_nullable",
    )


def drift_from_registry(registry: DataFrame) -> DataFrame:
    """H5 + H6 from the registry table: each source's newest snapshot against the version before it.

    Of a version with several snapshots the latest counts.  One aggregate and
    two equi-joins over the registry (a row per source, version and column).
    """
    latest = registry.groupBy("source_id", "schema_version").agg(F.max("analysed_at").alias("analysed_at"))
    two = latest.groupBy("source_id").agg(F.max_by("analysed_at", "schema_version").alias("_at"), F.max("schema_version").alias("_new"))
    before = (latest.join(two.select("source_id", "_new"), "source_id").filter(F.col("schema_version") < F.col("_new"))
              .groupBy("source_id").agg(F.max("schema_version").alias("_old"), F.max_by("analysed_at", "schema_version").alias("_old_at")))
    chosen = two.join(before, "source_id")
    cols = ("column_type", "is_nullable", "null_rate", "min_value", "max_value")

    def side(version: str, at: str, prefix: str) -> DataFrame:
        rows = registry.join(chosen.select("source_id", F.col(version).alias("schema_version"), F.col(at).alias("analysed_at")),
                             ["source_id", "schema_version", "analysed_at"])
        return rows.select("source_id", "column_name", *[F.col(c).alias(f"{prefix}_{c}") for c in cols])

    pair = side("_old", "_old_at", "old").join(side("_new", "_at", "new"), ["source_id", "column_name"], "full_outer")
    values = F.col("old_column_type").isNotNull() & F.col("new_column_type").isNotNull()
    return pair.select(
        "source_id", "column_name", F.array_join(_changes(), ",").alias("changes"),
        F.when(values, F.col("new_null_rate") - F.col("old_null_rate")).alias("null_rate_delta"),
        F.when(values, ~F.col("old_min_value").eqNullSafe(F.col("new_min_value"))).alias("min_changed"),
        F.when(values, ~F.col("old_max_value").eqNullSafe(F.col("new_max_value"))).alias("max_changed"),
    )


def value_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """H6: null-rate change and min/max changes for columns present in both."""
    p = _pair(old, new).filter(F.col("old_column_type").isNotNull() & F.col("new_column_type").isNotNull())
    return p.select(
        "column_name",
        (F.col("new_null_rate") - F.col("old_null_rate")).alias("null_rate_delta"),
        (~F.col("old_min_value").eqNullSafe(F.col("new_min_value"))).alias("min_changed"),
        (~F.col("old_max_value").eqNullSafe(F.col("new_max_value"))).alias("max_changed"),
    )


def bump_versions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """H7: incoming configs with ``schema_version`` raised when mapping or rules changed.

    New sources start at version 1; unchanged ones keep the stored version.
    """
    s = stored.select(
        "source_id",
        F.col("schema_version").alias("_v"),
        F.col("dq_rules_json").alias("_r"),
        F.col("column_mapping_json").alias("_m"),
    )
    j = incoming.drop("schema_version").join(s, "source_id", "left")
    changed = ~F.col("_r").eqNullSafe(F.col("dq_rules_json")) | ~F.col("_m").eqNullSafe(F.col("column_mapping_json"))
    version = F.when(F.col("_v").isNull(), F.lit(1)).when(changed, F.col("_v") + 1).otherwise(F.col("_v"))
    return j.withColumn("schema_version", version.cast("int")).drop("_v", "_r", "_m").select(*incoming.columns)
