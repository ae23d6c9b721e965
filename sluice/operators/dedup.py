"""Primary-key dedup (F1) and key-uniqueness report (F2).

F1 keeps, per key, the row that is greatest by the given order (newest event
time first, then the remaining columns, then a row id).  There is one plan
for every input size, and it needs no knowledge of hot keys:

1. keys alone are counted, by a 64-bit hash, combined map-side; the hashes
   that occur more than once are stored.  Of a unique key nothing but its hash
   is ever shuffled (two keys that share a hash are merely looked at again);
2. rows reach the next step through a semi-join with those hashes, whose
   stored size tells the planner whether to broadcast them (or, between large
   sides, to build a runtime Bloom filter).  Of each key that really repeats
   the winner's row id is found by one aggregate, combined map-side, so a
   key with a third of all rows shrinks to one row per task, and stored;
3. the winners are joined back to the rows.

Both joins match on a part number too: the rows of a hash that more than
``PART_ROWS`` rows have are dealt over parts of about that size, and the other
side has a row per part, so that no task gets a hot key whole.  Only such
hashes, at most one per ``PART_ROWS`` rows, are broadcast to number the rows.

Rows with a NULL key are never duplicates (a NULL key is a ``not_null`` rule
matter).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.session import scratch_path

DUP_FLAG = "_is_dup"
ROW_ID = "_rid"
#: Rows of one key that may meet in one task of a join.
PART_ROWS = 1 << 16
_PART, _PARTS = "_dup_part", "_dup_parts"


def with_row_id(df: DataFrame) -> DataFrame:
    """A per-row tiebreak, assigned right after the scan (before any shuffle)."""
    return df.withColumn(ROW_ID, F.monotonically_increasing_id())


def _order_struct(order: list[Column | str]) -> Column:
    fields = [(F.col(c) if isinstance(c, str) else c).alias(f"_o{i}") for i, c in enumerate(order)]
    return F.struct(*fields, F.col(ROW_ID).alias("_oid"))


def _has_keys(keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def repeated_hashes(df: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Hashes of the keys that occur more than once (``_h``) and the parts their rows are dealt to, as a stored table."""
    counts = df.filter(_has_keys(keys)).groupBy(_hash(keys).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / PART_ROWS).alias(_PARTS)
    counts.filter(F.col("_n") > 1).select("_h", parts).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(f"_h bigint, {_PARTS} bigint").parquet(path)


def _dealt(df: DataFrame, keys: list[str], repeated: DataFrame) -> DataFrame:
    """Add each row's part and the parts of its hash; rows with a NULL key, which match nothing, are dealt freely."""
    hot = repeated.filter(F.col(_PARTS) > 1)
    nth = F.xxhash64(ROW_ID)
    return df.join(F.broadcast(hot), _hash(keys) == F.col("_h"), "left").select(
        *df.columns,
        F.coalesce(_PARTS, F.lit(1)).alias(_PARTS),
        F.when(_has_keys(keys), F.coalesce(F.pmod(nth, _PARTS), F.lit(0))).otherwise(nth).alias(_PART),
    )


def _per_part(stored: DataFrame) -> DataFrame:
    return stored.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.col(_PARTS) - 1))).drop(_PARTS)


def _hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def flag_duplicates(df: DataFrame, keys: list[str], order: list[Column | str], scratch: str | None = None) -> DataFrame:
    """Add ``_is_dup``: True for every row that is not its key's winner.

    The winner is the row with the greatest ``order`` values (compared left
    to right, NULL lowest), then the greatest row id.  ``df`` must carry
    ``_rid`` (see ``with_row_id``) and is evaluated three times, so it must be
    a file scan or a stored table, whose row ids stay the same.  ``scratch``:
    where the winners go (a fresh folder under the work root by default).
    """
    path = scratch or scratch_path(df.sparkSession, "dedup")
    repeated = repeated_hashes(df, keys, f"{path}/hashes")
    rows = _dealt(df, keys, repeated)
    some = _per_part(repeated)
    winners = (
        rows.filter(_has_keys(keys))
        .join(some, (_hash(keys) == F.col("_h")) & (F.col(_PART) == F.col("_p")), "left_semi")
        .groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
        .agg(F.count(F.lit(1)).alias("_n"), F.max(_order_struct(order))["_oid"].alias("_win"), F.max(_PARTS).alias(_PARTS))
        .filter(F.col("_n") > 1)
        .drop("_n")
    )
    winners.write.mode("overwrite").parquet(f"{path}/winners")
    stored = _per_part(df.sparkSession.read.schema(winners.schema).parquet(f"{path}/winners"))
    same = F.col(_PART) == F.col("_p")
    for i, k in enumerate(keys):
        same = same & (rows[k] == stored[f"_k{i}"])
    is_dup = F.coalesce(F.col("_win") != F.col(ROW_ID), F.lit(False))
    return rows.join(stored, same, "left").withColumn(DUP_FLAG, is_dup).select(*df.columns, DUP_FLAG)


def dedup_latest(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Keep one row per key (the winner); rows with a NULL key are kept.

    ``df`` is a file scan or a stored table, as for ``flag_duplicates``.
    """
    src = df if ROW_ID in df.columns else with_row_id(df)
    return flag_duplicates(src, keys, order).filter(~F.col(DUP_FLAG)).select(*df.columns)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys that occur more than once, with their copy count (map-side combined)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def uniqueness_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """one row -- rows, distinct keys, duplicate keys, extra copies."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").cast("bigint").alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        F.sum(F.col("n") - 1).cast("bigint").alias("extra_copies"),
    )
