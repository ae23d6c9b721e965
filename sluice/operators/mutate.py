"""Table mutation as copy-on-write snapshots.

Plain Parquet tables in Spark refuse UPDATE, DELETE and MERGE, so each
statement is a DataFrame in -> DataFrame out transformation, and a changed
table is committed as a new version directory (``v=<n>``) that readers pick
when its commit marker is present.  Of a partitioned table only the partitions
that a statement touches are rewritten (``update_partitions``,
``delete_partitions``, ``upsert_partitions``).  Single writer per table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources.files import hadoop_fs


def update_rows(df: DataFrame, assignments: dict[str, Column | object], where: Column) -> DataFrame:
    """``UPDATE t SET c = v WHERE cond`` (a NULL condition leaves the row)."""
    hit = F.coalesce(where, F.lit(False))
    cols = {c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in assignments.items()}
    # cast back to the column's type so a literal never widens the schema
    types = dict(df.dtypes)
    return df.withColumns({c: e.cast(types[c]) for c, e in cols.items()})


def delete_rows(df: DataFrame, where: Column) -> DataFrame:
    """``DELETE FROM t WHERE cond`` (a NULL condition keeps the row)."""
    return df.filter(~F.coalesce(where, F.lit(False)))


def check_unique(df: DataFrame, keys: list[str]) -> None:
    """MERGE precondition: at most one source row per key."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    if dup:
        raise ValueError(f"merge source has duplicate keys on {keys}")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """MERGE by key -- matched rows take the update's values, new keys are inserted.

    A full outer join on the keys; both sides hold each key once, so no
    group can grow beyond two rows.
    """
    if check:
        check_unique(updates, keys)
    others = [c for c in target.columns if c not in keys]
    u = updates.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in others], F.lit(True).alias("_u"))
    j = target.join(u, keys, "full_outer")
    hit = F.coalesce(F.col("_u"), F.lit(False))
    return j.select(*keys, *[F.when(hit, F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) for c in others])


# ---------------------------------------------------------------------------
# I1-I3 on partitioned tables
# ---------------------------------------------------------------------------
def _partition_key(cols: list[str]) -> Column:
    """A partition's values as one text, so that a list of partitions is one pushable filter."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in cols]))


def _keys(rows: DataFrame, cols: list[str]) -> dict[str, dict]:
    """The partitions that rows lie in (the driver gets a row per partition)."""
    found = rows.select(*cols).distinct().select(_partition_key(cols).alias("key"), *[F.col(c).cast("string").alias(c) for c in cols])
    return {r.key: {c: r[c] for c in cols} for r in found.collect()}


def rewrite_partitions(spark: SparkSession, path: str, schema, cols: list[str], touched: dict[str, dict], change) -> dict[str, dict]:
    """Replace the ``touched`` partitions by what ``change`` makes of their rows; the files of all others stay as they are.

    The filter on partitions prunes the listing, so no other file is read.
    New rows go to the work folder first: a partition is overwritten only
    with rows that are all there.  Rows that move to a partition that was not
    read pull that one in as well.  Gives the partitions that were rewritten.
    """
    from sluice.session import scratch_path
    from sluice.sinks.writers import overwrite_partitions, partition_path
    from sluice.sources.files import delete_path

    table = spark.read.schema(schema).option("basePath", path).parquet(path)
    touched = dict(touched)
    while touched:
        staging = scratch_path(spark, "rewrite")
        rows = table.filter(_partition_key(cols).isin(*touched))
        change(rows).select(*table.columns).write.parquet(staging)
        staged = spark.read.schema(table.schema).parquet(staging)
        now = _keys(staged, cols)
        beyond = {k: v for k, v in now.items() if k not in touched}
        if not beyond:
            overwrite_partitions(staged, path, cols)
            for key, spec in touched.items():
                if key not in now:
                    delete_path(spark, partition_path(path, {c: "__HIVE_DEFAULT_PARTITION__" if v is None else v for c, v in spec.items()}))
            delete_path(spark, staging)
            break
        touched |= beyond
        delete_path(spark, staging)
    return touched


def update_partitions(spark: SparkSession, path: str, schema, cols: list[str], assignments: dict, where: Column) -> dict[str, dict]:
    """I1 on a partitioned table."""
    hit = spark.read.schema(schema).option("basePath", path).parquet(path).filter(where)
    return rewrite_partitions(spark, path, schema, cols, _keys(hit, cols), lambda rows: update_rows(rows, assignments, where))


def delete_partitions(spark: SparkSession, path: str, schema, cols: list[str], where: Column) -> dict[str, dict]:
    """I2 on a partitioned table; a partition left without rows goes."""
    hit = spark.read.schema(schema).option("basePath", path).parquet(path).filter(where)
    return rewrite_partitions(spark, path, schema, cols, _keys(hit, cols), lambda rows: delete_rows(rows, where))


def upsert_partitions(spark: SparkSession, path: str, schema, cols: list[str], updates: DataFrame, keys: list[str]) -> dict[str, dict]:
    """I3 on a partitioned table: the partitions of the updates, and those in which their keys lie now."""
    check_unique(updates, keys)
    table = spark.read.schema(schema).option("basePath", path).parquet(path)
    lies = table.select(*dict.fromkeys([*keys, *cols])).join(updates.select(*keys), keys, "left_semi")
    touched = _keys(updates, cols) | _keys(lies, cols)
    return rewrite_partitions(spark, path, schema, cols, touched, lambda rows: upsert(rows, updates, keys, check=False))


# ---------------------------------------------------------------------------
# I4: versioned snapshot directories
# ---------------------------------------------------------------------------
def _versions(spark: SparkSession, path: str) -> list[tuple[int, str, bool]]:
    fs, p = hadoop_fs(spark, path)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v="):
            try:
                n = int(name[2:])
            except ValueError:
                continue
            done = fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))
            out.append((n, st.getPath().toString(), bool(done)))
    return sorted(out)


def latest_version(spark: SparkSession, path: str) -> int:
    done = [n for n, _, ok in _versions(spark, path) if ok]
    return done[-1] if done else 0


def read_snapshot(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Newest committed version of a snapshot table."""
    committed = [(n, p) for n, p, ok in _versions(spark, path) if ok]
    if not committed:
        raise FileNotFoundError(f"no committed version under {path}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(committed[-1][1])


def commit_snapshot(df: DataFrame, path: str) -> int:
    """I4: TRUNCATE + reload (or any new state) as the next version.

    The job's ``_SUCCESS`` marker is the commit point; an interrupted write
    leaves an uncommitted directory that readers ignore.
    """
    spark = df.sparkSession
    nxt = max([n for n, _, _ in _versions(spark, path)] + [0]) + 1
    df.write.mode("errorifexists").option("compression", "snappy").parquet(f"{path.rstrip('/')}/v={nxt:07d}")
    return nxt


def merge_configs(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """I3 + H7 for the config table: upsert by ``source_id``.

    ``schema_version`` goes up by one when a source's rules or mapping text
    changed (new sources start at 1); ``last_modified_at`` is stamped on rows
    with any change (switching a source off is one) and ``created_at`` is kept
    from the stored row.
    """
    from sluice.operators.registry import bump_versions

    bumped = bump_versions(stored, incoming)
    content = [c for c in incoming.columns if c not in ("source_id", "created_at", "last_modified_at")]
    prev = stored.select(
        "source_id", F.struct(*content).alias("_row0"), F.col("schema_version").alias("_v0"), F.col("created_at").alias("_c0"),
        F.col("last_modified_at").alias("_m0"))
    j = bumped.join(prev, "source_id", "left")
    changed = F.col("_v0").isNull() | ~F.struct(*content).eqNullSafe(F.col("_row0"))
    now = F.current_timestamp()
    stamped = j.withColumns({
        "created_at": F.coalesce(F.col("_c0"), F.col("created_at"), now),
        "last_modified_at": F.when(changed, now).otherwise(F.coalesce(F.col("_m0"), F.col("last_modified_at"))),
    }).select(*incoming.columns)
    return upsert(stored, stamped, ["source_id"])


def rewrite_table(spark: SparkSession, table: str, change) -> None:
    """I1-I3 on a live catalog table (a config table: a row per source).

    ``change`` maps the table's rows to its new rows.  They go to the work
    folder first, so the table is overwritten only with rows that are all
    there, and never while it is being read.
    """
    from sluice.session import scratch_path
    from sluice.sources.files import delete_path

    old = spark.table(table)
    path = scratch_path(spark, "rewrite")
    change(old).select(*old.columns).write.parquet(path)
    spark.read.schema(old.schema).parquet(path).write.insertInto(table, overwrite=True)
    delete_path(spark, path)
