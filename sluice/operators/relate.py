"""Union, foreign-key joins, grouped counts and sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_sources(frames: dict[str, DataFrame], source_col: str = "source_id") -> DataFrame:
    """one table from several feeds; missing columns become NULL."""
    out = None
    for source_id, df in frames.items():
        tagged = df.withColumn(source_col, F.lit(source_id))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def fk_join(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, how: str = "inner") -> DataFrame:
    """child rows with their parent (1:N: a parent may have many children).

    A plain equi-join at every size and for every join type: Catalyst
    broadcasts the smaller side only if its size is known to be small, and
    adaptive execution splits the partition of a key with very many rows.
    """
    return child.join(parent, child[child_key] == parent[parent_key], how)


def fk_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """child rows whose parent key does not exist (NULL keys are orphans)."""
    return child.join(parent, child[child_key] == parent[parent_key], "left_anti")


def silver_flags_with_transactions(flags: DataFrame, transactions: DataFrame, processing_date: str | None = None,
                                   transaction_source: str | None = None, how: str = "inner") -> DataFrame:
    """F4 on the silver tables: each flag with its transaction of the same processing date.

    Feeds deliver the same ids on different days, so the date is part of the
    key; ``processing_date`` and ``transaction_source`` prune partitions.
    """
    t = transactions
    if processing_date is not None:
        flags, t = flags.filter(F.col("processing_date") == processing_date), t.filter(F.col("processing_date") == processing_date)
    if transaction_source is not None:
        t = t.filter(F.col("source_id") == transaction_source)
    t = t.select(F.col("transaction_id"), F.col("processing_date").alias("_day"), *[c for c in t.columns if c not in ("transaction_id", "processing_date", "source_id", *flags.columns)])
    return flags.join(t, (flags["transaction_ref"] == t["transaction_id"]) & (flags["processing_date"] == t["_day"]), how).drop("_day")


def flagged_only(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """parent rows with at least one child (each parent once).

    Child keys are made distinct first -- combined map-side, so a key with a
    third of all child rows collapses to one row per task before any shuffle.
    """
    keys = child.select(F.col(child_key).alias("_ck")).distinct()
    return parent.join(keys, parent[parent_key] == F.col("_ck"), "left_semi")


def version_match(registry: DataFrame, config: DataFrame, keys=("source_id", "schema_version")) -> DataFrame:
    """registry rows whose ``(source_id, schema_version)`` matches the config."""
    return registry.join(config.select(*keys).distinct(), list(keys), "left_semi")


def count_where(df: DataFrame, predicate: Column, name: str = "n") -> DataFrame:
    """F8: ``SELECT count(*) ... WHERE predicate``."""
    return df.agg(F.count_if(predicate).alias(name))


def group_counts(df: DataFrame, by: list[str], predicates: dict[str, Column] | None = None, sort: bool = True) -> DataFrame:
    """F9 + F10: rows per group, optional counts with predicates, sorted by the keys."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for name, pred in (predicates or {}).items():
        aggs.append(F.count_if(pred).alias(name))
    out = df.groupBy(*by).agg(*aggs)
    return out.orderBy(*by) if sort else out
