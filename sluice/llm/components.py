"""Connected components over a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import cut


def _signature(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label each node of an undirected edge list with the smallest node it reaches.

    Alternating large-star and small-star rounds: a large-star hangs each
    larger neighbour of a node on the node's smallest neighbour, a small-star
    does so with the smaller ones.  Each round is a minimum per node (combined
    before the shuffle) and an equi-join, which adaptive execution splits for
    a node with very many neighbours; nothing is gathered per node or on the
    driver.  Rounds end when the edges no longer change.

    Returns ``node, component`` for every node but the components' smallest
    ones.  Edges with a null end and loops count for nothing; no edges give
    no rows.
    """
    current = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    before = _signature(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _signature(current)
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
