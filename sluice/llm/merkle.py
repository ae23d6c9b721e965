"""Merkle dataset manifest: sibling-shift self-joins, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.shared import stored

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (lowercase hex) of a row: each field is ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    said = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)) for s in said]), 256)


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``i``, the rank (from 0) of a row within its group, and ``n``, the group's size.

    Rows are range-partitioned by group and order, and counted per group and
    partition; prefix sums over the partitions give where each begins.  A
    group with a third of all rows therefore spreads over many tasks, and so
    do equal rows, which a row number tells apart.
    """
    key = [group, *order, "row"]
    sorted_rows = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*key).sortWithinPartitions(*key)
    dealt = stored(sorted_rows.withColumn("at", F.monotonically_increasing_id()), "merkle-sorted").withColumn("part", F.shiftright("at", 33))
    runs = dealt.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("run"))
    ahead = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(group, "part", "first", F.coalesce(F.sum("run").over(ahead), F.lit(0)).alias("before"), F.sum("run").over(Window.partitionBy(group)).alias("n"))
    return dealt.join(runs, [group, "part"]).withColumn("i", F.col("before") + F.col("at") - F.col("first")).drop("row", "at", "part", "first", "before")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Add ``siblings``: the index and digest of the other nodes of each node's run, by index.

    A node asks for its siblings by their computed indices: its own XOR 1 in a
    binary tree, else its slot shifted by each offset within the run.  One
    equi-join on group and index finds them all; each key has one node and at
    most ``arity - 1`` asks.
    """
    i = F.col("i")
    if arity == 2:
        asked = F.array(i.bitwiseXOR(1))
    else:
        slot = i % arity
        asked = F.array(*[i - slot + (slot + s) % arity for s in range(1, arity)])
    asks = nodes.select("grp", "i", "n", F.explode(asked).alias("j")).where("j < n").drop("n")
    found = asks.join(nodes.select("grp", F.col("i").alias("j"), "digest"), ["grp", "j"])
    found = found.groupBy("grp", "i").agg(F.sort_array(F.collect_list(F.struct("j", "digest"))).alias("siblings"))
    none = F.array().cast("array<struct<j:bigint,digest:binary>>")
    return nodes.join(found, ["grp", "i"], "left").withColumn("siblings", F.coalesce("siblings", none))


def _side(before: bool) -> Column:
    mine = F.filter("siblings", lambda s: (s["j"] < F.col("i")) if before else (s["j"] > F.col("i")))
    return F.array_join(F.transform(mine, lambda s: _hex(s["digest"])), "")


def climb(nodes: DataFrame, arity: int) -> list[tuple[DataFrame, DataFrame]]:
    """Each level's nodes that have others in their group, with siblings, and the roots of the groups that end there.

    ``nodes`` is a stored table of ``grp, i, n, digest`` and any other columns, which stay at their level.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels = []
    while most:
        roots = nodes.where("n = 1")
        if most == 1:
            levels.append((None, roots))
            break
        level = stored(with_siblings(nodes.where("n > 1"), arity), "merkle-level")
        levels.append((level, roots))
        up = level.where(F.col("i") % arity == 0)
        digest = _digest(F.concat(_hex(F.col("digest")), _side(False)))
        nodes = stored(up.select("grp", F.expr(f"i div {arity}").alias("i"), F.ceil(F.col("n") / arity).cast("long").alias("n"), digest.alias("digest")), "merkle-parents")
        most = -(-most // arity)
    return levels


def descend(levels: list[tuple[DataFrame, DataFrame]], above: DataFrame, arity: int, keep: list[str]) -> DataFrame:
    """The proof of each node of the lowest level: what stands before and after it, from its own run up to the root.

    ``above`` has the proof of each group's root.  Proofs are handed down from
    parent to children, so a text of digests is shuffled once per run only.
    """
    paths = None
    for at in range(len(levels) - 1, -1, -1):
        level, roots = levels[at]
        kept = keep if at == 0 else []
        out = roots.join(above, "grp").select("grp", "i", F.col("digest").alias("subroot"), "path", "digest", *kept)
        if level is not None:
            parents = paths.select("grp", F.col("i").alias("run"), "subroot", F.col("path").alias("rest"))
            own = F.array(F.struct(_side(True).alias("before"), _side(False).alias("after")))
            below = level.withColumn("run", F.expr(f"i div {arity}")).join(parents, ["grp", "run"])
            out = out.unionByName(below.select("grp", "i", "subroot", F.concat(own, "rest").alias("path"), "digest", *kept))
        paths = out
    return paths


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (hex) and a proof lead to."""
    return F.aggregate(proof, leaf, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))


def proof_text(proof: Column) -> Column:
    """The siblings' digests of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), "")


def merkle_manifest(
    rows: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "lang",
    arity: int = ARITY,
    carried: Column | None = None,
) -> DataFrame:
    """A Merkle tree per group over a table's rows, one over the groups, and each row's proof.

    A row's leaf is the digest of its ``fields``.  Within a group leaves
    ascend by id; each ``arity`` consecutive nodes (the last run may have
    fewer, even one) become one, which is the digest of theirs in hex, until
    one is left, the group's subroot.  Subroots, by group, make the root in
    the same way.  Only ids, digests and ``carried`` (a small column
    computed from the row) are shuffled, never the rows.  The number of levels
    grows with the logarithm of the table; each is a stored table.

    Returns the id column, ``group``, ``leaf``, ``subroot``, ``root`` (hex),
    ``proof`` (array of ``before`` and ``after``, the digests beside the path
    from the leaf up) and ``carried``.  Cases: nulls are a value of their own
    in leaves; a null group is a group and comes first; null ids come first in
    theirs; rows with equal ids stand in the order of their leaves, so that
    the tree doesn't depend on the input's order, and equal rows are leaves
    each; a lone leaf is its group's subroot, a lone subroot the root; other
    columns are not returned, and none of their names matters; texts of any
    length are hashed where they are read; no rows give no rows.
    """
    if arity < 2:
        raise ValueError("a tree needs an arity of 2 or more")
    named = lambda c: F.col(f"`{c}`")
    carried = F.lit(None).cast("string") if carried is None else carried
    leaves = rows.select(
        named(id_col).alias("id"), F.struct(named(group_col).alias("name")).alias("g"), F.unhex(leaf_digest([named(f) for f in fields])).alias("digest"), carried.alias("carried")
    )
    ranked = numbered(stored(leaves, "merkle-leaves"), "g", ["id", "digest"])
    groups = numbered(ranked.select("g").distinct().withColumn("every", F.lit(0)), "every", ["g"])
    groups = stored(groups.select("g", F.col("i").alias("grp"), F.col("n").alias("groups")), "merkle-groups")
    keep = ["id", "g", "carried"]
    levels = climb(stored(ranked.join(groups.select("g", "grp"), "g"), "merkle-nodes"), arity)
    subroots = None
    for _, roots in levels:
        found = roots.select("grp", "digest")
        subroots = found if subroots is None else subroots.unionByName(found)
    empty = F.array().cast("array<struct<before:string,after:string>>")
    if subroots is None:
        return rows.where("false").select(
            named(id_col).alias(id_col), named(group_col).alias("group"), *[F.lit("").alias(c) for c in ("leaf", "subroot", "root")], empty.alias("proof"), carried.alias("carried")
        )
    tops = groups.join(subroots, "grp").select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("i"), F.col("groups").alias("n"), "digest")
    upper = climb(stored(tops, "merkle-subroots"), arity)
    root = upper[-1][1].select(_hex(F.col("digest"))).first()[0]
    start = tops.sparkSession.range(1).select(F.lit(0).cast("long").alias("grp"), empty.alias("path"))
    above = stored(descend(upper, start, arity, []).select(F.col("i").alias("grp"), "path"), "merkle-above")
    proofs = descend(levels, above, arity, keep)
    return proofs.select(
        F.col("id").alias(id_col), F.col("g.name").alias("group"), _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), F.lit(root).alias("root"),
        F.col("path").alias("proof"), "carried",
    )
