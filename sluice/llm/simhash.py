"""SimHash near-deduplication with BK-trees."""

from __future__ import annotations

from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.components import connected_components
from sluice.llm.shared import aside, cut, restored, ship, stored

BITS = 64
SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Fingerprints that a work unit holds on average, and a tree at most on average.
TREE_SIZE = 1 << 14
#: Pairs of query and tree node that are looked at together.
FRONTIER = 1 << 20
#: Shingles hashed together, so that a very long text needs no more memory than this many.
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, words_in_shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a whole text; 0 if it has no words."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - words_in_shingle + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[:n], ends[-n:]
    votes = np.zeros(BITS, np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, SHINGLES_AT_ONCE):
        part = slice(at, at + SHINGLES_AT_ONCE)
        h = np.array([hashed(joined[s:e], SEED) for s, e in zip(starts[part].tolist(), ends[part].tolist(), strict=True)], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, words_in_shingle: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a long (the same 64 bits, signed)."""

    def run(texts: pa.Array) -> pa.Array:
        prints = [fingerprint(t, words_in_shingle) for t in texts.to_pylist()]
        return pa.array(np.array(prints, np.uint64).view(np.int64))

    return F.arrow_udf(run, "long")(text)


class BKForest:
    """BK-trees over the fingerprints of several buckets, one tree for each.

    A node's children are keyed by their Hamming distance to it.  Trees are
    built and searched level by level over all items at once.
    """

    def __init__(self, prints: np.ndarray, buckets: np.ndarray) -> None:
        self.prints = prints
        self.root_of, first = np.unique(buckets, return_index=True)
        self.roots = first
        here = first[np.searchsorted(self.root_of, buckets)]
        pending = np.setdiff1d(np.arange(len(prints)), first)
        here = here[pending]
        keys, children = [], []
        while len(pending):
            key = here * (BITS + 1) + np.bitwise_count(prints[pending] ^ prints[here]).astype(np.int64)
            slots, new, slot = np.unique(key, return_index=True, return_inverse=True)
            keys.append(slots)
            children.append(pending[new])
            rest = np.ones(len(pending), bool)
            rest[new] = False
            here, pending = pending[new][slot][rest], pending[rest]
        keys = np.concatenate([*keys, np.empty(0, np.int64)])
        order = np.argsort(keys)
        self.keys, self.children = keys[order], np.concatenate([*children, np.empty(0, np.int64)])[order]

    def search(self, prints: np.ndarray, buckets: np.ndarray, radius: int):
        """Yield arrays (query, node) of all pairs within ``radius``, a bounded number at a time.

        Only edges whose key differs from the distance at hand by at most the
        radius are followed: beyond them the triangle inequality rules out any hit.
        """
        at = np.searchsorted(self.root_of, buckets).clip(max=max(0, len(self.root_of) - 1))
        known = np.flatnonzero(self.root_of[at] == buckets) if len(self.root_of) else np.empty(0, np.int64)
        stack = [(known, self.roots[at[known]])] if len(known) else []
        while stack:
            query, node = stack.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            far = np.bitwise_count(prints[query] ^ self.prints[node]).astype(np.int64)
            if (hit := far <= radius).any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.keys, node * (BITS + 1) + np.maximum(far - radius, 0))
            high = np.searchsorted(self.keys, node * (BITS + 1) + np.minimum(far + radius, BITS), "right")
            ends, sizes = np.cumsum(high - low), high - low
            for part in _parts(ends, FRONTIER):
                if total := int(sizes[part].sum()):
                    offset = np.arange(total) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part])
                    stack.append((np.repeat(query[part], sizes[part]), self.children[np.repeat(low[part], sizes[part]) + offset]))


def _parts(ends: np.ndarray, most: int) -> list[slice]:
    """Slices whose totals are about ``most`` at the most, given running totals."""
    cuts = np.searchsorted(ends, np.arange(most, ends[-1] + most, most), "right") if len(ends) else []
    edges = sorted({0, *map(int, cuts), len(ends)})
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


class Union:
    """Vectorised union-find; a set's label is its smallest member."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = x
        while not np.array_equal(up := self.parent[root], root):
            root = up
        self.parent[x] = root  # so that later walks are short
        return root

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low != high
            a, b = low[apart], high[apart]
            np.minimum.at(self.parent, b, a)

    def labels(self) -> np.ndarray:
        return self.find(np.arange(len(self.parent)))


def _link(radius: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", kind="stable", ignore_index=True)
        prints, tree, asks = rows["fp"].to_numpy().view(np.uint64), rows["tree"].to_numpy(), rows["asks"].to_numpy()
        bucket = rows.groupby(["tab", "val"], sort=False).ngroup().to_numpy()
        nodes, queries = np.flatnonzero(tree), np.flatnonzero(asks)
        forest, sets = BKForest(prints[nodes], bucket[nodes]), Union(len(rows))
        for query, node in forest.search(prints[queries], bucket[queries], radius):
            sets.unite(queries[query], nodes[node])
        label = sets.labels()
        linked = label != np.arange(len(rows))
        reps = rows["rep"]
        return pd.DataFrame({"a": reps[linked].to_numpy(), "b": reps.to_numpy()[label[linked]]})

    return run


def _tables(n: int, radius: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Cut the bits into radius + agree blocks: two fingerprints within the radius
    agree in some ``agree`` of them.  More must agree as there are more
    fingerprints, so that buckets stay small; no pair is missed for any number.
    """
    agree = next((a for a in range(1, 9) if n / 2 ** (BITS * a / (radius + a)) <= TREE_SIZE / 4), 9)
    blocks = radius + agree
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    return edges, list(combinations(range(blocks), agree))


def _block(edges: list[int], i: int) -> Column:
    width = edges[i + 1] - edges[i]
    return F.shiftrightunsigned(F.col("fp"), edges[i]).bitwiseAND(F.lit((1 << width) - 1 if width < 63 else -1))


def fingerprint_links(prints: DataFrame, radius: int = MAX_BITS) -> DataFrame:
    """Links (``a``, ``b``: ids) that join all fingerprints within ``radius`` bits of each other.

    ``prints`` has ``fp`` (distinct longs) and ``rep`` (an id for each).  Rows
    go to buckets by the values of their agreeing blocks; a bucket with more
    than ``TREE_SIZE`` fingerprints is dealt into that many shards, and each
    shard's tree is sent to the queries of every shard of the bucket.  A work
    unit gives a spanning forest of its links, never all pairs.
    """
    n = prints.count()
    edges, tables = _tables(n, radius)
    keyed = prints.select(
        "fp",
        "rep",
        F.posexplode(F.array(*[F.xxhash64(*[_block(edges, i) for i in t]) if len(t) > 1 else _block(edges, t[0]) for t in tables])).alias("tab", "val"),
    )
    large = stored(keyed.groupBy("tab", "val").count().where(F.col("count") > TREE_SIZE).select("tab", "val", F.ceil(F.col("count") / TREE_SIZE).cast("int").alias("s")), "simhash-large")
    units = max(1, ceil(n / TREE_SIZE))
    plain = keyed.join(large, ["tab", "val"], "left_anti").select(
        "tab", "val", "fp", "rep", F.pmod(F.xxhash64("val"), F.lit(units)).alias("home"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("tree"), F.lit(True).alias("asks")
    )
    own = keyed.join(large, ["tab", "val"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
    split = own.select("*", F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("other")).select(
        "tab",
        "val",
        "fp",
        "rep",
        F.col("val").alias("home"),
        F.least("own", "other").alias("i"),
        (F.greatest("own", "other") + 1).alias("j"),
        (F.col("own") <= F.col("other")).alias("tree"),
        (F.col("own") >= F.col("other")).alias("asks"),
    )
    kind = prints.schema["rep"].dataType.simpleString()
    return plain.unionByName(split).groupBy("tab", "home", "i", "j").applyInPandas(_link(radius), f"a {kind}, b {kind}")


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_in_shingle: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """Fingerprint each document and label groups linked by at most ``max_bits`` differing bits.

    Equal fingerprints are folded into one before any comparison, so copies
    cost nothing; the trees hold distinct fingerprints only.

    Returns the id column, ``fingerprint`` (16 hexadecimal digits) and
    ``component_id`` (smallest id reachable by links), a row per input row.
    Cases: null and empty texts have fingerprint zero and are linked like any
    other; rows with the same id are one document that reaches all its
    fingerprints' groups; a row with a null id takes no part and has a null
    component; no rows give no rows.
    """
    ship(docs.sparkSession)
    prints = cut(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), words_in_shingle).alias("fp")))
    folded = cut(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep"), F.max("id").alias("last")))
    same = prints.where("id is not null").groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y").select("id")
    own = folded.select("fp", "rep").join(prints.join(same, "id").select("id", "fp"), "fp").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = connected_components(fingerprint_links(folded.select("fp", "rep"), max_bits).unionByName(own))
    named = cut(folded.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component")))
    joined = prints.join(named, "fp", "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"),
    )


def simhash_near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_in_shingle: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates.

    Columns are those of ``docs``.  Of rows that share the kept id, the one
    with the smallest text stays (nulls first); rows with a null id all stay.
    Column names don't matter; null and empty texts, and no rows, are as in
    ``simhash_groups``.
    """
    docs, renamed = aside(docs, "_kept", "_nth")
    id_col, text_col = renamed.get(id_col, id_col), renamed.get(text_col, text_col)
    groups = simhash_groups(docs, id_col, text_col, words_in_shingle, max_bits)
    kept = groups.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_kept")).distinct()
    rows = docs.join(kept, F.col(id_col) == F.col("_kept"), "left_semi")
    first = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(id_col).orderBy(text_col))).where("_nth = 1").drop("_nth")
    return restored(first.unionByName(docs.where(F.col(id_col).isNull())), renamed)
