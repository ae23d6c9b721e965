"""Embedding near-deduplication: spherical k-means cells, blocked cosine products, one representative per group."""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.components import connected_components
from sluice.llm.shared import aside, cut, restored, ship, stored
from sluice.llm.simhash import Union
from sluice.llm.vectors import directions, padded, unit

MIN_COSINE = 0.95
#: Bytes of the vectors of a cell, and of a block at most, on average: a unit of work holds two blocks.
BLOCK_BYTES = 8 << 20
#: Centres at most, so that they are small enough to send to every task; larger cells are dealt into more blocks.
MAX_CENTRES = 4096
ROUNDS = 3
#: Rows of one product of a block.
ROWS_AT_ONCE = 512
#: Slack for rounding in the test whether a vector can have links beyond its cell.
SLACK = 1e-9


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    products = vectors @ centres.T
    return products.argmax(axis=1), products


def block_rows(width: int) -> int:
    """Vectors of a block, and of a cell on average."""
    return max(1, BLOCK_BYTES // (8 * max(1, width)))


def fit_centres(rows: DataFrame, k: int, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means over all rows: each round sums the unit vectors of each cell and normalises the sums.

    The start are the ``k`` rows with the smallest hashes.  A round's sums
    are formed once per task, then by Spark per cell and component; the driver
    gets ``k`` vectors.  Centres only deal out the work: links don't depend on them.
    """
    first = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(k).toPandas()
    centres = padded(first["v"], width)
    for _ in range(rounds):

        def sums(batches, centres=centres):
            total, some = np.zeros_like(centres), np.zeros(len(centres), bool)
            for batch in batches:
                for at in range(0, len(batch), ROWS_AT_ONCE):
                    vectors = padded(batch["v"].iloc[at : at + ROWS_AT_ONCE], width)
                    cell, _ = _nearest(vectors, centres)
                    np.add.at(total, cell, vectors)
                    some[cell] = True
            hit = np.flatnonzero(some)
            yield pd.DataFrame({"cell": np.repeat(hit, width), "i": np.tile(np.arange(width), len(hit)), "x": total[hit].ravel()})

        found = rows.select("v").mapInPandas(sums, "cell long, i long, x double").groupBy("cell", "i").agg(F.sum("x").alias("x")).toPandas()
        total = np.zeros_like(centres)
        total[found["cell"], found["i"]] = found["x"]
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centres)
    return centres


def _cells(centres: np.ndarray, min_cosine: float):
    """Each vector's own cell, and the cells with a smaller number in which it may have links.

    Two unit vectors with a cosine of c or more lie sqrt(2 - 2c) apart at most, so if one
    lies in another cell, the other is no further from the plane between the
    two centres.  Of a linked pair in two cells, the one in the higher cell
    therefore visits the lower one, and no link is missed.
    """
    reach = sqrt(max(0.0, 2 - 2 * min_cosine)) + SLACK
    apart = np.linalg.norm(centres[:, None] - centres[None], axis=2) if len(centres) <= 512 else None
    width = centres.shape[1]

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.iloc[at : at + ROWS_AT_ONCE]
                own, products = _nearest(padded(part["v"], width), centres)
                gap = apart[own] if apart is not None else np.sqrt(np.maximum(0, 2 - 2 * centres[own] @ centres.T))
                near = products[np.arange(len(part)), own][:, None] - products <= reach * gap + SLACK
                near &= np.arange(len(centres))[None] < own[:, None]
                row, cell = np.nonzero(near)
                every = np.concatenate([np.arange(len(part)), row])
                out = part.iloc[every].reset_index(drop=True)
                yield out.assign(cell=np.concatenate([own, cell]), guest=np.repeat([False, True], [len(part), len(row)]))[["dim", "cell", "guest", "k", "rep", "copies", "v"]]

    return run


def _link(min_cosine: float):
    """Links of a unit: hosts among themselves if they are the asked rows too, else hosts against the asked rows.

    Returns a row per vector with links: how many, counting copies, and the
    smallest id of its group within the unit; pairs are never listed.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", kind="stable", ignore_index=True)
        vectors, copies = unit(rows["v"]), rows["copies"].to_numpy().astype(float)
        left, right = np.flatnonzero(rows["host"]), np.flatnonzero(rows["asked"])
        same = bool((rows["host"] & rows["asked"]).any())
        links, sets = np.zeros(len(rows)), Union(len(rows))
        against = np.ascontiguousarray(vectors[right].T) if len(right) else None
        for at in range(0, len(left) if len(right) else 0, ROWS_AT_ONCE):
            part = left[at : at + ROWS_AT_ONCE]
            hit = vectors[part] @ against >= min_cosine
            if same:
                hit &= part[:, None] != right[None]
            if hit.any():
                links[part] += hit @ copies[right]
                if not same:
                    links[right] += copies[part] @ hit
                sets.unite(*_forest(hit, part, right))
        some = links > 0
        return pd.DataFrame({"k": rows["k"][some], "n": links[some].astype(np.int64), "rep": rows["rep"][some], "to": rows["rep"].to_numpy()[sets.labels()[some]]})

    return run


def _forest(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few links that connect all that the hits connect: each column to its first row, and each other row of a column to that first row once."""
    columns = np.flatnonzero(hit.any(axis=0))
    first = hit[:, columns].argmax(axis=0)
    joins = np.zeros((len(left), len(left)), bool)
    row, column = np.nonzero(hit[:, columns])
    joins[row, first[column]] = True
    a, b = np.nonzero(joins)
    return np.concatenate([left[first], left[a]]), np.concatenate([right[columns], left[b]])


def _units(placed: DataFrame, block: int) -> DataFrame:
    """Deal the hosts and guests of each cell into blocks, and send each block to its meetings with the others."""
    blocks = placed.groupBy("dim", "cell").agg(F.ceil(F.count_if(~F.col("guest")) / block).cast("int").alias("hosts"), F.ceil(F.count_if("guest") / block).cast("int").alias("guests"))
    dealt = placed.join(stored(blocks.where("hosts > 0"), "embedding-blocks"), ["dim", "cell"])
    of = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
    columns = ["dim", "cell", "k", "rep", "copies", "v"]
    yes, no = F.lit(True), F.lit(False)
    hosts = dealt.where("not guest").withColumn("own", of("hosts"))
    guests = dealt.where("guest").withColumn("own", of("guests"))
    among = hosts.select("*", each("hosts")).select(*columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("host"), (F.col("own") >= F.col("other")).alias("asked"))
    meeting = hosts.where("guests > 0").select("*", each("guests")).select(*columns, F.col("own").alias("i"), (F.col("other") + F.col("hosts")).alias("j"), yes.alias("host"), no.alias("asked"))
    visiting = guests.select("*", each("hosts")).select(*columns, F.col("other").alias("i"), (F.col("own") + F.col("hosts")).alias("j"), no.alias("host"), yes.alias("asked"))
    return among.unionByName(meeting).unionByName(visiting)


def embedding_groups(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = MIN_COSINE) -> DataFrame:
    """Link all vectors with a cosine of at least ``min_cosine`` and label the groups.

    Vectors are dealt to cells by spherical k-means; a vector also visits the
    cells in which it may have links, by an exact bound, so every link is
    found.  The hosts and the guests of a cell are dealt into blocks of about
    ``BLOCK_BYTES``, and each meeting of two blocks is a unit of work: one blocked
    product, whose links are counted and folded into a spanning forest.
    Equal vectors are folded into one first.

    Returns a row per input row: the id column, ``n_links`` (other vectors
    linked directly), ``component_id`` (smallest id reachable by links, itself
    included) and ``kept`` (is it that smallest one).  Cosines are taken in
    double precision.  Cases: vectors that are null, empty, zero or hold null
    or non-finite components link with nothing; vectors of different
    dimensions don't link; rows with the same id and vector are one vector,
    and an id with several vectors reaches the groups of all of them, each row
    counting the links of its own vector; a row with a null id has no links
    and no component and isn't kept; no rows give no rows.
    """
    ship(embeddings.sparkSession)
    folded = directions(embeddings, id_col, vector_col).groupBy("dim", "v").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("copies"))
    items = cut(folded.withColumn("k", F.monotonically_increasing_id()))
    size = items.agg(F.count("*").alias("n"), F.max("dim").alias("d")).first()
    rep_kind = items.schema["rep"].dataType.simpleString()
    row = f"dim int, cell long, guest boolean, k long, rep {rep_kind}, copies long, v array<double>"
    block = block_rows(size["d"] or 1)
    centres = fit_centres(items, min(MAX_CENTRES, max(1, ceil(size["n"] / block))), size["d"] or 1)
    placed = cut(items.mapInPandas(_cells(centres, min_cosine), row))
    found = cut(_units(placed, block).groupBy("dim", "cell", "i", "j").applyInPandas(_link(min_cosine), f"k long, n long, rep {rep_kind}, to {rep_kind}"))
    several = directions(embeddings, id_col, vector_col).groupBy("id").agg(F.min("v").alias("x"), F.max("v").alias("y")).where("x <> y")
    own = several.select("id").join(directions(embeddings, id_col, vector_col), "id").join(items.select("v", "rep"), "v").select(F.col("id").alias("rep"), F.col("rep").alias("to"))
    reached = connected_components(found.select("rep", "to").unionByName(own), "rep", "to")
    counts = found.groupBy("k").agg(F.sum("n").alias("n"))
    labelled = items.join(counts, "k", "left").join(reached.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = cut(labelled.select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    rows = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).join(labelled, "v", "left")
    known = F.col("id").isNotNull()
    component = F.when(known, F.coalesce("component", "id"))
    return rows.select(
        F.col("id").alias(id_col),
        F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )


def embedding_near_dedup(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = MIN_COSINE) -> DataFrame:
    """Keep the rows whose id is its group's smallest; rows with a null id stay too.

    Columns are those of the input, whatever their names.  Vectors that link
    with nothing stay; of rows that share a kept id all stay; vectors that are
    null, zero, empty or not finite, and no rows, are as in ``embedding_groups``.
    """
    embeddings, renamed = aside(embeddings, "_kept")
    id_col, vector_col = renamed.get(id_col, id_col), renamed.get(vector_col, vector_col)
    kept = embedding_groups(embeddings, id_col, vector_col, min_cosine).where("kept").select(F.col(id_col).alias("_kept")).distinct()
    rows = embeddings.join(kept, F.col(id_col) == F.col("_kept"), "left_semi")
    return restored(rows.unionByName(embeddings.where(F.col(id_col).isNull())), renamed)
