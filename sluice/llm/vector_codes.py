"""Product codes of vectors; a geometric near-neighbour access tree finds the nearest codebook entry."""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import cut, ship, stored

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Split points of a tree node, and entries that a leaf holds at most.
DEGREE = 16
LEAF = 64
#: Vectors coded together.
ROWS_AT_ONCE = 1 << 12
#: Relative and absolute slack, so that rounding never rules out an entry.
SLACK = 1e-9
#: Squared distances of a part stay below this, so that they and their sums are exact.
MOST = 1 << 60


class GNAT:
    """A tree over the entries of a codebook.

    A node has up to ``DEGREE`` split points, far from each other; each other
    entry goes to its nearest one.  For each pair of split point i and child
    j the node knows between which distances from i all entries of j lie.
    """

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.root = self._node(np.arange(len(entries)))

    def _node(self, members: np.ndarray):
        if len(members) <= LEAF:
            return members, None, None, None
        pool = np.linspace(0, len(members) - 1, min(len(members), 3 * DEGREE)).astype(np.int64)
        chosen, near = [0], squared(self.entries[members[pool]], self.entries[members[:1]])[:, 0]
        while len(chosen) < DEGREE and near.max() > 0:  # of a spread-out few, those furthest from each other
            chosen.append(int(pool[near.argmax()]))
            near = np.minimum(near, squared(self.entries[members[pool]], self.entries[members[chosen[-1:]]])[:, 0])
        if len(chosen) == 1:  # equal entries, it seems: nothing to split
            return members, None, None, None
        chosen = sorted(chosen)  # members ascend everywhere, so that the first of equal distances has the lowest index
        splits = members[chosen]
        away = squared(self.entries[members], self.entries[splits])
        owner = away.argmin(axis=1)
        owner[chosen] = np.arange(len(chosen))
        roots = np.sqrt(away.astype(float))
        rest = np.setdiff1d(np.arange(len(members)), chosen)
        kept = [j for j in range(len(splits)) if (owner[rest] == j).any()]  # split points without others have no subtree
        low, high = (np.stack([end(roots[rest[owner[rest] == j]], axis=0) for j in kept], axis=1) if kept else None for end in (np.min, np.max))
        children = [(j, self._node(members[rest[owner[rest] == j]])) for j in kept]
        return splits, low, high, children

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each point (ties to the lower index), its squared distance, and how many distances were taken.

        A point visits the child of its nearest split point first.  Another
        child is left out only if, by its distance range from some split
        point, all of it lies strictly beyond the best distance so far, with
        slack for the rounding of roots.  Distances are compared as whole
        numbers, so ties are true ties; they are taken by a product of
        matrices where doubles hold all its sums exactly.
        """
        most = int(max(np.abs(points).max(initial=0), np.abs(self.entries).max(initial=0)))
        self.exact = 4 * max(1, points.shape[1]) * most * most < 1 << 53
        self.points, self.against = (x.astype(float) if self.exact else x for x in (points, self.entries))
        self.sizes, self.lengths = ((x * x).sum(axis=1) if self.exact else None for x in (self.points, self.against))
        self.best = np.full(len(points), np.inf) if self.exact else np.full(len(points), np.iinfo(np.int64).max)
        self.code = np.zeros(len(points), np.int64)
        self.taken = 0
        self._walk(self.root, np.arange(len(points)))
        best = self.best.astype(np.int64) if len(self.entries) else np.zeros(len(points), np.int64)
        return self.code, best, self.taken

    def _away(self, rows: np.ndarray, members: np.ndarray) -> np.ndarray:
        self.taken += len(rows) * len(members)
        if not self.exact:
            return squared(self.points[rows], self.against[members])
        return self.points[rows] @ (-2 * self.against[members].T) + self.lengths[members] + self.sizes[rows][:, None]

    def _walk(self, node, rows: np.ndarray) -> None:
        members, low, high, children = node
        if not len(rows) or not len(members):
            return
        away = self._away(rows, members)
        nearest = away.argmin(axis=1)
        least, code = away[np.arange(len(rows)), nearest], members[nearest]
        known, had = self.best[rows], self.code[rows]
        better = (least < known) | ((least == known) & (code < had))
        self.best[rows[better]], self.code[rows[better]] = least[better], code[better]
        if not children:
            return
        for j, child in children:
            self._walk(child, rows[nearest == j])
        roots, radius = np.sqrt(away), np.sqrt(self.best[rows])[:, None] * (1 + SLACK) + SLACK
        inner, outer = roots * (1 - SLACK) - radius, roots * (1 + SLACK) + radius
        for at, (j, child) in enumerate(children):
            beyond = (inner > high[:, at] * (1 + SLACK)) | (outer < low[:, at] * (1 - SLACK))
            self._walk(child, rows[(nearest != j) & ~beyond.any(axis=1)])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between integer rows."""
    out = np.zeros((len(a), len(b)), np.int64)
    for x, y in zip(a.T, b.T, strict=True):
        out += (x[:, None] - y[None]) ** 2
    return out


def component_limit(width: int) -> int:
    return isqrt(MOST // max(1, width)) // 2


def whole_numbers(vectors: list | pd.Series, width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component, filled up with zeros to ``PARTS`` parts of ``width``."""
    out, limit = np.zeros((len(vectors), PARTS * width)), component_limit(width)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return np.clip(np.floor(out * scale), -limit, limit).astype(np.int64).reshape(len(vectors), PARTS, width)


def _assign(codebooks: np.ndarray, numbers: np.ndarray, trees: list[GNAT]) -> tuple[np.ndarray, np.ndarray]:
    found = [tree.nearest(numbers[:, p])[:2] for p, tree in enumerate(trees)]
    return np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _slices(batches, width: int):
    for batch in batches:
        for at in range(0, len(batch), ROWS_AT_ONCE):
            part = batch.iloc[at : at + ROWS_AT_ONCE]
            yield part, whole_numbers(part["v"], width)


def _sums(codebooks: np.ndarray, width: int):
    """Counts and sums of the parts that fall to each entry, once per task."""

    def run(batches):
        trees = [GNAT(book) for book in codebooks]
        total = np.zeros((PARTS, codebooks.shape[1], width + 1), np.int64)
        for _, numbers in _slices(batches, width):
            codes, _ = _assign(codebooks, numbers, trees)
            for p in range(PARTS):
                np.add.at(total[p, :, 0], codes[:, p], 1)
                np.add.at(total[p, :, 1:], codes[:, p], numbers[:, p])
        part, entry = np.nonzero(total[:, :, 0])
        at = np.tile(np.arange(width + 1), len(part))
        yield pd.DataFrame({"part": np.repeat(part, width + 1), "entry": np.repeat(entry, width + 1), "i": at, "x": total[part, entry].ravel()})

    return run


def _codes(codebooks: np.ndarray, width: int):
    def run(batches):
        trees = [GNAT(book) for book in codebooks]
        for part, numbers in _slices(batches, width):
            codes, errors = _assign(codebooks, numbers, trees)
            text = [bytes(row).hex() for row in codes.astype(np.uint8)]
            yield pd.DataFrame({"id": part["id"], "label": part["label"], "code": text, "error": errors.sum(axis=1)})[["id", "label", "code", "error"]]

    return run


def kept_vectors(embeddings: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return embeddings.select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), v.alias("v")).where(F.coalesce(F.forall("v", finite), F.lit(False)))


def fit_codebooks(rows: DataFrame, width: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component): the parts of the smallest ids, moved to their parts' means ``rounds`` times.

    All rows count in each round: tasks sum over their rows, Spark adds the
    sums up, and the driver gets a number per entry and component.
    """
    first = rows.where("id is not null").orderBy("id", "v").limit(entries).toPandas()["v"]
    if len(first) < entries:  # rows without an id come last
        first = pd.concat([first, rows.where("id is null").orderBy("v").limit(entries - len(first)).toPandas()["v"]])
    codebooks = np.ascontiguousarray(whole_numbers(first, width).transpose(1, 0, 2))
    for _ in range(rounds if len(first) else 0):
        sums = rows.select("v").mapInPandas(_sums(codebooks, width), "part int, entry int, i int, x long").groupBy("part", "entry", "i").agg(F.sum("x").alias("x")).toPandas()
        total = np.zeros((PARTS, len(first), width + 1), np.int64)
        total[sums["part"], sums["entry"], sums["i"]] = sums["x"]
        count = total[:, :, :1]
        codebooks = np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), codebooks)
    return codebooks


def vector_codes(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """Codes of all vectors, a byte for each of four parts, and the codebooks.

    Components become whole numbers, floor(1024 x), so all is exact and
    doesn't depend on the order of sums.  Codebooks start as the parts of the
    smallest ids and are fitted by ``rounds`` rounds over all rows.  Every
    nearest entry is found by a ``GNAT`` over its codebook's entries.

    Returns a row per kept row: the id column, ``code`` (an index of two hex
    digits per part), ``error`` (squared distances from the entries, summed
    over the parts) and ``label_error`` (errors summed over the rows of the
    same label).  Cases: rows whose vector is null or holds null or non-finite
    components are dropped; parts are a quarter of the longest vector, rounded
    up, and shorter vectors (empty ones, too) are filled up with zeros;
    numbers too large for exact squared distances count as the largest
    that isn't (2^28 for parts of 16 components); rows with equal ids are coded each and
    start entries in the order of their vectors; rows with a null id are coded
    and start entries last; fewer rows than entries make fewer entries; null
    labels are one label; a sum beyond a long is null; other columns don't
    matter; no rows give no rows and no entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index of two hex digits takes 1 to 256 entries")
    ship(embeddings.sparkSession)
    rows = cut(kept_vectors(embeddings, id_col, vector_col, F.col(f"`{label_col}`")))
    width = -(-(rows.agg(F.max(F.size("v"))).first()[0] or 0) // PARTS)
    codebooks = fit_codebooks(rows, width, entries, rounds)
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    coded = stored(rows.mapInPandas(_codes(codebooks, width), f"id {id_type}, label {label_type}, code string, error long"), "vector-codes")
    per_label = stored(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "vector-label-errors").withColumnRenamed("label", "of")
    out = coded.join(per_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error"), codebooks


def codebook_text(codebooks: np.ndarray) -> str:
    """All entries' components by part, entry and position, joined by commas."""
    return ",".join(map(str, codebooks.ravel().tolist()))
