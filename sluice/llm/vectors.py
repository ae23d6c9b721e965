"""Embedding columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Vectors that have a direction: not null or empty, only finite components, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id``, ``dim`` and ``v`` (doubles) of the usable vectors; rows with a null id are left out."""
    v = F.col(vector_col).cast("array<double>")
    return df.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).select("id", F.size("v").alias("dim"), "v")


def unit(vectors: pd.Series | list) -> np.ndarray:
    """A matrix of unit rows; large and tiny components neither overflow nor vanish."""
    m = np.stack([np.asarray(v, float) for v in vectors]) if len(vectors) else np.empty((0, 0))
    m = m / np.abs(m).max(axis=1, keepdims=True) if len(m) else m
    return m / np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m


def padded(vectors: pd.Series, width: int) -> np.ndarray:
    """Unit rows of vectors of mixed dimensions, filled up with zeros."""
    out = np.zeros((len(vectors), width))
    sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        out[rows, :d] = unit(vectors.iloc[rows])
    return out
