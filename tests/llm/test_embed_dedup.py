"""Embedding near-dedup against all pairs in numpy."""

import numpy as np
import pytest

from sluice.llm import embed_dedup
from sluice.llm.embed_dedup import embedding_groups, embedding_near_dedup

SCHEMA = "vec_id long, embedding array<float>, n_links string"


def _vectors(n=240, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    rows = rng.standard_normal((n, dim))
    rows[40:80] = rows[0] + 0.05 * rng.standard_normal((40, dim))  # a group of near copies
    for i in range(100, 140):  # chains
        rows[i] = rows[i - 1] + 0.28 * rng.standard_normal(dim)
    rows[200:210] = rows[199]  # exact copies
    return rows.astype(np.float32)


def _brute(ids, vectors):
    v = np.asarray(vectors, float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    hit = v @ v.T >= 0.95
    np.fill_diagonal(hit, False)
    reach = hit | np.eye(len(ids), dtype=bool)
    while ((wider := (reach.astype(int) @ reach) > 0) != reach).any():
        reach = wider
    ids = np.array(ids)
    return {int(i): (int(hit[k].sum()), int(ids[reach[k]].min())) for k, i in enumerate(ids)}


@pytest.mark.parametrize("block", [4096, 40, 15])
def test_all_links_are_found_however_the_work_is_dealt(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK_BYTES", block * 16 * 8)
    vectors = _vectors()
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], SCHEMA)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_groups(df).collect()}
    assert got == _brute(range(len(vectors)), vectors)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 0.0]), (10, [1e-30, 0.0]), (2, [2.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in embedding_groups(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    alone = [(i, 0, i, True) for i in range(3, 10)]
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (10, 2, 1, False), (None, 0, None, False), *alone], key=str)
    kept = embedding_near_dedup(df)
    assert kept.columns == df.columns
    assert sorted(map(str, (r["vec_id"] for r in kept.collect()))) == sorted(["1", *map(str, range(3, 10)), "None"])


def test_no_rows(spark):
    assert embedding_groups(spark.createDataFrame([], SCHEMA)).collect() == []
