"""Nearest neighbours: recall against brute force, ties and odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from sluice.llm import ann
from sluice.llm.ann import KDTree, chi_square, chi_square_quantile, nearest, projection
from sluice.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>, rank string"


def test_chi_square():
    # 10,000 squared lengths of projected unit vectors
    rng = np.random.default_rng(1)
    v = rng.standard_normal((10_000, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    r = ((v @ rng.standard_normal((24, 8))) ** 2).sum(axis=1)
    assert abs(chi_square(8.0, 8) - 0.5665) < 1e-3 and abs(chi_square_quantile(0.95, 8) - 15.507) < 1e-2
    assert 0 < r.mean() < 16


def test_leaves_bound_their_points():
    points = np.random.default_rng(2).standard_normal((500, 8))
    tree = KDTree(points)
    assert sorted(tree.members[tree.members >= 0]) == list(range(500))
    q = np.random.default_rng(3).standard_normal((5, 8))
    bound = tree.bounds(q)
    for leaf, part in enumerate(tree.members):
        part = part[part >= 0]
        assert (bound[:, leaf] <= ((q[:, None] - points[part]) ** 2).sum(axis=2).min(axis=1) + 1e-9).all()
    assert projection(16).shape == (16, 8) and (projection(16) == projection(16)).all()


def test_recall_over_shards(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 300)
    v = np.random.default_rng(4).standard_normal((1500, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), "x") for i, x in enumerate(v)], SCHEMA)
    got = nearest(df, F.col("vec_id") % 20 == 0).collect()
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    found = sum(r["vec_id"] in set(np.argsort(-s[r["query_id"]])[:5]) for r in got)
    assert len(got) == 75 * 5 and found / len(got) >= 0.9
    assert all(abs(r["score"] - s[r["query_id"], r["vec_id"]]) < 1e-12 for r in got)
    for q in range(0, 1500, 20):
        own = sorted((r["rank"], -r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _ in own] == [1, 2, 3, 4, 5] and [x for _, x in own] == sorted(x for _, x in own)


def test_ties_and_odd_vectors(spark):
    nan = float("nan")
    rows = [(i, [1.0, 1.0]) for i in range(12)] + [(20, [3.0, 0.0]), (21, None), (22, []), (23, [0.0, 0.0]), (24, [nan, 1.0]), (25, [None, 1.0]), (26, [1.0]), (27, [-2.0]), (None, [1.0, 1.0]), (3, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = {}
    for r in nearest(df, F.col("vec_id").isin(0, 20, 21, 23, 24, 26)).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [1, 2, 3, 4, 5], 20: [0, 1, 2, 3, 4], 26: [27]}
    assert nearest(df, F.lit(False)).collect() == []
    assert nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []


def test_many_vectors_of_one_id_spread_over_shards(spark, monkeypatch):
    """Shards are dealt by id and vector; queries stream past each shard in several batches."""
    monkeypatch.setattr(ann, "SHARD", 50)
    v = np.random.default_rng(5).standard_normal((400, 8))
    df = spark.createDataFrame([(7 if i < 200 else i, x.tolist(), "x") for i, x in enumerate(v)], SCHEMA)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = nearest(df, F.col("vec_id") % 4 == 0, confidence=0.999999).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(200, 400, 4):
        best = {}
        for i in range(400):
            if i != q:
                best[7 if i < 200 else i] = max(best.get(7 if i < 200 else i, -9), u[q] @ u[i])
        expected = sorted(best, key=lambda i: (-best[i], i))[:5]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == expected


def test_query(spark):
    """op4_ann with its production parameters on a whole table: recall, ranks and scores against brute force."""
    rows = sorted((r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    at = {i: n for n, i in enumerate(ids.tolist())}
    got = {}
    for r in QUERIES["op4_ann"](spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [i for i in ids.tolist() if i % 50 == 0]
    hits = 0
    for q, found in got.items():
        s = u @ u[at[q]]
        s[at[q]] = -9
        assert [rank for rank, *_ in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(abs(score - s[at[i]]) < 1e-12 for _, i, score in found)
        assert [i for _, i, _ in sorted(found)] == [i for _, i, _ in sorted(found, key=lambda f: (-f[2], f[1]))]
        hits += len(set(np.argsort(-s)[:5]) & {at[i] for _, i, _ in found})
    assert hits / (5 * len(got)) >= 0.9
