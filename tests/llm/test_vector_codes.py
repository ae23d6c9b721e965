"""Product codes against exhaustive search in whole numbers."""

import hashlib
from math import floor

import numpy as np
from pyspark.sql import functions as F

from sluice.llm.queries import QUERIES
from sluice.llm.vector_codes import GNAT, codebook_text, component_limit, squared, vector_codes
from tests.conftest import SF_SMALL


def brute(rows, entries=256, rounds=4):
    """rows: (id, vector, label), sorted by id; plain Python numbers throughout."""
    width = -(-max((len(v) for _, v, _ in rows), default=0) // 4)
    whole = [[floor(1024 * x) for x in v] + [0] * (4 * width - len(v)) for _, v, _ in rows]
    parts = [[w[p * width : (p + 1) * width] for p in range(4)] for w in whole]
    books = [[row[p] for row in parts[:entries]] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            owner = [near(row[p], books[p])[1] for row in parts]
            for k in set(owner):
                mine = [row[p] for row, o in zip(parts, owner, strict=True) if o == k]
                books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for (i, _, label), row in zip(rows, parts, strict=True):
        found = [near(row[p], books[p]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    total = {}
    for _, _, e, label in out:
        total[label] = total.get(label, 0) + e
    return sorted(((i, c, e, total[label]) for i, c, e, label in out), key=str), ",".join(str(x) for book in books for e in book for x in e)


def test_gnat_finds_the_nearest_entry_and_saves_distances():
    rnd = np.random.default_rng(1)
    for size, width, spread in [(1, 3, 9), (7, 2, 3), (256, 2, 5), (256, 1, 40), (200, 16, 500), (256, 3, 100000), (40, 0, 1)]:
        entries, points = rnd.integers(-spread, spread, (size, width)), rnd.integers(-spread, spread, (3000, width))
        points[:size] = entries[: len(points)]
        tree = GNAT(entries)
        code, best, taken = tree.nearest(points)
        away = squared(points, entries)
        assert (best == away.min(axis=1)).all() and (code == away.argmin(axis=1)).all()  # argmin: the lowest index of a tie
        if (size, width) == (256, 3):
            assert taken < 0.4 * away.size


def test_ties_on_a_line():
    entries = np.array([[0], [10], [5], [5], [20], *[[100 + i] for i in range(30)]])
    code, best, _ = GNAT(entries).nearest(np.array([[5], [15], [-3], [7], [8], [102]]))
    assert code.tolist() == [2, 1, 0, 2, 1, 7] and best.tolist() == [0, 25, 9, 4, 4, 0]


def test_query(spark):
    rows = sorted((r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").limit(1000).collect())
    expected, books = brute(rows)
    found = QUERIES["op12_vector_codes"](spark, SF_SMALL).collect()
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found), key=str) == expected
    assert {r["codebooks_sha256"] for r in found} == {hashlib.sha256(books.encode()).hexdigest()}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rnd = np.random.default_rng(2)
    good = [(i, [float(x) for x in rnd.normal(size=8)], "ab"[i % 2] if i % 5 else None) for i in range(60)]
    good += [(100, [], "a"), (101, [-0.0005], None), (102, [1.0] * 8, "a"), (102, [1.0] * 8, "a"), (103, [0.0] * 8, "b"), (None, [2.0] * 8, "b")]
    bad = [(200, None, "a"), (201, [nan] * 8, "a"), (202, [inf] + [1.0] * 7, "a"), (203, [None] + [1.0] * 7, "b")]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, label string").repartition(4)
    df = df.withColumns({c: F.lit("x") for c in ("id", "v", "of", "code", "error", "label_error", "part", "entry")})
    coded, books = vector_codes(df, entries=20, rounds=3)
    expected, text = brute(sorted(good, key=lambda r: (r[0] is None, r[0] or 0)), 20, 3)
    assert sorted((tuple(r) for r in coded.collect()), key=str) == expected
    assert codebook_text(books) == text


def test_few_rows_none_and_huge_numbers(spark):
    schema = "vec_id long, embedding array<double>, label string"
    few, books = vector_codes(spark.createDataFrame([(2, [1.0, 2.0, 3.0, 4.0], "a"), (1, [1.0, 2.0, 3.0, -4.0], "a")], schema))
    assert sorted(map(tuple, few.collect())) == [(1, "00000000", 0, 0), (2, "00000001", 0, 0)]
    assert codebook_text(books) == "1024,1024,2048,2048,3072,3072,-4096,4096"
    none, books = vector_codes(spark.createDataFrame([(1, None, "a")], schema))
    assert none.collect() == [] and codebook_text(books) == ""
    huge, books = vector_codes(spark.createDataFrame([(1, [1e300, 0.0, 0.0, 0.0], "a"), (2, [-1e300, 0.0, 0.0, 0.0], "a")], schema))
    limit = component_limit(1)
    assert sorted(r["code"] for r in huge.collect()) == ["00000000", "01000000"] and books[0].ravel().tolist() == [limit, -limit]
