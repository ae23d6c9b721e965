"""Quality classifier: trees against a plain walk, held-out accuracy, odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from sluice.llm.quality import FEATURES, fit, fit_quality, held_out, score_quality, statistics

DATA = "/root/testdata/sf0.1"


def test_flattened_trees_give_what_a_plain_walk_gives():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = fit(x, y, trees=20, depth=3)
    for row, p in zip(x[:50], model.predict(x[:50]), strict=True):
        total = model.bias
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        assert abs(p - 1 / (1 + np.exp(-total))) < 1e-12
    assert ((model.predict(x) > 0.5) == y).mean() > 0.95


def test_without_usable_labels():
    for y in (np.zeros(0), np.ones(4), np.zeros(4)):
        p = fit(np.zeros((len(y), 3)), y).predict(np.zeros((2, 3)))
        assert ((p > 0) & (p < 1)).all()


def test_statistics_of_odd_texts():
    assert statistics(None) == statistics("") == [0.0] * len(FEATURES)
    for text in (" ", "\n", "é", "a " * 400_000):
        assert len(statistics(text)) == len(FEATURES) and np.isfinite(statistics(text)).all()


def test_statistics_of_a_text_do_not_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 4, 5, 7, 8, 9, 60):
        words = [f"w{k}" for k in rng.integers(0, 3, n)]
        found = {}
        for size in (4, 1 << 18):
            monkeypatch.setattr("sluice.llm.quality.WORDS_AT_ONCE", size)
            found[size] = dict(zip(FEATURES, statistics(" ".join(words)), strict=True))
        assert found[4] == found[1 << 18]
        assert found[4]["distinct_triples"] == len({tuple(words[i : i + 3]) for i in range(n - 2)}) / max(1, n - 2)
        assert found[4]["adjacent_repeats"] == sum(words[i] == words[i + 1] for i in range(n - 1)) / n


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels)
    scored = score_quality(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(held_out("doc_id")).toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in scored["doc_id"])
    good = scored["quality"] == 1
    assert (scored["predicted"][good] == 1).mean() > 0.97 and (scored["predicted"][~good] == 0).mean() > 0.9


def test_repeated_ids_count_once_in_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr("sluice.llm.quality.fit", lambda x, y: seen.append((x, y)) or fit(x, y))
    rows = [(i, f"text {i}") for i in range(40)] + [(1, "text z")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (1, 1)] * 20, "doc_id long, quality int")
    fit_quality(docs, labels)
    fit_quality(docs.repartition(7), labels)
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    assert 1 in ids
    for x, y in seen:
        assert x.tolist() == [statistics(f"text {i}") for i in ids] and y.tolist() == [0.0 if i == 1 else i % 2 for i in ids]


def test_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", 5), (2, None, 5), (3, "", 5), (None, "x", 5), (1, "a b c", 5)], "doc_id long, text string, Score int")
    labels = spark.createDataFrame([(1, None), (2, 7), (None, 1), (3, 1)], "doc_id long, quality int")
    out = score_quality(docs, fit_quality(docs, labels))
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert score_quality(docs.limit(0), fit_quality(docs, labels.limit(0))).collect() == []
    assert docs.select(held_out("doc_id").alias("h")).where(F.col("h").isNull()).count() == 0
