"""SimHash near-dedup against plain votes and all pairs."""

import random

import numpy as np
import pytest
import xxhash

from sluice.llm import simhash
from sluice.llm.simhash import BKForest, fingerprint, simhash_groups, simhash_near_dedup

SCHEMA = "doc_id long, text string, fingerprint string"


def _plain(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rnd = random.Random(1)
    texts = [None, "", " \t\n", "one", "One two", "a b c d", "a b c d e", "É É\xa0É x y z", "\x1c \x85 u v w"]
    texts += [" ".join(rnd.choices(["alpha", "Beta", "été", "x\t", "\n"], k=rnd.randint(0, 60))) for _ in range(50)]
    texts.append("word " * 70_000 + "end of it all")
    assert [fingerprint(t) for t in texts] == [_plain(t) for t in texts]


def test_trees_find_all_within_the_radius():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 20).astype(np.uint64)
    prints = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 63, 30)], rng.integers(0, 2**63, 200).astype(np.uint64)]))
    buckets = rng.integers(0, 3, len(prints))
    forest = BKForest(prints, buckets)
    found = {(int(q), int(n)) for qs, ns in forest.search(prints, buckets, 4) for q, n in zip(qs, ns)}
    close = np.bitwise_count(prints[:, None] ^ prints[None]) <= 4
    assert found == {(int(a), int(b)) for a, b in zip(*np.nonzero(close & (buckets[:, None] == buckets[None])))}


def _docs():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(12):
        words = [word() for _ in range(120)]
        texts.append(" ".join(words))
        for _ in range(rnd.randint(0, 12)):
            changed = list(words)
            for _ in range(rnd.randint(0, 3)):
                changed[rnd.randrange(120)] = word()
            texts.append(" ".join(changed))
    rnd.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts + ["", None, "\n", texts[0], texts[1].upper()])]


def _components(rows):
    prints = [fingerprint(t) for _, t in rows]
    label = {i: i for i, _ in rows if i is not None}
    links = [(a, b) for x, (a, _) in enumerate(rows) for y, (b, _) in enumerate(rows) if a is not None and b is not None and (prints[x] ^ prints[y]).bit_count() <= 4]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sorted(((i, f"{p:016x}", label.get(i)) for (i, _), p in zip(rows, prints)), key=str)


@pytest.mark.parametrize("tree_size", [1 << 14, 3])
def test_groups(spark, monkeypatch, tree_size):
    monkeypatch.setattr(simhash, "TREE_SIZE", tree_size)
    rows = _docs()
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in simhash_groups(df).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == _components(rows)


def test_more_agreeing_blocks_miss_nothing(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_tables", lambda n, radius, f=simhash._tables: f(1 << 30, radius))
    rows = _docs()
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in simhash_groups(df).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == _components(rows)


def test_odd_rows(spark):
    rows = [(None, "a b c d e"), (1, "a b c d e"), (2, "A B C D E"), (3, None), (4, ""), (5, "p q r s t u"), (5, "a b c d e"), (5, "p q r s t u")]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    groups = {(r["doc_id"], r["component_id"]) for r in simhash_groups(df).collect()}
    assert groups == {(None, None), (1, 1), (2, 1), (3, 3), (4, 3), (5, 1)}
    kept = simhash_near_dedup(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect() if r["doc_id"] != 3) == [(0, "a b c d e"), (1, "a b c d e")]
    assert simhash_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    assert simhash_near_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
