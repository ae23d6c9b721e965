"""Packing: ids, cuts and sequences against the tokenizer itself."""

import random
import struct
from collections import defaultdict

import pyarrow as pa
import pytest

from sluice.llm.packing import Encoder, best_fit, fill, pack
from sluice.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def path():
    return tokenizer_path()


def test_ids_are_the_tokenizers(path):
    encoder, rnd = Encoder(path), random.Random(1)
    parts = ["a", "Bc", "12", " ", "  ", "\n", "\t", "'s", "é", "!", "\xa0", "\x1c", " ", "中", "<|endoftext|>", "​", "😀", "\r\n"]
    texts = ["", " ", "  ", " a", "a ", "a\n b", "don't  I'll", *["".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(3000)]]
    expected = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(pa.array(texts)) == expected
    assert encoder.encode(pa.array(texts)) == expected  # now remembered


def test_best_fit_takes_the_tightest_window():
    assert best_fit([6, 5, 4, 3, 2], 10) == [[0, 2], [1, 3, 4]]
    rnd = random.Random(2)
    for _ in range(50):
        lengths = [rnd.randint(1, 64) for _ in range(rnd.randint(0, 80))]
        open_, where = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):  # by search over all windows
            fits = [w for w in open_ if w[0] >= lengths[i]]
            w = min(fits, key=lambda w: w[0]) if fits else None
            if w is None:
                open_.append(w := [64, []])
            w[0] -= lengths[i]
            w[1].append(i)
            where[i] = w
        found = best_fit(lengths, 64)
        assert sorted(i for w in found for i in w) == list(range(len(lengths)))
        assert sorted(sum(lengths[i] for i in w) for w in found) == sorted(64 - w[0] for w in open_)


def test_gaps_are_filled():
    rnd = random.Random(3)
    for _ in range(100):
        lengths = [rnd.randint(1, 63) for _ in range(rnd.randint(0, 30))]
        made = fill(lengths, best_fit(lengths, 64), 64)
        covered = sorted((i, at, n) for w in made for i, at, n in w)
        for i, n in enumerate(lengths):
            at = 0
            for _, start, length in (c for c in covered if c[0] == i):
                assert start == at and length > 0
                at += length
            assert at == n
        assert all(sum(c[2] for c in w) in (64, 32, 16, 8, 4, 2, 1) for w in made)


def test_pieces(spark, path):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices(["alpha", "beta", "gamma,", "x\ny"], k=rnd.randint(0, 900))), 1) for i in range(60)]
    rows += [(100, None, 1), (101, "", 1), (102, "long " * 30_000, 1), (None, "no id", 1), (3, "again", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int").coalesce(3)
    tokenizer = Encoder(path).tokenizer
    expected = sorted(str((i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0])) for i, t, _ in rows)
    out = pack(df, path).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in out:
        ids = list(struct.unpack(f"<{r['length']}I", r["ids"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[(r["doc_id"], r["doc_tokens"])].append((r["start"], ids))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    whole = []
    for (doc, total), pieces in documents.items():
        ids = [x for _, part in sorted(pieces) for x in part]
        assert len(ids) == total
        whole.append(str((doc, ids)))
    assert sorted(whole) == expected


def test_no_rows(spark, path):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), path).collect() == []


def test_new_words_share_calls_of_the_tokenizer(path, monkeypatch):
    encoder, calls = Encoder(path), []
    ids = encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda text: calls.append(text) or ids(text))
    texts = [" ".join(f"w{i}.\nNext{j}" for j in range(200)) for i in range(5)]
    expected = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(pa.array(texts)) == expected
    assert len(calls) < 20  # 1000 words, of which the first of a text goes alone
    encoder.later.clear()
    encoder.spaced[:] = False  # a vocabulary that doesn't tell where a word begins
    assert encoder.encode(pa.array(texts)) == expected
