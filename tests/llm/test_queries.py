"""Queries that SQL can't express, against plain Python over the whole table: all contract columns."""

import binascii
import hashlib
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import xxhash
from tokenizers import Tokenizer

from sluice.llm.queries import QUERIES, tokenizer_path
from tests.conftest import SF_SMALL


def documents(spark):
    return sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())


def test_op5_simhash_near_dedup(spark):
    prints = {}
    for i, text in documents(spark):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    group = {i: i for i in prints}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    expected = [(i, f"{prints[i]:016x}", root(i)) for i in ids]
    found = QUERIES["op5_simhash_near_dedup"](spark, SF_SMALL).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, found)) == expected


def test_op6_packing(spark):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {i: tokenizer.encode(t, add_special_tokens=False).ids + [0] for i, t in documents(spark)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    rows = QUERIES["op6_packing"](spark, SF_SMALL).collect()
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(part) > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, whole in ids.items():  # each id in exactly one piece
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(whole)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.01 * sum(map(len, ids.values()))


def luhn(digits):
    total = 0
    for n, d in enumerate(reversed(digits)):
        d = int(d) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def test_op8_pii(spark):
    found = {r["doc_id"]: r for r in QUERIES["op8_pii"](spark, SF_SMALL).collect()}
    docs = documents(spark)
    assert len(found) == len(docs)
    for i, text in docs:
        spans = [(m.start(), n, kind, m.end()) for n, (kind, (pattern, ok)) in enumerate(BASE.items()) for m in re.finditer(pattern, text) if ok(m.group())]
        said = [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans)]
        r = found[i]
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[2] == k for s in spans) for k in BASE]
        assert r["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()
        every = r["spans"].split(",") if r["spans"] else []
        assert [s for s in every if s.split(":")[0] in BASE] == said


def test_op9_quality(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    rows = QUERIES["op9_quality"](spark, SF_SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs)
    for r in rows:
        assert r["held_out"] == (binascii.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    judged = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([s for s, y in judged if y == k] for k in (1, 0))
    if good and bad:
        assert np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.9


def test_scores_follow_the_text_alone(spark):
    from pyspark.sql import functions as F

    from sluice.llm.quality import fit_quality, score_quality

    docs, labels = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels)
    a = {r["doc_id"]: r["score"] for r in score_quality(docs, model).collect()}
    turned = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy"), "doc_id": -F.col("doc_id")})
    assert {-r["doc_id"]: r["score"] for r in score_quality(turned, model).collect()} == a
