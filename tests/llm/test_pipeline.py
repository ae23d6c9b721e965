"""The corpus pipeline: each stage on its predecessor's rows, held against the operators' plain readings."""

import struct
from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from sluice.llm.mixing import source_rates
from sluice.llm.shared import made, stored
from sluice.llm.simhash import fingerprint
from tests.conftest import SF_SMALL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _blank(line):
    return line.strip(" \t\n\x0b\x0c\r").encode().lower()


def test_stages(spark):
    raw = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept, rows = [raw], [{r["doc_id"]: r for r in raw.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], SF_SMALL), f"test-{name}"))
        rows.append({r["doc_id"]: r for r in kept[-1].collect()})
    assert all(df.columns == COLUMNS for df in kept[:-1])
    documents, judged, lines, single, mixed, _ = rows

    # quality: labelled good documents stay, most bad ones go; texts are untouched
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in judged for i in good) >= 0.97 * len(good)
    assert sum(i in judged for i, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values())
    assert all(judged[i] == documents[i] for i in judged)

    # lines
    held = defaultdict(set)
    for i, r in judged.items():
        for line in (r["text"] or "").split("\n"):
            held[_blank(line)].add(i)
    home = {k: max(v) for k, v in held.items() if len(k.decode()) >= 20 and len(v) >= 3}
    expected = {i: "\n".join(x for x in (r["text"] or "").split("\n") if home.get(_blank(x), i) == i) for i, r in judged.items()}
    assert {i: r["text"] for i, r in lines.items()} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values())

    # near-duplicates
    prints = {i: fingerprint(r["text"]) for i, r in lines.items()}
    label = {i: i for i in prints}
    pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    for _ in prints:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert set(single) == {i for i in prints if label[i] == i}

    # mixture: copies of what was kept, about as many characters as there were
    assert set(mixed) <= set(single)
    count = kept[4].count()
    rates = {r["source"]: r["rate"] for r in source_rates(kept[3]).collect()}
    assert abs(count - sum(rates[r["source"]] for r in single.values())) < 5 * count**0.5

    # packing: each copy is there with all its ids
    pieces = kept[5].select("doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset").collect()
    assert sum(r["start"] == 0 for r in pieces) == count
    assert all(len(r["ids"]) == 4 * r["length"] for r in pieces)
    ends = [struct.unpack("<I", r["ids"][-4:])[0] for r in pieces if r["start"] + r["length"] == r["doc_tokens"]]
    assert len(ends) == count and set(ends) == {0}
    used = defaultdict(int)
    for r in pieces:
        used[r["sequence_id"]] += r["length"]
    assert all(n == 1024 or n & (n - 1) == 0 for n in used.values())


def test_run_gives_the_last_stage(spark):
    """And leaves no scratch table but its result; those of other work stay."""
    own = stored(spark.range(3), "test-own")
    begun = len(made())
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert len(made()) == begun + 1
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and out.count() > 0 and own.count() == 3


def test_stages_without_rows(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
    assert docs.count() == 0
