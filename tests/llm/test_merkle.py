"""Merkle manifests against plain hashing."""

import binascii
import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from sluice.llm.merkle import fold, leaf_digest, merkle_manifest, proof_text
from sluice.llm.queries import QUERIES
from tests.conftest import SF_SMALL

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def said(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes, arity):
    """Root, and what stands beside each leaf's path, level by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            first = i - i % arity
            proofs[leaf].append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + arity])))
        nodes, at = [h(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)], [i // arity for i in at]
    return nodes[0], proofs


def brute(rows, arity):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"], h(*[said(r[f]) for f in FIELDS])))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: tree([leaf for *_, leaf in sorted(groups[g], key=lambda x: (x[0], x[1] or 0, x[2]))], arity) for g in order}
    root, above = tree([made[g][0] for g in order], arity)
    out = []
    for g, rest in zip(order, above, strict=True):
        for (_, i, leaf), proof in zip(sorted(groups[g], key=lambda x: (x[0], x[1] or 0, x[2])), made[g][1], strict=True):
            out.append((i, g, leaf, made[g][0], root, tuple(proof + rest)))
    return sorted(out, key=str)


def rows_of(n, langs, seed=1):
    rnd = random.Random(seed)
    return [dict(doc_id=i, text=rnd.choice(["", "A b", "é\n", "x" * 999, None]), lang=rnd.choice(langs), source=rnd.choice(["s", None]), n_chars=rnd.choice([3, None])) for i in range(n)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("arity", [2, 3, 8])
@pytest.mark.parametrize("langs", [["en"], [None, "de", "en", "é", "Z", "zh", "aa", "ab", "ac", "ad"]])
def test_against_plain_hashing(spark, arity, langs):
    rows = rows_of(77, langs) + [dict(doc_id=None, text="n", lang=langs[0], source="s", n_chars=1)] * 2 + rows_of(5, langs)
    rows += [dict(doc_id=1000, text="same", lang=langs[0], source="s", n_chars=4)] * 30  # equal rows are leaves each
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA).repartition(3)
    made = merkle_manifest(df, arity=arity).collect()
    found = sorted(((r["doc_id"], r["group"], r["leaf"], r["subroot"], r["root"], tuple((p["before"], p["after"]) for p in r["proof"])) for r in made), key=str)
    assert found == brute(rows, arity)


def test_lone_leaves_and_folding(spark):
    rows = rows_of(1, ["en"]) + [dict(doc_id=5, text="Ab", lang="de", source=None, n_chars=2)]
    df = spark.createDataFrame([tuple(r.values()) for r in [dict(doc_id=r["doc_id"], text=r["text"], lang=r["lang"], source=r["source"], n_chars=r["n_chars"]) for r in rows]], SCHEMA)
    changed = leaf_digest([F.lower(f) if f == "text" else F.col(f) for f in FIELDS])
    made = merkle_manifest(df, carried=changed).withColumn("same", fold(F.col("leaf"), F.col("proof")) == F.col("root")).withColumn("other", fold(F.col("carried"), F.col("proof")) == F.col("root"))
    by_id = {r["doc_id"]: r for r in made.collect()}
    assert by_id[5]["same"] and not by_id[5]["other"] and by_id[5]["subroot"] == by_id[5]["leaf"]
    assert by_id[0]["root"] == h(by_id[5]["leaf"], by_id[0]["leaf"])
    one = merkle_manifest(df.where("doc_id = 5")).collect()[0]
    assert one["root"] == one["subroot"] == one["leaf"] and one["proof"] == []


def test_other_columns_and_no_rows(spark):
    taken = ["i", "n", "grp", "g", "digest", "row", "at", "part", "carried", "leaf", "root", "path", "siblings", "id", "group", "run"]
    df = spark.createDataFrame([tuple(r.values()) for r in rows_of(20, ["a", "b"])], "doc_id long, text string, lang string, source string, n_chars long")
    plain = sorted(map(str, merkle_manifest(df).collect()))
    assert sorted(map(str, merkle_manifest(df.withColumns({c: F.lit(-1) for c in taken})).collect())) == plain
    empty = merkle_manifest(df.where("false"))
    assert empty.collect() == [] and empty.columns == merkle_manifest(df).columns


def test_query(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = {r["doc_id"]: h(*[said(r[f].translate(lower) if f == "text" and r[f] else r[f]) for f in FIELDS]) for r in rows if binascii.crc32(str(r["doc_id"]).encode()) % 3 == 0}
    expected = []
    for i, _, leaf, subroot, root, proof in brute(rows, 8):
        node = tampered.get(i, leaf)
        for before, after in proof:
            node = h(before, node, after)
        expected.append((i, leaf, subroot, root, h("".join(b + a for b, a in proof)), node, node == root))
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = QUERIES["op11_merkle_manifest"](spark, SF_SMALL).select(*columns).collect()
    assert sorted(map(tuple, found)) == sorted(expected)
    assert proof_text(F.col("proof")) is not None
