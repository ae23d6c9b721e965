"""SentencePiece ids and decoded texts against the library on whole texts."""

import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

import sluice.llm.pieces as pieces
from sluice.llm.pieces import chunks, cuts_at_markers, encode_pieces
from sluice.llm.queries import QUERIES, piece_model_path
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model_path())


def texts(n, seed=1):
    rnd = random.Random(seed)
    parts = ["a", "The", "ing", "é", "é", "ﬁ", "中文", "😀", "\n", "\t", "\r", "\x00", "\xa0", "　", "​", "▁", " ", "  ", "     ", "<s>", "</s>", "<0x41>", "�", "9", "...", " ", "﻿"]
    return ["".join(rnd.choices(parts, k=rnd.randint(0, 25))) for _ in range(n)]


def test_chunks_put_together_are_the_marked_text():
    assert cuts_at_markers(piece_model_path())
    for text in texts(3000):
        marked = "".join("▁" + c.replace(" ", "▁") for c in chunks(text, True))
        assert marked == ("▁" + text.replace(" ", "▁") if text else "")
    assert chunks("a  b ", True) == ["a", " b", ""] and chunks("a  b ", False) == ["a  b "]


@pytest.mark.parametrize("cut", [True, False])
def test_ids_and_texts_are_the_librarys(spark, model, monkeypatch, cut):
    monkeypatch.setattr(pieces, "cuts_at_markers", lambda path: cut)
    rows = list(enumerate(texts(2000))) + [(9000, None), (9001, ""), (9002, " "), (9003, "word " * 200_000), (9004, "x" * 50_000), (None, "no id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.withColumns({c: F.lit("x") for c in ("block", "id", "codes", "code", "chunk", "ids", "said", "decoded", "of")})
    found = encode_pieces(df, piece_model_path())
    assert found.columns == ["doc_id", "ids", "decoded"]
    expected = [(i, ids := model.encode(t or ""), model.decode(ids)) for i, t in rows]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))


def test_many_blocks(spark, model):
    """Blocks share their task's table, which starts anew when it is full."""
    rows = [(i, t) for i, t in enumerate(texts(500, 2))]
    found = encode_pieces(spark.createDataFrame(rows, "doc_id int, text string").repartition(2), piece_model_path(), block_chars=200, max_chunks=50)
    assert sorted((r["doc_id"], r["ids"], r["decoded"]) for r in found.collect()) == [(i, ids := model.encode(t), model.decode(ids)) for i, t in rows]


def test_a_chunk_is_segmented_once(model):
    table = pieces.ChunkTable(piece_model_path(), True)
    seen = []
    encode = table.model.encode
    table.model = type("Model", (), {"encode": lambda self, words, **kw: (seen.extend(words), encode(words, **kw))[1], "decode": lambda self, ids, **kw: model.decode(ids, **kw)})()
    for _ in range(3):
        ids, said = table.joined([table.code(chunks(t, True)) for t in ("the cat the", "", "cat  cat the the")])
    assert sorted(seen) == [" cat", "cat", "the"]
    assert ids.to_pylist() == [model.encode(t) for t in ("the cat the", "", "cat  cat the the")] and said.to_pylist() == ["the cat the", "", "cat  cat the the"]


def test_no_rows(spark):
    assert encode_pieces(spark.createDataFrame([], "doc_id string, text string"), piece_model_path()).collect() == []


def test_query(spark, model):
    expected = []
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        ids = model.encode(r["text"] or "")
        expected.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    found = QUERIES["op13_sentencepiece"](spark, SF_SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, found)) == sorted(expected)
