"""SentencePiece encoding and decoding by tables of distinct chunks."""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import ship

#: The library's whitespace marker.
MARKER = "▁"
#: Characters of the texts whose ids are put together at once; a longer text is a block alone.
BLOCK_CHARS = 4 << 20
#: Distinct chunks that a task's table holds; beyond, it starts anew.
MAX_CHUNKS = 500_000
_CHUNKS = re.compile(r" ( *[^ ]+| *$)")


def cuts_at_markers(path: str) -> bool:
    """Can no piece of the model cross a marker that follows another character, so that words are segmented alone?

    Texts must reach the segmentation as they are, too: a marker ahead, a
    marker for each space, nothing normalised, no symbols that are matched first.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
    how, kind = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    plain = how.add_dummy_prefix and how.escape_whitespaces and not how.remove_extra_whitespaces and not how.precompiled_charsmap
    crossing = re.compile(f"[^{MARKER}]{MARKER}")
    return bool(
        plain
        and model.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
        and not model.trainer_spec.treat_whitespace_as_suffix
        and any(p.piece == MARKER for p in model.pieces)
        and not any(p.type == kind.USER_DEFINED or crossing.search(p.piece) for p in model.pieces)
    )


def chunks(text: str, cut: bool) -> list[str]:
    """The marked words of a text: each run of markers with the word behind it, less its first marker."""
    if not text:
        return []
    if not cut:
        return [text]
    text = text.replace(MARKER, " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return _CHUNKS.findall(" " + text)
    return text.split(" ")


class ChunkTable:
    """Distinct chunks with their ids and decoded texts, each segmented once, by code."""

    def __init__(self, path: str, cut: bool) -> None:
        import sentencepiece

        self.model, self.cut = sentencepiece.SentencePieceProcessor(model_file=path), cut
        self.lone = [self.model.piece_to_id(MARKER)]
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.ids, self.said = pa.array([], pa.list_(pa.int32())), pa.array([], pa.string())

    def code(self, words: list[str]) -> np.ndarray:
        """The code of each word; new words take the next ones and are segmented later."""
        codes = self.codes
        for w in words:
            if w not in codes:
                codes[w] = len(codes)
        return np.fromiter(map(codes.__getitem__, words), np.int32, len(words))

    def segment(self) -> None:
        """Let the library segment, and decode, the chunks that have only a code yet."""
        new = list(islice(self.codes, len(self.ids), None))
        if new:
            ids = [i if w or not self.cut else self.lone for w, i in zip(new, self.model.encode(new, num_threads=1), strict=True)]
            self.ids = pa.concat_arrays([self.ids, pa.array(ids, pa.list_(pa.int32()))])
            self.said = pa.concat_arrays([self.said, pa.array(self.model.decode(ids, num_threads=1), pa.string())])

    def joined(self, texts: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
        """Ids and decoded text of each text, from its chunks' codes by position."""
        self.segment()
        codes = pa.array(np.concatenate(texts))
        ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        words = self.ids.take(codes)
        tokens = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))])
        ids = pa.ListArray.from_arrays(pa.array(tokens[ends], pa.int32()), words.flatten())
        return ids, pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.said.take(codes)), " ")


def _encode(path: str, cut: bool, block_chars: int, max_chunks: int):
    def run(batches):
        table = ChunkTable(path, cut)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                first, size, texts = at, 0, []
                while at < batch.num_rows and (size < block_chars or at == first):
                    text = batch.column(1)[at].as_py() or ""
                    texts.append(table.code(chunks(text, cut)))
                    size, at = size + len(text), at + 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), *table.joined(texts)], ["id", "ids", "decoded"])
                if len(table.codes) > max_chunks:
                    table.clear()

    return run


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """Ids of each whole text, as the sentencepiece library gives them, and the text decoded from them.

    Where no piece can cross a whitespace marker, a text's ids are those of
    its marked words, joined.  A task makes a table of the distinct marked
    words of its texts, block by block; the library segments (and decodes)
    each distinct one once, and the texts take the ids at their words'
    positions by code.  A table for the whole corpus would have to shuffle
    nearly every word; the tables of tasks shuffle nothing.  With any other
    model a whole text is one chunk, so the result is the library's as well.

    A block is ``block_chars`` of text or one longer text, and a table is
    emptied after ``max_chunks``, whatever the corpus's size.
    ``path``: a model file, at the same place on every executor.

    Returns the id column, ``ids`` (array of int, without begin or end ids)
    and ``decoded``.  Cases: a null text is empty; an empty text has no ids
    and decodes to an empty text; the marker character itself is a space to
    the library, and decodes to one; rows with a null or repeated id are rows
    each; other columns are not returned and their names don't matter; a text
    of any length is encoded whole; no rows give no rows.
    """
    ship(docs.sparkSession)
    cut = cuts_at_markers(path)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(_encode(path, cut, block_chars, max_chunks), f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)
