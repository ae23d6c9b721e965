"""Packing of tokenised documents into fixed windows by best-fit decreasing."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import ship

WINDOW = 1024
SEPARATOR = 0
#: Pieces that wait to be packed together: at most this many times a window of ids in memory.
BLOCK_PIECES = 1 << 12
#: Rows of a batch that goes back to Spark.
ROWS_AT_ONCE = 1 << 10
#: Words whose ids a worker remembers.
MAX_WORDS = 800_000
#: Texts whose words are looked up together, and unknown words that go to the tokenizer in one call.
TEXTS_AT_ONCE = 512
WORDS_AT_ONCE = 200
ID_BYTES = 4

_BLANK = r"\t\n\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts with a space that doesn't stand alone between two words.
_ODD = f" [ {_BLANK}]|[{_BLANK}] | $"
#: How a byte-level vocabulary writes a space.
_SPACE = "\u0120"
_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    A byte-level tokenizer never joins a word to a following single space, so
    a text may be cut before each such space; the ids of the parts, joined,
    are the ids of the text.  Parts repeat, so their ids are remembered, and
    new ones go to the tokenizer together, each after its space: the ids that
    begin with a space are where one ends and the next one starts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.later: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(_SPACE)]] = True

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, new: list[str]) -> None:
        """Remember the ids of words that follow a space."""
        plain, odd = [], []
        for w in new:
            (odd if not w or w[0].isspace() or w[-1].isspace() or " " in w else plain).append(w)
        ids: list[int] = []
        for at in range(0, len(plain), WORDS_AT_ONCE):
            ids += self._ids(" " + " ".join(plain[at : at + WORDS_AT_ONCE]))
        coded = np.array(ids, "<u4")
        starts = np.flatnonzero(self.spaced[coded])
        if len(starts) == len(plain):
            raw = coded.tobytes()
            at = [*(starts * ID_BYTES).tolist(), len(raw)]
            self.later.update((w, raw[a:b]) for w, a, b in zip(plain, at, at[1:], strict=False))
        else:  # not expected of a byte-level tokenizer
            odd += plain
        for w in odd:
            self.later[w] = _packed(self._ids(" " + w))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of an Arrow array without nulls."""
        odd = np.flatnonzero(pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False))
        parts = pc.split_pattern(texts, " ")
        if len(odd):
            rows = parts.to_pylist()
            for i in odd.tolist():
                rows[i] = _BETWEEN_WORDS.split(texts[i].as_py())
            parts = pa.array(rows, parts.type)
        coded = parts.flatten().dictionary_encode()
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if len(self.later) > MAX_WORDS:
            self.later = {}
        known = list(map(self.later.get, words))
        if new := [i for i, ids in enumerate(known) if ids is None]:
            self._learn([words[i] for i in new])
            for i in new:
                known[i] = self.later[words[i]]
        flat = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // ID_BYTES
        starts = np.cumsum(sizes) - sizes
        firsts = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        count = sizes[codes]
        count[firsts] = 0  # a first word has no space before it
        ends = np.cumsum(count)
        ids = flat[np.arange(ends[-1]) + np.repeat(starts[codes] - (ends - count), count)].tobytes()
        cuts = [*(ID_BYTES * (ends - count)[firsts]).tolist(), len(ids)]
        return [_packed(self._ids(words[codes[f]])) + ids[a:b] for f, a, b in zip(firsts.tolist(), cuts, cuts[1:], strict=False)]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree over the capacities."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.live = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, name: int) -> None:
        self.at[capacity].append(name)
        self._count(capacity, 1)

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` that some open window has."""
        i = self.size + need
        if not self.live[i]:
            while not (i % 2 == 0 and self.live[i + 1]):
                i //= 2
                if i <= 1:
                    return None
            i += 1
            while i < self.size:
                i = 2 * i if self.live[2 * i] else 2 * i + 1
        return i - self.size

    def take(self, capacity: int) -> int:
        self._count(capacity, -1)
        return self.at[capacity].pop()

    def _count(self, capacity: int, by: int) -> None:
        i = self.size + capacity
        while i:
            self.live[i] += by
            i //= 2


def best_fit(lengths: list[int], window: int) -> list[list[int]]:
    """Windows of indexes of ``lengths`` (each at most a window), by best-fit decreasing."""
    windows: list[list[int]] = []
    free = OpenWindows(window)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = free.tightest(lengths[i])
        if room is None:
            room, name = window, len(windows)
            windows.append([])
        else:
            name = free.take(room)
        windows[name].append(i)
        if room > lengths[i]:
            free.add(room - lengths[i], name)
    return windows


def fill(lengths: list[int], windows: list[list[int]], window: int) -> list[list[tuple[int, int, int]]]:
    """Close the gaps that best fit leaves: the emptiest windows are cut up into the gaps of the others.

    Returns windows of cuts (index, start in the piece, length).  At most one
    window is left with a gap; it becomes windows of powers of two, which
    need no padding.
    """
    cuts = [[(i, 0, lengths[i]) for i in w] for w in windows]
    used = lambda w: sum(c[2] for c in w)
    whole = [w for w in cuts if used(w) == window]
    partly = sorted((w for w in cuts if used(w) < window), key=used)
    loose: list[tuple[int, int, int]] = []
    while partly:
        target = partly.pop()
        gap = window - used(target)
        while gap and (loose or partly):
            if not loose:
                loose = partly.pop(0)[::-1]
            i, start, length = loose.pop()
            take = min(gap, length)
            target.append((i, start, take))
            gap -= take
            if take < length:
                loose.append((i, start + take, length - take))
        whole.append(target)
    if loose:
        whole.append(loose[::-1])
    full = [w for w in whole if used(w) == window]
    for rest in (w for w in whole if used(w) < window):
        left = rest[::-1]
        while total := used(left):
            target, room = [], 1 << (total.bit_length() - 1)
            while room:
                i, start, length = left.pop()
                take = min(room, length)
                target.append((i, start, take))
                room -= take
                if take < length:
                    left.append((i, start + take, length - take))
            full.append(target)
    return full


def _pack(path: str, separator: int, window: int, id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    end = struct.pack("<I", separator)

    def run(batches):
        encode = encoder(path).encode
        sequence = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        waiting: list[tuple] = []

        def place(cuts):
            nonlocal sequence
            offset = 0
            for (doc, start, ids, total), at, length in cuts:
                rows.append((doc, start + at, length, ids[at * ID_BYTES : (at + length) * ID_BYTES], total, sequence, offset))
                offset += length
            sequence += 1

        def pack():
            lengths = [len(p[2]) // ID_BYTES for p in waiting]
            for cuts in fill(lengths, best_fit(lengths, window), window):
                place([(waiting[i], at, length) for i, at, length in cuts])
            waiting.clear()

        def flush():
            for at in range(0, len(rows), ROWS_AT_ONCE):
                part = rows[at : at + ROWS_AT_ONCE]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
            rows.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                texts = pc.fill_null(part.column(1), "")
                for doc, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                    ids += end
                    total = len(ids) // ID_BYTES
                    whole = total // window * window
                    for start in range(0, whole, window):
                        place([((doc, start, ids[start * ID_BYTES : (start + window) * ID_BYTES], total), 0, window)])
                    if whole < total:
                        waiting.append((doc, whole, ids[whole * ID_BYTES :], total))
                    if len(waiting) >= BLOCK_PIECES:
                        pack()
                    if len(rows) >= ROWS_AT_ONCE:
                        yield from flush()
        pack()
        yield from flush()

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    separator: int = SEPARATOR,
) -> DataFrame:
    """Tokenise documents and pack them into sequences of at most ``window`` ids.

    Each text's ids are followed by the separator.  Overlong documents are
    first cut into full windows; the tails are packed by best-fit decreasing,
    a segment tree over remaining capacities finding the tightest open window.
    What gaps remain are filled by cutting the emptiest windows up; the last
    rest becomes sequences whose lengths are powers of two.

    All of it happens where the text is read, in blocks of at most
    ``BLOCK_PIECES`` tails, so there is no shuffle, no key to be hot, and a
    bounded memory.  Sequence ids carry the partition's number and are unique.
    Call it on a stored table: a task that runs again then makes the same
    sequences.

    Returns a row per piece: the id column, ``start``, ``length``, ``ids``
    (little-endian unsigned 32-bit numbers), ``doc_tokens``, ``sequence_id``
    and ``offset``.  Cases: a null or empty text is the separator alone; rows
    with the same or a null id are packed as documents of their own; other
    columns are not returned; no rows give no rows.
    """
    ship(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _pack(tokenizer, separator, window, to_arrow_type(kind)),
        f"id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
    return made.withColumnRenamed("id", id_col)
