"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import aside, others, restored, ship

FEATURES = (
    "log_bytes", "log_words", "mean_word", "longest_word", "distinct_words", "top_word", "adjacent_repeats", "distinct_triples",
    "upper", "digits", "blanks", "other_ascii", "beyond_ascii", "sentence_marks", "exclamations", "symbols", "bars", "braces",
    "words_ending_in_symbols", "upper_words", "mean_line", "distinct_lines", "short_lines", "byte_entropy",
)
#: Labelled rows that the model is fitted on, about this many at most.
MAX_FIT_ROWS = 20_000
THRESHOLD = 0.3
HELD_OUT_PARTS = 5
WORDS_AT_ONCE = 1 << 18


def _mask(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8))


_UPPER, _DIGITS, _BLANKS = _mask(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask(b"0123456789"), _mask(b" \t\n\r\x0b\x0c")
_LETTERS = _UPPER | _mask(b"abcdefghijklmnopqrstuvwxyz")
_BEYOND = np.arange(256) >= 128
_OTHER = ~(_LETTERS | _DIGITS | _BLANKS | _BEYOND)
_SENTENCE, _SYMBOLS, _BARS, _BRACES = _mask(b".,;:?"), _mask(b"#$%&*@^~_=+<>\\/"), _mask(b"|"), _mask(b"{}[]()")
_CLASSES = np.stack([_UPPER, _DIGITS, _BLANKS, _OTHER, _BEYOND, _SENTENCE, _mask(b"!"), _SYMBOLS, _BARS, _BRACES]).astype(float)
_ENDINGS = tuple(bytes([c]) for c in b"#$%&*@^~!|")


def statistics(text: str | None) -> list[float]:
    """The features of one whole text, in the order of ``FEATURES``."""
    raw = (text or "").encode()
    size = len(raw)
    if not size:
        return [0.0] * len(FEATURES)
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = _CLASSES @ bytes_ / size
    words = raw.split()
    n = len(words)
    count = Counter(words)
    triples, same = set(), 0
    for at in range(0, n, WORDS_AT_ONCE):  # slices overlap, and only hashes are kept, so that a very long text needs little memory
        part = words[at : at + WORDS_AT_ONCE + 2]
        triples.update(map(hash, zip(part, part[1:], part[2:], strict=False)))
        same += sum(map(eq, part[:WORDS_AT_ONCE], part[1:]))
    lines = [line for line in raw.split(b"\n") if line]
    p = bytes_[bytes_ > 0] / size
    per_word = max(1, n)
    return [
        float(np.log1p(size)),
        float(np.log1p(n)),
        sum(map(len, words)) / per_word,
        float(np.log1p(max(map(len, words), default=0))),
        len(count) / per_word,
        max(count.values(), default=0) / per_word,
        same / per_word,
        len(triples) / max(1, n - 2),
        *share[:10].tolist(),
        sum(k for w, k in count.items() if w.endswith(_ENDINGS)) / per_word,
        sum(k for w, k in count.items() if len(w) > 1 and w.isupper()) / per_word,
        float(np.log1p(size / max(1, len(lines)))),
        len(set(lines)) / max(1, len(lines)),
        sum(len(line) < 30 for line in lines) / max(1, len(lines)),
        float(-(p * np.log2(p)).sum()),
    ]


@dataclass
class Boosted:
    """Complete trees of one depth, flattened: node i has the children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    bias: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row; a row walks all trees at once."""
        out = np.full(len(x), self.bias)
        trees, inner = self.feature.shape
        if trees:
            every, node = np.arange(trees)[None], np.zeros((len(x), trees), np.int64)
            row = np.arange(len(x))[:, None]
            while inner and (node < inner).all():
                node = 2 * node + 1 + (x[row, self.feature[every, node]] > self.threshold[every, node])
            out += self.leaf[every, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 200, depth: int = 4, rate: float = 0.1, bins: int = 64, min_hessian: float = 0.2, l2: float = 1.0) -> Boosted:
    """Fit boosted trees for the logistic loss on histograms of quantile bins.

    No rows, or rows of one label, give a model without trees whose score is
    the smoothed share of label 1.
    """
    n, width = x.shape
    bias = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    inner = 2**depth - 1
    empty = Boosted(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), bias)
    if n == 0 or y.min() == y.max():
        return empty
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    flat = binned + np.arange(width) * bins
    usable = np.array([[b < len(c) for b in range(bins)] for c in cuts])
    raw, found = np.full(n, bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * bins) + flat).ravel()
            shape = (wide, width, bins)
            g, h = (np.bincount(at, np.repeat(v, width), wide * width * bins).reshape(shape).cumsum(2) for v in (grad, hess))
            total_g, total_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (total_g - g) ** 2 / (total_h - h + l2) - total_g**2 / (total_h + l2)
            gain[~(usable[None] & (h >= min_hessian) & (total_h - h >= min_hessian))] = 0
            best = gain.reshape(wide, -1).argmax(1)
            good = gain.reshape(wide, -1)[np.arange(wide), best] > 1e-9
            for k in np.flatnonzero(good):
                feature[first + k], threshold[first + k] = best[k] // bins, cuts[best[k] // bins][best[k] % bins]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        g, h = (np.bincount(node - inner, v, inner + 1) for v in (grad, hess))
        leaf = -rate * g / (h + l2)
        raw += leaf[node - inner]
        found.append((feature, threshold, leaf))
    return Boosted(*(np.stack(part) for part in zip(*found, strict=True)), bias)


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for t in texts.to_pylist()], float).reshape(-1, len(FEATURES))


def statistics_column(text: Column) -> Column:
    return F.arrow_udf(lambda t: pa.array(_matrix(t).tolist(), pa.list_(pa.float64())), "array<double>")(text)


def score_column(model: Boosted, text: Column) -> Column:
    return F.arrow_udf(lambda t: pa.array(model.predict(_matrix(t))), "double")(text)


def held_out(id_col: str) -> Column:
    """Rows that the model never learns from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_PARTS == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_FIT_ROWS) -> Boosted:
    """Fit the classifier on labelled documents that are not held out.

    About ``max_rows`` labelled rows at most are taken, those whose hashed id
    lies in the lowest part that holds so many; their statistics, and nothing
    else, go to the driver.  The same hash filter thins the documents before
    the join, so no more texts than that are shuffled.  An id counts once:
    of several texts the least, of several labels the lower.
    """
    ship(docs.sparkSession)
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"))
    share = min(1.0, max_rows / max(1, usable.count()))
    low = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 30)) < int(share * (1 << 30))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    rows = texts.where(low(F.col("id"))).groupBy("id").agg(F.min("text").alias("text")).join(usable.where(low(F.col("id"))), "id").select("id", "y", statistics_column(F.col("text")).alias("x")).toPandas()
    rows = rows.iloc[np.lexsort((rows["y"], rows["id"]))]
    return fit(np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES)), rows["y"].to_numpy(float))


def score_quality(docs: DataFrame, model: Boosted, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` (0 to 1, higher: better) and ``predicted`` (1 if the score reaches the threshold).

    Only the text is an input of the score.  A map over rows with the trees,
    a few kilobytes, in its closure.  Cases: a null text scores like an empty
    one; repeated rows score alike; input columns named ``score`` or
    ``predicted`` are replaced, and no other name matters; no rows give no rows; without usable labels
    every row gets the model's constant score.
    """
    ship(docs.sparkSession)
    docs, renamed = aside(docs, "_score")
    scored = docs.withColumn("_score", score_column(model, F.col(renamed.get(text_col, text_col))))
    out = scored.select(*others(docs, "score", "predicted"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
    return restored(out, renamed)
