"""Line deduplication: lines that many documents share stay in one document only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import aside, restored, ship, stored

#: What is stripped from both ends of a line: the bytes 0x20 and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
MIN_CODE_POINTS = 20
MIN_DOCUMENTS = 3


def line_key(line: str, min_code_points: int) -> bytes | None:
    """128-bit hash of the normalised line; None if it is too short to count."""
    line = line.strip(BLANKS)
    if len(line) < min_code_points:
        return None
    return xxhash.xxh3_128_digest(line.encode().lower())  # bytes.lower changes A-Z only


def _keys(min_code_points: int):
    def run(batches):
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                keys = {k for line in (text or "").split("\n") if (k := line_key(line, min_code_points))}
                rows += [i] * len(keys)
                found += keys
            halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())],
                ["doc", "h1", "h2"],
            )

    return run


def _reassemble(min_code_points: int):
    def run(texts: pa.Array, dropped: pa.Array) -> pa.Array:
        out, n_lines, n_dropped = [], [], []
        for text, gone in zip(texts.to_pylist(), dropped.to_pylist(), strict=True):
            lines = (text or "").split("\n")
            n_lines.append(len(lines))
            if gone:
                gone = {np.array([g["h1"], g["h2"]], "<i8").tobytes() for g in gone}
                lines = [line for line in lines if line_key(line, min_code_points) not in gone]
            n_dropped.append(n_lines[-1] - len(lines))
            out.append("\n".join(lines))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["text", "n_lines", "n_dropped"])

    return F.arrow_udf(run, "text string, n_lines long, n_dropped long")


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_code_points: int = MIN_CODE_POINTS,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """Drop lines found in ``min_documents`` documents or more, but keep them in the largest id.

    Whole texts are split at ``\\n``; a line's key is the line stripped of
    blanks with A-Z lower-cased.  Keys are hashed (128 bits), a document's
    repeated keys count once, and distinct documents are counted per key.
    Only keys of at least ``min_code_points`` code points count.  The kept
    lines are joined again in their order.

    Shuffled are 24 bytes a line and, once, the texts, by id.  A line that a
    third of the documents hold is counted by partial aggregates.  The keys to
    drop are a stored table: its file size tells the planner whether to
    broadcast it, and otherwise adaptive execution can split the join.

    Returns the columns of ``docs`` with the new text, and ``n_lines`` (before
    dropping) and ``n_dropped``.  Cases: a null text is one empty line and
    comes back empty; rows with the same id are one document for the count
    and each row is rewritten; a row with a null id counts for no document
    and keeps its lines; a text whose lines all go comes back empty; no rows
    give no rows; input columns named ``n_lines`` or ``n_dropped`` are
    replaced, and all other names, those used inside included, are the caller's.
    """
    ship(docs.sparkSession)
    docs, renamed = aside(docs, "_gone_doc", "_gone_keys", "_kept")
    id_col, text_col = renamed.get(id_col, id_col), renamed.get(text_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    pairs = wanted.mapInArrow(_keys(min_code_points), f"doc {kind}, h1 long, h2 long")
    counts = (
        pairs.groupBy("h1", "h2")
        .agg(F.countDistinct("doc").alias("n"), F.max("doc").alias("home"))
        .where(F.col("n") >= min_documents)
        .select("h1", "h2", "home")
    )
    shared = stored(counts, "shared-lines")
    gone = (
        pairs.join(shared, ["h1", "h2"])
        .where(F.col("doc") != F.col("home"))
        .groupBy("doc")
        .agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
        .select(F.col("doc").alias("_gone_doc"), F.col("gone").alias("_gone_keys"))
    )
    kept = docs.join(gone, F.col(id_col) == F.col("_gone_doc"), "left").withColumn("_kept", _reassemble(min_code_points)(F.col(text_col), F.col("_gone_keys")))
    columns = [F.col("_kept.text").alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return restored(kept.select(*columns, "_kept.n_lines", "_kept.n_dropped"), renamed)
