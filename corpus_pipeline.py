"""A training corpus from raw documents, stage by stage.

Each stage takes all that its predecessor kept; all but the last return the
columns of ``documents``.  ``run`` writes each stage's rows to the folder that
all executors share and reads them again, so a lost executor costs no more
than the stage at hand.  Each stage's docstring names its operator, whose own
docstring defines the result for nulls, ties, repeated rows, empty tables and
columns with clashing names; other columns than those of ``documents`` are
dropped by the stages that rebuild a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.line_dedup import line_dedup
from sluice.llm.mixing import mix
from sluice.llm.packing import pack
from sluice.llm.quality import fit_quality, score_quality
from sluice.llm.queries import tokenizer_path
from sluice.llm.shared import made, others, stored, sweep
from sluice.llm.simhash import simhash_near_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of documents, with the number of code points that a text now has."""
    return rows.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects (``score_quality``: a null text scores like an empty one, repeated rows alike; no rows, no rows)."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).where("predicted = 1").select(*others(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that many documents share, but from one of them (``line_dedup``: a null text comes back empty; a row with a null id keeps its lines)."""
    return _documents(line_dedup(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (``simhash_near_dedup``: the smallest id; rows with a null id all stay)."""
    return simhash_near_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that all sources weigh alike, in a global random order (``mix``: a null source is a source, null and repeated ids draw by their other columns)."""
    return mix(docs).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences (``pack``: a null text is empty, repeated rows are packed each)."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", packing),
]

#: A fitted classifier, XXH64 fingerprints and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, begun = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(made())
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        sweep(spark, begun)  # the stage's result is stored: its input and its scratch tables go
    return docs
