"""Queries that apply each operator of this subpackage to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.ann import nearest
from sluice.llm.chat import format_chats, read_loss, read_turns
from sluice.llm.embed_dedup import embedding_groups
from sluice.llm.line_dedup import line_dedup
from sluice.llm.merkle import FIELDS, fold, leaf_digest, merkle_manifest, proof_text
from sluice.llm.mixing import mix
from sluice.llm.packing import pack
from sluice.llm.pieces import encode_pieces
from sluice.llm.pii import BASE_KINDS, find_pii, joined, of_kind
from sluice.llm.quality import fit_quality, held_out, score_quality
from sluice.llm.simhash import simhash_groups
from sluice.llm.vector_codes import codebook_text, vector_codes
from sluice.llm.warc import archive_pages


def tokenizer_path() -> str:
    """Where this installation keeps the byte-level vocabulary; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model_path() -> str:
    """Where this installation keeps the SentencePiece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(_table(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    index = archive_pages(pages, captured=F.timestamp_seconds(F.lit(1577836800) + F.coalesce("page_id", F.lit(0))))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[F.size(of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(of_kind(spans, *BASE_KINDS)), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_quality(docs, _table(spark, sf_dir, "labels"))
    return score_quality(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    windows = format_chats(table.unionByName(added))
    turns = read_turns(F.col("text"))
    new = F.slice(turns, F.col("n_repeated").cast("int") + 1, F.size(turns))
    back = windows.select(
        "conv_id",
        "first_turn",
        F.length("text").cast("long").alias("chars"),
        F.size(new).cast("long").alias("n"),
        F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join(read_loss(F.col("text"), F.col("loss")), "").alias("learnt"),
    )
    whole = back.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("first_turn", "said", "learnt"))).alias("w"))
    said, learnt = (F.array_join(f"w.{f}", "") for f in ("said", "learnt"))
    return whole.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = leaf_digest([lowered if f == "text" else F.col(f) for f in FIELDS])
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    made = merkle_manifest(docs, carried=F.when(chosen, F.unhex(tampered)))
    folded = made.withColumn("folded_root", fold(F.coalesce(F.lower(F.hex("carried")), F.col("leaf")), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vector_codes(_table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(codebook_text(codebooks).encode()).hexdigest()
    return coded.withColumn("codebooks_sha256", F.lit(digest))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode_pieces(_table(spark, sf_dir, "documents"), piece_model_path())
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_line_dedup,
        op3_mixing,
        op4_ann,
        op5_simhash_near_dedup,
        op6_packing,
        op7_warc,
        op8_pii,
        op9_quality,
        op10_chat,
        op11_merkle_manifest,
        op12_vector_codes,
        op13_sentencepiece,
    )
}
