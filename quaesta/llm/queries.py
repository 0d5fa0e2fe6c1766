"""The registered queries of the training-data operators: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25_pack, chat_format, cover_tree, decontam, feistel_order, langid, license_digest, near_dup, url_alias, warc_zstd
from .common import table

ORDER_KEY = 20240229


def op1_url_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_alias.url_verdicts(table(spark, sf_dir, "pages"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    out = chat_format.format_conversations(turns.unionByName(extra)).withColumn("read", chat_format.parse_turns(F.col("formatted")))
    loss = chat_format.loss_text(F.col("segments"))
    hashed = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(hashed, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.archive_round_trip(table(spark, sf_dir, "pages"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=2)


def op6_bm25_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = bm25_pack.pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.train(table(spark, sf_dir, "documents"), "text", "lang")
    out = langid.page_languages(table(spark, sf_dir, "pages"), model)
    return out.withColumn("posterior", F.round("posterior", 6))


def op8_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest.scan_licenses(table(spark, sf_dir, "documents"))


def op9_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op10_feistel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_order.materialised_order(table(spark, sf_dir, "documents"), ORDER_KEY)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_url_alias, op2_minhash, op3_chat_format, op4_warc_zstd, op5_decontam, op6_bm25_pack, op7_langid, op8_license_digest, op9_cover_tree, op10_feistel_order]
    return {f.__name__: f for f in found}
