"""Corpus preparation: language ID, near-dedup, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaesta.llm import bm25_pack, decontam, langid, near_dup
from quaesta.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows whose text is most probably in one of the languages, by text and source. The labels train the model and are no evidence.

    Rows of a null, empty or letterless text go, as do texts like no language; null ids and sources, repeated and very long rows are judged as any.
    """
    model = langid.train(docs, "text", "lang")
    out = langid.identify(docs, model, F.col("text"), host=F.col("source"))
    return out.where("accepted").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group; rows without an id stay; of rows that repeat an id and a text one stays."""
    found = near_dup.near_duplicates(docs)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    # one row of each id that occurs more than once, without moving the texts of the others
    twice = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti")
    once = left.join(twice, "doc_id", "left_anti")
    return once.unionByName(left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; an id goes with all its rows."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated")
    nameless = docs.where("doc_id is null")
    if nameless.limit(1).count():
        # rows without an id are told apart by their own content
        named = nameless.withColumn("doc_id", F.xxhash64("text"))
        hit = decontam.decontaminate(named, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("h")).distinct()
        nameless = nameless.withColumn("h", F.xxhash64("text")).join(hit, "h", "left_anti").select(*docs.columns)
        return docs.where("doc_id is not null").join(bad.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns).unionByName(nameless)
    return docs.join(bad.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, by id. A null or empty text is its end id; rows of null or repeated ids are packed each on their own."""
    pieces = bm25_pack.pack_documents(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Similarity, classification and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
