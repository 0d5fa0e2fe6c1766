"""Ingestion: documents to chunks to lines and index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHUNK_MAX_CHARACTERS, CHUNK_OVERLAP_CHARACTERS
from ..sources.index import ChunkIndex
from ..sources.markdown import read_documents
from ..sources.sinks import write_chunks
from .chunking import chunk_documents
from .embed import Embedder


def index_chunks(chunks: DataFrame, index: ChunkIndex, embedder: Embedder, recreate: bool = False, replace_documents: bool = False) -> None:
    index.recreate() if recreate else index.ensure()
    index.upsert(chunks.withColumn("embedding", embedder.passages(F.col("text"))), replace_documents)


def ingest(
    spark: SparkSession, source_dir: str, output_path: str, index: ChunkIndex, embedder: Embedder, recreate: bool = False,
    most: int = CHUNK_MAX_CHARACTERS, overlap: int = CHUNK_OVERLAP_CHARACTERS, active_only: bool = False, replace_documents: bool = False,
) -> DataFrame:
    """Chunk lines are written before anything is embedded; returns the chunks. Any bad document fails the run.

    ``active_only`` and ``replace_documents`` are off by default: drafts are indexed, and stale chunks of edited documents stay.
    """
    docs = read_documents(spark, source_dir)
    if active_only:
        docs = docs.where("status = 'active'")
    chunks = chunk_documents(docs, most, overlap)
    write_chunks(chunks, output_path)
    chunks = spark.read.schema(chunks.schema).json(output_path)
    index_chunks(chunks, index, embedder, recreate, replace_documents)
    return chunks
