"""Streaming ingestion (an extension): new Markdown files are chunked and upserted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk_documents
from ..operators.embed import Embedder
from ..operators.ingest import index_chunks
from ..sources.index import ChunkIndex
from ..sources.markdown import parse_documents


def stream_ingest(spark: SparkSession, source_dir: str, index: ChunkIndex, embedder: Embedder, checkpoint: str, available_now: bool = False):
    """A started query. Point ids are deterministic, so a repeated micro-batch changes nothing."""
    index.ensure()

    def upsert(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            index_chunks(chunk_documents(parse_documents(batch)), index, embedder)

    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(source_dir)
    writer = files.select(F.col("_metadata.file_path").alias("source_path"), "value").writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
