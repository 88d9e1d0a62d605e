"""Continuous indexing: a stream of texts, chunked and appended in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.windows import paragraph_chunks


def chunk_stream(stream: DataFrame, id_: str = "doc_id", text: str = "text", size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks of a streaming (or batch) DataFrame; stateless, so late rows need no watermark."""
    out = paragraph_chunks(stream.select(F.col(id_).cast("string").alias("source"), F.col(text).alias("text")), "text", size, overlap)
    return out.select(F.concat("source", F.lit("::chunk-"), "chunk_index").alias("chunk_id"), "source", "chunk_index", "content", "position_start", "position_end")


def start(stream: DataFrame, table: str, checkpoint: str, **kw) -> StreamingQuery:
    """Write chunks to ``table`` (a Parquet folder): each micro-batch exactly once, restartable from ``checkpoint``."""
    return chunk_stream(stream, **kw).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(table)
