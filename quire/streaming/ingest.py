"""Streaming ingestion: files that arrive are parsed once into page texts; stateless, so exactly the batch result."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.operators.documents import page_texts
from quire.sources.files import stream_documents


def ingest_texts(spark: SparkSession, source: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    texts = page_texts(stream_documents(spark, source), "doc_id", "content")
    writer = texts.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
