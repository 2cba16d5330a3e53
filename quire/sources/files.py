"""Reading and writing document files: a folder of files as rows, batch or streaming, and rows as a folder of files.

Large files: rows carry whole files, so Arrow batches are kept short; set `records` lower for files beyond tens of megabytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, modificationTime timestamp, length long, content binary"
RECORDS = 64


def read_documents(spark: SparkSession, path: str, glob: str = "*.pdf", records: int = RECORDS) -> DataFrame:
    """doc_id (the path), length, content. Only files that match are listed; columns that aren't used aren't read."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("doc_id"), "length", "content")


def stream_documents(spark: SparkSession, path: str, glob: str = "*.pdf", files_per_trigger: int = 1000) -> DataFrame:
    """The same as an unbounded table: new files become new rows; nothing downstream of it keeps state."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select(F.col("path").alias("doc_id"), "length", "content")


def author_table(docs: DataFrame, path: str, **how) -> None:
    """Authors a document from each text and stores the bytes as a table that read-side operators take."""
    from quire.operators.documents import authored

    authored(docs, **how).write.mode("errorifexists").parquet(path)
