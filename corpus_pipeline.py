"""The corpus pipeline: toxic documents go, repeated lines go, one of each group of near copies stays,
contaminated documents go, and what is left is mixed to target weights.

Each stage gets all rows its predecessor kept, as Parquet, and returns the columns of documents; the last adds its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import chosen_path, decontamination, line_dedup, mixing, toxicity
from quire.llm.common import table, written


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7, fitted on the labelled rows of the stage's own input."""
    return toxicity.without_toxic(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def repeated_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10; a document whose lines all go stays, with an empty text."""
    return line_dedup.without_repeated_lines(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9."""
    return chosen_path.one_of_each(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4; a row for each draw, with its shard, round, words and place in the shard's shuffle."""
    return mixing.mixture(docs)


STAGES = [("toxicity", toxic_out), ("line_dedup", repeated_lines_out), ("near_copies", one_of_near_copies), ("decontamination", benchmark_out), ("mixing", mixed)]

#: The trained stage and the sampled paths can't be put into SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs)
    return docs
