"""The queries of the operators, with production parameters over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import chat, chosen_path, decontamination, line_dedup, lm, mixing, pii, token_counts, topk, toxicity
from quire.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.encoded_lengths(table(spark, sf_dir, "documents")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def mixing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the splitting tree of op4 deals to each output shard."""
    return mixing.shards(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT -7L AS conv_id, stack(2, 0L, 'user', 1L, 'assistant') AS (turn, role)").selectExpr("conv_id", "turn", "role", f"'{said}' AS text")
    own = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id AS long) conv_id", "cast(turn AS long) turn", "role", "text")
    return chat.read_back(chat.formatted(own.unionByName(extra)))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest_of_every(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    out = toxicity.scored(docs, model)
    return out.withColumn("toxic", out.p_above_least >= toxicity.THRESHOLD)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.similar_groups(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removed_lines(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_pii, op2_token_counts, op3_decontamination, op4_mixing, mixing_shards, op5_chat, op6_topk, op7_toxicity, op8_lm_scoring, op9_ngram_jaccard, op10_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.SQL, "op6_topk": topk.SQL}
