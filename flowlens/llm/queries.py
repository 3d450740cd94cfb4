"""The operators over whole tables, with production parameters: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import bpe, clusters, conversations, jaccard, lines, merkle, mixing, perplexity, quality, setsketch, sharding, substrings, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", quality.in_fold("doc_id", 4, 2).alias("held_out"))
    scored = quality.classify(docs, table(spark, sf_dir, "labels"), parts=4, held=2)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), threshold=0.8, shingle=5)


def op3_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), parts=5, held=0)
    return tagged.select("doc_id", quality.in_fold("doc_id", 5, 0).alias("held_out"), "score", "predicted", "toxic_tokens", F.to_json("spans").alias("spans"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return cleaned.select("doc_id", "n_removed", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_edit(table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), size=35)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # where it is missing, this query fails and the others don't

    vocabulary = bpe.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary)


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clustered(table(spark, sf_dir, "embeddings"), k=40, rounds=5, size=64)


def op12_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.components(table(spark, sf_dir, "documents"), threshold=0.8, shingle=2)


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_quality": op1_quality, "op2_jaccard": op2_jaccard, "op3_perplexity": op3_perplexity, "op4_sharding": op4_sharding, "op5_toxicity": op5_toxicity, "op6_lines": op6_lines,
    "op7_merkle": op7_merkle, "op8_substrings": op8_substrings, "op9_mixing": op9_mixing, "op10_bpe": op10_bpe, "op11_clusters": op11_clusters, "op12_setsketch": op12_setsketch, "op13_conversations": op13_conversations,
}
ORACLE_SQL: dict[str, str] = {
    "op6_lines": lines.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL, "op11_clusters": clusters.oracle_sql(), "op12_setsketch": setsketch.ORACLE_SQL, "op13_conversations": conversations.ORACLE_SQL,
}
