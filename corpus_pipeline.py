"""From raw documents to token ids in five stages, each over all that the stage before it kept.

Quality classifier: documents that the ranking rejects go. Line dedup: lines of many sites go, documents stay. N-gram
Jaccard join: of each class of near copies the document with the smallest id stays (a repeated row once). Mixing: each
source's documents as often as its target says, drawn by quality scores. BPE: counts and digests of the ids and of the text
decoded from them.

Every stage but the last returns the columns of its input, whatever their names. Null and empty texts are scored, keep
their lines, are no copies of others and add no words to the mix; where an id is null or shared, texts tell rows apart.
Of a class of copies one row stays: the least id, then the least text, source and language. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import bpe, jaccard, lines, mixing, quality
from flowlens.llm._spark import cut


def free(name: str, docs: DataFrame) -> str:
    """A column name that docs don't have."""
    while name in docs.columns:
        name += "_"
    return name


def scored(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[DataFrame, str]:
    """docs with the score of a classifier learnt from all of documents that labels cover, and the name of that column."""
    learnt = quality.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free("score", docs)
    return quality.score(docs, learnt, into=name), name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged, score = scored(spark, docs, sf_dir)
    return judged.where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.remove_boilerplate(docs, into=free("n_removed", docs)).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The head of a class is the row whose text has the class's least id; rows without words have no class and stay."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged, score = scored(spark, docs, sf_dir)
    return mixing.mix(judged, weight=score).select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, bpe.read_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", clean_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", to_tokens),
]

#: SQL can't express a ranking learnt from labels, nor byte pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
