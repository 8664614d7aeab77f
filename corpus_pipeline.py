"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, exact_dedup, mixing, ngram_join, quality
from tessera.llm.common import crc_mod, shared_dir

#: Columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; it learns as in its query."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(docs.filter(crc_mod("doc_id", 4) != 2), labels)
    return quality.classify(docs, model).filter("predicted = 1").select(*COLUMNS)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_duplicates(docs).select(*COLUMNS)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that links of similarity chain together."""
    named = ngram_join.ngram_components(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = named.select(F.col("doc_id").alias("stay")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["stay"]), "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.apply_mix(docs, mixing.mix_sources(docs)).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", keep_one_copy),
    ("n-gram Jaccard join", keep_one_near_copy),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", tokenize),
]

#: SQL can express neither the classifier nor the sampling keys nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/tessera/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
