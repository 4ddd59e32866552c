"""A corpus from raw documents: toxicity, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents.

Defined cases: an empty table stays empty; a null text counts as empty, and is kept as one document of all that are empty or
null; repeated rows and copies under several ids are one class of near-duplicates, of which one stays; null ids are kept;
further columns of the first table are dropped, whatever their names; without a label that fits a document nothing is
toxic; without benchmark items nothing leaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.llm import bpe, decontaminate, near_dup, suffix_dedup, toxicity
from roadspark.llm._spark import stored
from roadspark.llm.queries import VOCABULARY

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Stages that end in operators SQL can't express; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; the model learns from all labels."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model, COLUMNS).filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dup.one_of_each(docs).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings that also stand elsewhere."""
    kept = suffix_dedup.remove_repeats(docs, columns=("doc_id", "lang", "source"), form="text")
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded text."""
    return bpe.encode_documents(docs, VOCABULARY)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("suffix_dedup", drop_repeats), ("decontamination", drop_leaks), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
