"""A training-data pipeline over ``documents``: five stages, each on what the one before kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which the runner
writes as Parquet and rereads as the next stage's ``docs``.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import dedup, jaccard, langid, packing, secrets
from kgloom.llm.common import saved

#: Documents of whose n-grams a smaller share belongs to the language that was found are rejected.
LEAST_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay: not ``und``, and a score of ``LEAST_SCORE``."""
    found = langid.judgement(spark, langid.train(docs), "text")
    return docs.filter((found["lang_pred"] != "und") & (found["score"] >= LEAST_SCORE))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z the row with the largest id stays."""
    return dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more the one with the least id stays.

    Rows are decided by id and text, as ids may repeat or be null; of rows equal in both one stays.
    """
    return jaccard.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark."""
    return secrets.redacted(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, 1024, 2)


STAGES = [("language ID", language), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("secret scans", secret_scan), ("best-fit packing", pack)]

#: SQL cannot express the model of the first stage nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = saved(docs, f"stage{number}")
    return docs
