"""The corpus pipeline: language, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that the next one
reads; all but the last return the columns of ``documents``. A filtering stage
decides on all rows its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm import exact_dedup, language, ngram_join, packing, privacy
from symloom.llm.shared import discard, documents, scratch_root

#: SQL cannot express language models, signature trees and tokenizers.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those that language identification rejects go."""
    return language.in_a_language(docs, language.fit(docs))


def one_exact_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.kept_documents(docs)


def one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (five-word shingles, similarity 0.8 or more) the one with the smallest id."""
    return ngram_join.one_of_each(docs, num=8, den=10, width=5)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and disclosing terms replaced; n_chars follows the new text."""
    found = privacy.personal_data(docs, carry=True)
    text = privacy.sanitised(found)
    columns = [F.when(F.size("email") + F.size("ip") + F.size("card") + F.size("phone") + F.size("term") > 0, text).otherwise(F.col("original")).alias("text") if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns]
    out = found.select(*columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", known_language),
    ("exact_dedup", one_exact_copy),
    ("ngram_join", one_near_copy),
    ("pii", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what a stage has read goes."""
    docs, before = documents(spark, sf_dir), None
    for _, stage in STAGES:
        path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
