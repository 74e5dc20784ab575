"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Only rows whose length occurs twice get a prefix hash; only rows whose length
and prefix occur twice have their content read in full. Every step is a
partial aggregation and a join on its small result, so one group may hold any
share of the rows: the aggregate combines it map-side and the join can be
split at run time.

Nulls count as empty texts; empty texts equal one another. Of equal texts the
row with the largest id stays. Rows with the same id and text count each (their
outcomes are equal); a null id never wins over another. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import broadcast_if_small, documents, stash

#: Bytes of a text that its prefix hash reads.
PREFIX_BYTES = 256


def _repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys of two rows or more, written once so that their number is known before a join chooses to broadcast them."""
    return broadcast_if_small(stash(df.groupBy(*keys).count().filter("count > 1").drop("count")), 16 * len(keys))


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_bytes: int = PREFIX_BYTES) -> DataFrame:
    """One row per group of two or more equal texts: (n_bytes, full, keep_id, group_size)."""
    content = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(content).alias("n_bytes"), content.alias("content"))
    by_length = rows.join(_repeated(rows, "n_bytes"), "n_bytes", "left_semi")
    prefixed = by_length.withColumn("prefix", F.xxhash64(F.substring("content", 1, prefix_bytes)))
    by_prefix = prefixed.join(_repeated(prefixed, "n_bytes", "prefix"), ["n_bytes", "prefix"], "left_semi")
    full = by_prefix.select("id", "n_bytes", F.sha2("content", 256).alias("full"))
    return full.groupBy("n_bytes", "full").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept and text_sha256."""
    content = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(content).alias("n_bytes"), F.sha2(content, 256).alias("text_sha256"))
    groups = copy_groups(docs, id_col, text_col).withColumnRenamed("full", "text_sha256")
    keep = F.coalesce("keep_id", "doc_id")
    return rows.join(groups, ["n_bytes", "text_sha256"], "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text: that of the largest id, null ids last.

    Rows are dropped by id and text, so another text under the same id stays. Of rows that share both, the one whose
    other columns come first stays; these columns have to be orderable where that happens.
    """
    content = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    outcome = exact_dedup(docs, id_col, text_col).filter("group_size > 1").select("doc_id", "keep_id", "kept", "text_sha256")
    outcome = stash(outcome)
    drop = broadcast_if_small(stash(outcome.filter("NOT kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).distinct()), 80)
    twice = broadcast_if_small(stash(outcome.filter("kept").groupBy(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).count().filter("count > 1").select("id", "sha")), 80)

    def those(df: DataFrame, listed: DataFrame, how: str) -> DataFrame:
        return df.join(listed, df[id_col].eqNullSafe(listed["id"]) & (F.sha2(F.coalesce(df[text_col], F.lit("")).cast("binary"), 256) == listed["sha"]), how)

    left = those(docs, drop, "left_anti")
    if twice.isEmpty():
        return left
    once = those(left, twice, "left_semi").groupBy(F.col(id_col), F.sha2(content, 256)).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return those(left, twice, "left_anti").union(once)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP7_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS txt FROM documents),
g AS (SELECT txt, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY txt)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.txt) AS text_sha256
FROM t JOIN g ON t.txt = g.txt
"""
