"""Queries of problem 6: encoding of the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspar.llm.tokens import encode_texts
from loomspar.session import table


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"), "doc_id", "text")


def p6_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and tokens per source: the budget of a training run."""
    ids = encode_texts(table(spark, folder, "documents").withColumn("k", F.struct("source")), "k", "text")
    return ids.groupBy(F.col("k.source").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("ids")).alias("n_tokens"), F.max(F.size("ids")).alias("max_tokens"))


QUERIES = {"p6_ids": p6_ids, "p6_lengths": p6_lengths}
SQL: dict[str, str] = {}
