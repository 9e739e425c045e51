"""Queries of problem 7: evaluation texts leaking into training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspar.llm.leaks import leaked_items
from loomspar.session import table


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_by_item(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents leak each item."""
    return p7_found(spark, folder).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))


QUERIES = {"p7_found": p7_found, "p7_by_item": p7_by_item}
SQL: dict[str, str] = {}
