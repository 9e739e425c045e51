"""Queries of problem 8: template residue and error-page text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspar.llm.residue import residue_documents
from loomspar.session import table


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue_documents(table(spark, folder, "documents")).select("doc_id")


def p8_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Residue per source and label."""
    docs = table(spark, folder, "documents")
    return residue_documents(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "label").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES = {"p8_found": p8_found, "p8_by_source": p8_by_source}
SQL: dict[str, str] = {}
