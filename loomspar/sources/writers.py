"""Sinks: catalogs, partitioned spaces, JSON lines, stamped tables, statistics and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_catalog(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled inside quoted values, null is empty."""
    df.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_space(df: DataFrame, path: str, by: str, drop: list[str] = []) -> None:  # noqa: B006
    """A prepared table, one folder per value of a column, so that readers open only what they need."""
    df.drop(*drop).write.mode("overwrite").partitionBy(by).parquet(path)


def json_column(records: Column) -> Column:
    """A list of structs as JSON text; null stays null."""
    return F.to_json(records)


def write_atomic(df: DataFrame, path: str) -> None:
    """Written beside the target, then put in its place by renaming: readers see the old table or the new one."""
    spark = df.sparkSession
    aside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = to_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = to_path(f"{aside}-old")
    if fs.exists(to_path(path)):
        fs.rename(to_path(path), old)
    fs.rename(to_path(aside), to_path(path))
    fs.delete(old, True)


def write_stats(stats: DataFrame, path: str) -> None:
    """One row of statistics as one JSON line."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def markdown_lines(df: DataFrame, section: str, order: list[Column | str], text: Column, first: int) -> DataFrame:
    """``(section, line, text)``: the first rows of every section as list items."""
    from loomspar.operators.ranking import top_k

    return top_k(df, [section], order, first, "line").select(section, "line", F.concat(F.lit("- "), text).alias("text"))
