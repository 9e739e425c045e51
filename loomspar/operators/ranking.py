"""Ranking: top-k, quotas, best rows, apportionment, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per group. As a filter on row_number it is pushed into the sort as a group
    limit, so that only ``k`` rows per group and task are shuffled."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def first_groups(df: DataFrame, by: str, k: int) -> DataFrame:
    """All rows of the first ``k`` group keys."""
    keys = df.select(by).distinct().orderBy(by).limit(k)
    return df.join(F.broadcast(keys), by, "left_semi")  # k rows


def split_quota(df: DataFrame, by: list[str], flag: str, order: list[Column | str], n_true: int, n_false: int) -> DataFrame:
    """Separate quotas per group for rows with and without a flag."""
    n = F.row_number().over(Window.partitionBy(*by, flag).orderBy(*order))
    return df.withColumn("rank", n).where(F.col("rank") <= F.when(F.col(flag), n_true).otherwise(n_false))


def apportion(df: DataFrame, by: list[str], score: str, budget: int, order: str, out: str = "alloc") -> DataFrame:
    """A whole budget in proportion to scores by largest remainder; equal parts where all scores are 0
    or null; ties to the earlier row. The parts of a group sum to the budget."""
    w, value = Window.partitionBy(*by), F.coalesce(F.col(score), F.lit(0.0))
    total = F.sum(value).over(w)
    share = F.when(total > 0, value * budget / total).otherwise(F.lit(float(budget)) / F.count(F.lit(1)).over(w))
    rows = df.withColumn("__share", F.round(share, 9))
    rest = F.round(F.col("__share") - F.floor("__share"), 9)
    n = F.row_number().over(w.orderBy(rest.desc(), order))
    left = F.lit(budget) - F.sum(F.floor("__share")).over(w)
    return rows.withColumn(out, (F.floor("__share") + F.when(n <= left, 1).otherwise(0)).cast("bigint")).drop("__share")


def even_split(total: Column, n: Column, rank: Column) -> Column:
    """The part of rank 1 .. n of a total: equal parts, the remainder to the lowest ranks."""
    return F.floor(total / n) + F.when(rank <= total % n, 1).otherwise(0)


def ucb(success: Column, tried: Column, parent_tried: Column, weight: float) -> Column:
    """Upper confidence bound: success rate (0 if untried) plus an exploration term."""
    rate = F.when(tried > 0, success / tried).otherwise(F.lit(0.0))
    return rate + F.lit(weight) * F.sqrt(F.log(parent_tried + 1) / (tried + 1))


def running_offsets(size: Column, by: list[str], order: list[str]) -> Column:
    """Exclusive prefix sum of sizes: where each part begins when all are put one after the other."""
    return F.coalesce(F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def tail_thresholds(df: DataFrame, by: list[str], value: str, order: str, last: int, q: float) -> DataFrame:
    """Quantiles of the values in each group's last rows; rows are taken before nulls are dropped."""
    tail = top_k(df, by, [F.col(order).desc()], last).where(F.col(value).isNotNull())
    return tail.groupBy(*by).agg(F.percentile(value, q).alias("lower"), F.percentile(value, 1 - q).alias("upper"), F.count(F.lit(1)).alias("n"))
