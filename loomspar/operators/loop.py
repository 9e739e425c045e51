"""Iterative driver: sample, filter, expand; criteria that move; caches of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspar.session import cut_lineage

Criterion = tuple[str, str, float, float]  # group, column, lower and upper bound


def ranked_criteria(criteria: list[Criterion]) -> dict[str, int]:
    """Rank of each group: the place of its first criterion."""
    return {g: i for i, g in enumerate(dict.fromkeys(c[0] for c in criteria))}


def moved_bounds(criteria: list[Criterion], bounds: dict[str, tuple[float, float]]) -> list[Criterion]:
    """The criteria with new bounds wherever they test one of the columns."""
    return [(g, c, *bounds.get(c, (lo, hi))) for g, c, lo, hi in criteria]


def first_failure(criteria: list[Criterion]) -> Column:
    """The group of lowest rank with a criterion that does not hold (null and NaN never hold), else null."""
    rank = ranked_criteria(criteria)
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    out = []
    for g in rank:
        ok = F.lit(True)
        for group, c, lo, hi in criteria:
            if group == g:
                ok &= F.coalesce((value(c) >= lo) & (value(c) <= hi), F.lit(False))
        out.append(F.when(~ok, F.lit(g)))
    return F.coalesce(*out)


def select_unique(batch: DataFrame, key: str, passed: Column, order: list[str], history: DataFrame) -> DataFrame:
    """Rows that pass, whose key was not accepted before, the first of each key: a row that fails does
    not use up its key."""
    fresh = batch.where(passed).join(history.select(key).distinct(), key, "left_anti")
    return fresh.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def sample_filter_expand(
    start: DataFrame, key: str, order: list[str], passed: Column, expand: Callable[[DataFrame], DataFrame], rounds: int, enough: int | None = None
) -> DataFrame:
    """Accepted rows with the ``round`` that accepted them.

    A round takes its batch, accepts the rows that pass and are new, and expands the accepted into the
    next batch (of the batch's columns). It ends at ``rounds``, when ``enough`` rows are accepted, or when nothing
    new came. Lineage is cut once a round; only a count comes to the driver.
    """
    accepted: DataFrame | None = None
    batch, total = start, 0
    for k in range(rounds):
        history = accepted if accepted is not None else start.select(key).limit(0)
        new = cut_lineage(select_unique(batch, key, passed, order, history).withColumn("round", F.lit(k)))
        n = new.count()
        total += n
        accepted = new if accepted is None else accepted.unionByName(new)
        if n == 0 or enough is not None and total >= enough:
            break
        batch = expand(new.drop("round"))
    return accepted


def with_cache(queries: DataFrame, key: str, cache: DataFrame, version: int, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``(results, cache)``: stored results of this version are used, only the rest is computed, and the new cache
    keeps both. ``cache``: the result columns plus ``version``; rows of another version are dropped."""
    valid = cache.where(F.col("version") == version)
    todo = queries.select(key).distinct().join(valid.select(key).distinct(), key, "left_anti")
    new = cut_lineage(compute(todo).withColumn("version", F.lit(version)))
    every = valid.unionByName(new)
    return queries.select(key).distinct().join(every.drop("version"), key), every
