"""Joins by meaning: membership, relational division, cascades, near joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replacing_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which the right side's columns replace equally named ones of the left."""
    return left.drop(*[c for c in left.columns if c in right.columns and c not in on]).join(right, on)


def complementary(members: DataFrame, rule: str, role: str, item: str) -> DataFrame:
    """For items in exactly one role of a two-role rule: the number of partners in the other role."""
    distinct = members.select(rule, role, item).distinct()
    own = distinct.groupBy(rule, item).agg(F.count(F.lit(1)).alias("n_roles"), F.min(role).alias("role"))
    sizes = distinct.groupBy(rule, role).agg(F.count(F.lit(1)).alias("n_partners")).withColumn("other", 1 - F.col(role)).select(rule, F.col("other").alias("role"), "n_partners")
    return own.where("n_roles = 1").join(sizes, [rule, "role"]).select(rule, item, "role", "n_partners")


def divides(have: DataFrame, need: DataFrame, owner: str, group: str, item: str) -> DataFrame:
    """Relational division: owners that have every item a group needs. Groups without needs fit all
    and are the caller's to add."""
    need = need.select(group, item).distinct()
    n = need.groupBy(group).agg(F.count(F.lit(1)).alias("n_need"))
    met = have.select(owner, item).distinct().join(need, item).groupBy(owner, group).agg(F.count(F.lit(1)).alias("n_met"))
    return met.join(n, group).where("n_met = n_need").select(owner, group)


def cascade(queries: DataFrame, levels: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """The value from the first level that has one. ``levels``: ``(name, table of (key, value, ord))``;
    ties within a level by ``ord``. Keys without any value keep null."""
    tagged = [t.select(key, value, "ord").withColumns({"level": F.lit(i), "level_name": F.lit(name)}) for i, (name, t) in enumerate(levels)]
    best = reduce(DataFrame.unionByName, tagged).groupBy(key).agg(F.min(F.struct("level", "ord", value, "level_name")).alias("b"))
    return queries.join(best, key, "left").select(*queries.columns, F.col(f"b.{value}").alias(value), F.col("b.level_name").alias("matched_by"))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct elements; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def nearest_by_tokens(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar items per query by shared tokens, over posting lists.

    Both: ``(id, tokens array of distinct elements)``. Only pairs that share a token meet; their
    intersection is counted on the way, so tokens are not compared again. Ties by item id.
    """
    q = queries.select(F.col("id").alias("q"), F.size("tokens").alias("nq"), F.explode("tokens").alias("t"))
    i = items.select(F.col("id").alias("i"), F.size("tokens").alias("ni"), F.explode("tokens").alias("t"))
    met = q.join(i, "t").groupBy("q", "i", "nq", "ni").agg(F.count(F.lit(1)).alias("both"))
    scored = met.select("q", "i", F.round(F.col("both") / (F.col("nq") + F.col("ni") - F.col("both")), 8).alias("sim"))
    n = F.row_number().over(Window.partitionBy("q").orderBy(F.col("sim").desc(), "i"))
    return scored.withColumn("rank", n).where(F.col("rank") <= k)


def cell(c: Column, width: float) -> Column:
    return F.floor(c / width).cast("bigint")


def within_distance(left: DataFrame, right: DataFrame, dims: list[str], radius: float, on: list[str] = []) -> DataFrame:  # noqa: B006
    """Pairs within a distance, over grid cells of the radius: the right side is put into the 3^d cells
    around its own, the left into one; ``left``/``right`` have ids ``l``/``r`` and coordinates ``dims``."""
    r = right.select("r", *on, *[F.col(d).alias(f"r_{d}") for d in dims])
    for d in dims:
        r = r.withColumn(f"c_{d}", F.explode(F.array(*[cell(F.col(f"r_{d}"), radius) + o for o in (-1, 0, 1)])))
    lhs = left.select("l", *on, *dims, *[cell(F.col(d), radius).alias(f"c_{d}") for d in dims])
    square = sum(((F.col(d) - F.col(f"r_{d}")) ** 2 for d in dims), F.lit(0.0))
    return lhs.join(r, [*on, *[f"c_{d}" for d in dims]]).withColumn("distance", F.sqrt(square)).where(F.col("distance") <= radius).select(*on, "l", "r", "distance")
