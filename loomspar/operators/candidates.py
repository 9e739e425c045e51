"""Candidate generation for route search: prefilters, roles, partners and rankings."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def needs_index(rules: DataFrame, rule: str, needs: str) -> DataFrame:
    """Inverted index of the rules' required features: ``(feature, rule, n_need)``; rules without needs
    stand under a null feature, to be tried always."""
    need = F.array_distinct(F.coalesce(F.col(needs), F.array().cast("array<string>")))
    return rules.select(rule, need.alias("need")).select(rule, F.size("need").alias("n_need"), F.explode_outer("need").alias("feature"))


def fitting_rules(items: DataFrame, item: str, features: str, index: DataFrame, rule: str) -> DataFrame:
    """``(item, rule)``: rules whose needs an item's features hold. Matches are counted over the index, no
    item meets a rule it shares no feature with, but for those to be tried always."""
    have = items.select(item, F.explode(F.array_distinct(features)).alias("feature"))
    met = have.join(index.where("feature is not null"), "feature").groupBy(item, rule).agg(F.count(F.lit(1)).alias("n"), F.first("n_need").alias("n_need"))
    always = items.select(item).distinct().crossJoin(F.broadcast(index.where("feature is null").select(rule).distinct()))  # rules, a table of fixed size
    return met.where("n = n_need").select(item, rule).union(always)


def fits_some_order(kinds: Column, roles: list[list[str]]) -> Column:
    """Whether some order of up to three values fits the roles, a role being the list of kinds it takes;
    an empty list takes any."""
    n = len(roles)
    fit = lambda i, r: F.lit(True) if not roles[r] else F.coalesce(F.get(kinds, F.lit(i)).isin(*roles[r]), F.lit(False))
    some = F.lit(False)
    for p in permutations(range(n)):
        every = F.lit(True)
        for r, i in enumerate(p):
            every &= fit(i, r)
        some |= every
    return (F.size(kinds) == n) & some


def ranked_partners(wanted: DataFrame, items: DataFrame, on: str, size: str, priority: str, item: str, slack: int, small: int, k: int) -> DataFrame:
    """Partners of the same rule within a size window of what is expected (or small at all): the first
    ``k`` per wanted row by priority, distance of sizes and name.

    ``wanted``: ``(w, on, expected)``. The window is an equi-join on stretches of ``slack`` + 1 sizes, the
    small ones are one list per rule of which only the first ``k`` can matter.
    """
    step = slack + 1
    near = wanted.withColumn("__s", F.explode(F.sequence(F.floor((F.col("expected") - slack) / step), F.floor((F.col("expected") + slack) / step))))
    hit = near.join(items.withColumn("__s", F.floor(F.col(size) / step)), [on, "__s"]).where(F.abs(F.col(size) - F.col("expected")) <= slack).drop("__s")
    by = Window.partitionBy(on, size).orderBy(priority, item)
    few = items.where(F.col(size) <= small).withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= k).drop("__n")
    rest = wanted.join(few, on).where(F.abs(F.col(size) - F.col("expected")) > slack)
    every = hit.select("w", on, "expected", item, size, priority).union(rest.select("w", on, "expected", item, size, priority))
    n = F.row_number().over(Window.partitionBy("w", on).orderBy(priority, F.abs(F.col(size) - F.col("expected")), item))
    return every.withColumn("rank", n).where(F.col("rank") <= k)


def role_pairs(members: DataFrame, rule: str, role: str, item: str, size: str, k: int) -> DataFrame:
    """Pairs of the ``k`` largest items of role 0 with those of role 1 of each rule."""
    n = F.row_number().over(Window.partitionBy(rule, role).orderBy(F.col(size).desc(), item))
    top = members.select(rule, role, item, size).distinct().withColumn("n", n).where(F.col("n") <= k)
    a, b = (top.where(F.col(role) == r).select(rule, F.col(item).alias(f"item_{r}"), F.col(size).alias(f"size_{r}")) for r in (0, 1))
    return a.join(b, rule)


def with_fallback_candidates(levels: list[DataFrame], key: str) -> DataFrame:
    """Candidates of the first level that has any for a key: later levels serve only keys left empty."""
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level.join(out.select(key).distinct(), key, "left_anti"))
    return out
