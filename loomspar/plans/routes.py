"""Route search, trace and replay queries on a hypergraph of part numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspar.operators import routes as ops
from loomspar.session import table


def _graph(spark, d):
    """Part n is made of n // 2 and n // 3 by rule ``h`` and of n - 7 by rule ``s``; parts of size below 12 are leaves."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("n"), "p_size")
    name = lambda c: F.concat(F.lit("p"), F.floor(c).cast("string"))
    h = p.where("n > 6").select(name(F.col("n")).alias("product"), F.lit("h").alias("rule"), F.array(name(F.col("n") / 2), name(F.col("n") / 3)).alias("parts"))
    s = p.where("n > 7").select(name(F.col("n")).alias("product"), F.lit("s").alias("rule"), F.array(name(F.col("n") - 7)).alias("parts"))
    return p.select(name(F.col("n")).alias("node")), h.unionByName(s), p.where("p_size < 12").select(name(F.col("n")).alias("node"))


def route_costs(spark, d):
    """Cheapest cost per part within two steps of depth, null where there is none."""
    return ops.find_routes(*_graph(spark, d), depth=2, k=3).groupBy("node").agg(F.min("cost").alias("cost"))


def deepening_costs(spark, d):
    """The depth that first solves a part, and its cheapest cost there."""
    return ops.deepen(*_graph(spark, d), depths=[1, 2], k=3).groupBy("node").agg(F.min("depth").alias("depth"), F.min("cost").alias("cost"))


def trace_steps(spark, d):
    routes = ops.find_routes(*_graph(spark, d), depth=2, k=1).where("trace is not null")
    return ops.parse_traces(routes, "node", "trace").select("node", "i", "depth", "rule", "product", F.array_join("parts", ".").alias("parts"))


def replay_verdicts(spark, d):
    targets, edges, leaves = _graph(spark, d)
    routes = ops.find_routes(targets, edges, leaves, depth=2, k=1).where("cost > 0")
    verdict = ops.replay(ops.parse_traces(routes, "node", "trace"), edges, "node")
    return verdict.groupBy("n_steps").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bad").alias("n_bad"))


QUERIES = {f.__name__: f for f in (route_costs, deepening_costs, trace_steps, replay_verdicts)}
_G = """WITH p AS (SELECT p_partkey AS n, p_size < 12 AS leaf FROM part), e AS (SELECT n AS prod, n // 2 AS a, n // 3 AS b FROM p WHERE n > 6 UNION ALL SELECT n, n - 7, n - 7 FROM p WHERE n > 7),
  l AS (SELECT n FROM p WHERE leaf), s1 AS (SELECT prod AS n, 1 AS c FROM e WHERE a IN (SELECT n FROM l) AND b IN (SELECT n FROM l) GROUP BY prod),
  k1 AS (SELECT n, 0 AS c FROM l UNION ALL SELECT n, c FROM s1 WHERE n NOT IN (SELECT n FROM l)),
  s2 AS (SELECT prod AS n, min(1 + x.c + CASE WHEN a = prod - 7 AND b = prod - 7 THEN 0 ELSE y.c END) AS c FROM e JOIN k1 x ON x.n = a JOIN k1 y ON y.n = b GROUP BY prod)"""
SQL = {"deepening_costs": _G + " SELECT 'p' || p.n AS node, CASE WHEN leaf OR s1.c IS NOT NULL THEN 1 WHEN s2.c IS NOT NULL THEN 2 END AS depth, CASE WHEN leaf THEN 0 ELSE coalesce(s1.c, s2.c) END AS cost FROM p LEFT JOIN s1 ON s1.n = p.n LEFT JOIN s2 ON s2.n = p.n", "route_costs": _G + " SELECT 'p' || p.n AS node, CASE WHEN leaf THEN 0 ELSE s2.c END AS cost FROM p LEFT JOIN s2 ON s2.n = p.n"}
