"""Ranking queries over orders, events and routes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspar.operators import ranking as ops
from loomspar.session import table


def best_route(spark, d):
    """The best verified route per query, by seven levels, the earliest on a tie."""
    v = table(spark, d, "route_verify").where(F.col("query_smiles").isNotNull())
    desc = lambda c: F.coalesce(F.col(c), F.lit(False)).desc()
    sim = F.coalesce(F.when(~F.isnan("similarity_to_query"), F.col("similarity_to_query")), F.lit(-1.0))
    order = [desc("catalog_only"), desc("reconstructs_query"), desc("reconstructs_searched"), desc("forward_replay_ok"), sim.desc(), F.coalesce("n_proposed_bbs", F.lit(99)), F.coalesce("n_steps", F.lit(99)), "verify_id"]
    return ops.top_k(v, ["query_smiles"], order, 1).select("query_smiles", "verify_id")


def top_orders(spark, d):
    return ops.top_k(table(spark, d, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank")


def first_groups(spark, d):
    return ops.first_groups(table(spark, d, "orders"), "o_custkey", 20).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


def latest_top(spark, d):
    """Argsort reversed: equal scores prefer the later row."""
    return table(spark, d, "events").orderBy(F.col("value").desc_nulls_last(), F.col("event_id").desc()).limit(100).select("event_id", "value")


def quota_alternatives(spark, d):
    o = table(spark, d, "orders").withColumn("buyable", F.col("o_orderstatus") == "F")
    return ops.split_quota(o, ["o_custkey"], "buyable", [F.col("o_totalprice").desc(), "o_orderkey"], 4, 2).select("o_custkey", "o_orderkey", "buyable", "rank")


def apportioned(spark, d):
    s = table(spark, d, "supplier").groupBy("s_nationkey", "s_suppkey").agg(F.round(F.greatest(F.max("s_acctbal"), F.lit(0.0)), 2).alias("score"))
    return ops.apportion(s, ["s_nationkey"], "score", 1000, "s_suppkey").select("s_nationkey", "s_suppkey", "alloc")


def ucb_scores(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("tried"), F.count_if(F.col("event_type") == "purchase").alias("success"))
    return e.join(e.agg(F.sum("tried").alias("parent")).hint("broadcast")).select("user_id", F.round(ops.ucb(F.col("success"), F.col("tried"), F.col("parent"), 0.5), 8).alias("ucb"))


def two_level_allocation(spark, d):
    """A budget per nation by score, then evenly over its suppliers."""
    s = table(spark, d, "supplier")
    n = ops.apportion(s.groupBy("s_nationkey").agg(F.count(F.lit(1)).cast("double").alias("score")).withColumn("all", F.lit(1)), ["all"], "score", 5000, "s_nationkey").select("s_nationkey", "alloc")
    w = Window.partitionBy("s_nationkey")
    rows = s.join(n, "s_nationkey").withColumn("n", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy("s_suppkey")))
    return rows.select("s_suppkey", ops.even_split(F.col("alloc"), F.col("n"), F.col("r")).cast("bigint").alias("alloc"))


def event_offsets(spark, d):
    size = F.floor(F.coalesce("value", F.lit(0.0))).cast("bigint")
    return table(spark, d, "events").select("user_id", "event_id", ops.running_offsets(size, ["user_id"], ["event_id"]).alias("begins"))


def stable_argsort(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w) - 1).alias("place"))


def segment_starts(spark, d):
    """Where the user changes in an account of events by time."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("before", F.lag("user_id").over(w)).withColumn("pos", F.row_number().over(w) - 1)
    return e.where(F.col("before").isNull() | (F.col("before") != F.col("user_id"))).select("event_type", "pos", "user_id")


def tail_thresholds(spark, d):
    return ops.tail_thresholds(table(spark, d, "events"), ["event_type"], "value", "event_id", 50, 0.25)


def running_stats(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean5"), F.round(F.stddev_pop("value").over(w), 6).alias("std5"))


def route_order(spark, d):
    """Found routes per query by exactness, similarity, steps, priority, and id; the first ten."""
    r = table(spark, d, "routes").where(F.col("found")).dropDuplicates(["route_id"])
    sim = F.coalesce(F.when(~F.isnan("similarity"), F.col("similarity")), F.lit(-1.0))
    proposed = F.size(F.filter("building_block_ids", lambda x: x.startswith("proposed__")))
    order = [F.coalesce("exact", F.lit(False)).desc(), sim.desc(), F.coalesce("n_steps", F.lit(99)), proposed, F.coalesce("bb_priority", F.lit(999)), "route_id"]
    return ops.top_k(r, ["query_smiles"], order, 10).select("query_smiles", "route_id", "rank")


def route_signatures(spark, d):
    """Routes that agree in steps, sorted rules and product keep the first."""
    r = table(spark, d, "routes").where("found").withColumn("sig", F.concat_ws("|", F.coalesce("n_steps", F.lit(-1)), F.array_join(F.array_sort("reaction_ids"), ","), F.coalesce("reconstructed_smiles", F.lit(""))))
    return r.groupBy("sig").agg(F.min("route_id").alias("route_id"), F.countDistinct("route_id").alias("n"))


QUERIES = {f.__name__: f for f in (best_route, top_orders, first_groups, latest_top, quota_alternatives, apportioned, ucb_scores, two_level_allocation, event_offsets, stable_argsort, segment_starts, tail_thresholds, running_stats, route_order, route_signatures)}
_APPORTION = "floor(share) + CASE WHEN row_number() OVER (PARTITION BY {g} ORDER BY round(share - floor(share), 9) DESC, {o}) <= {b} - sum(floor(share)) OVER (PARTITION BY {g}) THEN 1 ELSE 0 END"
SQL = {
    "best_route": "SELECT query_smiles, verify_id FROM route_verify WHERE query_smiles IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_smiles ORDER BY coalesce(catalog_only, false) DESC, coalesce(reconstructs_query, false) DESC, coalesce(reconstructs_searched, false) DESC, coalesce(forward_replay_ok, false) DESC, coalesce(CASE WHEN NOT isnan(similarity_to_query) THEN similarity_to_query END, -1.0) DESC, coalesce(n_proposed_bbs, 99), coalesce(n_steps, 99), verify_id) = 1",
    "top_orders": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3",
    "first_groups": "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 20) GROUP BY 1",
    "latest_top": "SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id DESC LIMIT 100",
    "quota_alternatives": "SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS buyable, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 2 END",
    "apportioned": "WITH s AS (SELECT s_nationkey, s_suppkey, round(greatest(max(s_acctbal), 0.0), 2) AS score FROM supplier GROUP BY ALL), t AS (SELECT *, round(CASE WHEN sum(score) OVER (PARTITION BY s_nationkey) > 0 THEN score * 1000 / sum(score) OVER (PARTITION BY s_nationkey) ELSE 1000.0 / count(*) OVER (PARTITION BY s_nationkey) END, 9) AS share FROM s) SELECT s_nationkey, s_suppkey, CAST(" + _APPORTION.format(g="s_nationkey", o="s_suppkey", b=1000) + " AS BIGINT) AS alloc FROM t",
    "ucb_scores": "WITH e AS (SELECT user_id, count(*) AS tried, count(*) FILTER (event_type = 'purchase') AS success FROM events GROUP BY 1) SELECT user_id, round(success / tried + 0.5 * sqrt(ln((SELECT sum(tried) FROM e) + 1) / (tried + 1)), 8) AS ucb FROM e",
    "two_level_allocation": "WITH n AS (SELECT s_nationkey, CAST(count(*) AS DOUBLE) AS score FROM supplier GROUP BY 1), t AS (SELECT *, round(score * 5000 / sum(score) OVER (), 9) AS share, 1 AS g FROM n), a AS (SELECT s_nationkey, CAST(" + _APPORTION.format(g="g", o="s_nationkey", b=5000) + " AS BIGINT) AS alloc FROM t), r AS (SELECT s.s_suppkey, a.alloc, count(*) OVER (PARTITION BY s.s_nationkey) AS n, row_number() OVER (PARTITION BY s.s_nationkey ORDER BY s.s_suppkey) AS r FROM supplier s JOIN a ON a.s_nationkey = s.s_nationkey) SELECT s_suppkey, alloc // n + CASE WHEN r <= alloc % n THEN 1 ELSE 0 END AS alloc FROM r",
    "event_offsets": "SELECT user_id, event_id, CAST(coalesce(sum(CAST(floor(coalesce(value, 0.0)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins FROM events",
    "stable_argsort": "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) - 1 AS place FROM lineitem",
    "segment_starts": "WITH e AS (SELECT event_type, user_id, lag(user_id) OVER w AS before, row_number() OVER w - 1 AS pos FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) SELECT event_type, pos, user_id FROM e WHERE before IS NULL OR before <> user_id",
    "tail_thresholds": "WITH t AS (SELECT event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 50) SELECT event_type, quantile_cont(value, 0.25) AS lower, quantile_cont(value, 0.75) AS upper, count(*) AS n FROM t WHERE value IS NOT NULL GROUP BY 1",
    "running_stats": "SELECT event_id, round(avg(value) OVER w, 6) AS mean5, round(stddev_pop(value) OVER w, 6) AS std5 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)",
    "route_order": "WITH r AS (SELECT * FROM routes WHERE found QUALIFY row_number() OVER (PARTITION BY route_id) = 1) SELECT query_smiles, route_id, row_number() OVER (PARTITION BY query_smiles ORDER BY coalesce(exact, false) DESC, coalesce(CASE WHEN NOT isnan(similarity) THEN similarity END, -1.0) DESC, coalesce(n_steps, 99), len(list_filter(building_block_ids, lambda x: starts_with(x, 'proposed__'))), coalesce(bb_priority, 999), route_id) AS rank FROM r QUALIFY rank <= 10",
    "route_signatures": "WITH r AS (SELECT route_id, concat_ws('|', coalesce(n_steps, -1), array_to_string(list_sort(list_filter(reaction_ids, lambda x: x IS NOT NULL)), ','), coalesce(reconstructed_smiles, '')) AS sig FROM routes WHERE found) SELECT sig, min(route_id) AS route_id, count(DISTINCT route_id) AS n FROM r GROUP BY sig",
}
