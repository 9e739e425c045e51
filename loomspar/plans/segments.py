"""Segment, tree, graph and density queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspar.operators import graphs as ops
from loomspar.session import table


def order_segments(spark, d):
    s = ops.segment_stats(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), table(spark, d, "orders"), "o_orderkey", "l_quantity")
    return s.select("o_orderkey", "n", "total", F.round("mean", 8).alias("mean"), F.round("std", 6).alias("std"), "low", "high")


def softmax_weights(spark, d):
    e = table(spark, d, "events").where(F.col("value").isNotNull())
    return e.select("event_id", F.round(ops.segment_softmax(F.col("value") / 100, ["user_id", "event_type"]), 8).alias("w"))


def argmax_rows(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("high"), F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("at"))


def _tree(spark, d):
    """Parent of event n is n // 2; the counter is 1 for purchases."""
    e = table(spark, d, "events").select(F.col("event_id").alias("node"), (F.col("event_type") == "purchase").cast("bigint").alias("v"))
    return e.withColumn("parent", F.when(F.col("node") > 1, F.floor(F.col("node") / 2)))


def tree_totals(spark, d):
    return ops.roll_up_tree(_tree(spark, d), "node", "parent", "v")


def tree_paths(spark, d):
    return ops.root_paths(_tree(spark, d), "node", "parent")


def _part_links(spark, d):
    """Every line as a link of its part (even number) and its supplier (odd number), by their real keys."""
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_suppkey") * 2 + 1).alias("src"), (F.col("l_partkey") * 2).alias("dst")).distinct()


def whole_components(spark, d):
    """Components of the graph of all lines."""
    return ops.components(_part_links(spark, d), "dst", "src")


def whole_subgraph(spark, d):
    """The graph of all lines, with all parts and the suppliers of positive balance."""
    links = _part_links(spark, d)
    kept = table(spark, d, "supplier").where("s_acctbal > 0").select((F.col("s_suppkey") * 2 + 1).alias("node")).union(table(spark, d, "part").select(F.col("p_partkey") * 2)).distinct()
    return ops.induced_subgraph(links, links.select("g").distinct().crossJoin(kept), "g", "node", "src", "dst")


def whole_triangles(spark, d):
    """Triangles of the parts that stand in one order, over all orders."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    pairs = li.withColumnRenamed("l_partkey", "a").join(li.withColumnRenamed("l_partkey", "b"), "l_orderkey").where("a < b")
    return ops.triangles(pairs, "a", "b")


def demeaned(spark, d):
    w = Window.partitionBy("l_orderkey")
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q")).select("l_orderkey", "l_linenumber", F.round(F.col("q") - F.avg("q").over(w), 8).alias("q0"))


LEVELS = [["p_brand", "p_type", "p_size"], ["p_brand", "p_type"], ["p_brand"]]


def density_validity(spark, d):
    """Lines against the price model of their part's key, by fallback from exact to general."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    li = table(spark, d, "lineitem").select("l_partkey", "l_extendedprice").join(part, F.col("l_partkey") == F.col("p_partkey"))
    models = ops.level_densities(li, LEVELS, "l_extendedprice", 50)
    rows = ops.with_fallback(li, models, LEVELS, ["mu", "sd"])
    q = F.exp(-(((F.col("l_extendedprice") - F.col("mu")) / F.col("sd")) ** 2) / 2)
    return rows.groupBy(F.coalesce("level", F.lit(-1)).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(q > 0.2, F.lit(True))).alias("n_valid"), F.round(F.avg(q), 8).alias("mean_q"))


def bandwidths(spark, d):
    """Silverman bandwidth per event type."""
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.stddev_pop("value").alias("s"), (F.percentile("value", 0.75) - F.percentile("value", 0.25)).alias("iqr"))
    return g.select("event_type", F.round(0.9 * F.least("s", F.col("iqr") / 1.34) * F.pow("n", F.lit(-0.2)), 8).alias("h"))


def size_histogram(spark, d):
    i = table(spark, d, "dataset_items").groupBy("item_id").agg(F.max(F.struct("ingested_at", "n_atoms", "n_residues")).alias("r")).select("r.*")  # as last delivered
    return i.groupBy(F.floor(F.col("n_atoms") / 5).alias("a"), F.floor(F.col("n_residues") / 5).alias("r")).agg(F.count(F.lit(1)).alias("n"))


def conditional_sizes(spark, d):
    """Share of each residue bin within an atom bin."""
    h = size_histogram(spark, d).where("a is not null and r is not null")
    return h.select("a", "r", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("a")), 9).alias("p"))


def smoothed_log_sizes(spark, d):
    """Logarithm of the share of each residue bin within an atom bin, smoothed by 0.001."""
    return conditional_sizes(spark, d).select("a", "r", F.round(F.log(F.col("p") + 1e-3), 7).alias("log_p"))


def scott_bandwidths(spark, d):
    """Scott bandwidth per event type, and the smaller of it and Silverman's."""
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.stddev_pop("value").alias("s"), (F.percentile("value", 0.75) - F.percentile("value", 0.25)).alias("iqr"))
    scott, silverman = F.col("s") * F.pow("n", F.lit(-0.2)), 0.9 * F.least("s", F.col("iqr") / 1.34) * F.pow("n", F.lit(-0.2))
    return g.select("event_type", F.round(scott, 8).alias("scott"), F.round(F.least(scott, silverman), 8).alias("h"))


QUERIES = {f.__name__: f for f in (order_segments, softmax_weights, argmax_rows, tree_totals, tree_paths, whole_components, whole_subgraph, whole_triangles, demeaned, density_validity, bandwidths, size_histogram, conditional_sizes, smoothed_log_sizes, scott_bandwidths)}
_TREE = "WITH RECURSIVE t AS (SELECT event_id AS node, CASE WHEN event_id > 1 THEN event_id // 2 END AS parent, CAST(event_type = 'purchase' AS BIGINT) AS v FROM events), a AS (SELECT node, node AS anc, 0 AS depth FROM t UNION ALL SELECT a.node, t.parent, depth + 1 FROM a JOIN t ON t.node = a.anc WHERE t.parent IS NOT NULL)"
_DENS = "".join(f", m{i} AS (SELECT {', '.join(lv)}, avg(x) AS mu, stddev_pop(x) AS sd FROM l GROUP BY {', '.join(lv)} HAVING count(x) > 50)" for i, lv in enumerate(LEVELS))
SQL = {
    "order_segments": "SELECT o_orderkey, count(l_quantity) AS n, coalesce(sum(l_quantity), 0) AS total, round(coalesce(sum(l_quantity), 0) / greatest(count(l_quantity), 1), 8) AS mean, round(sqrt(coalesce(var_pop(l_quantity) * count(l_quantity), 0) / (greatest(count(l_quantity) - 1, 1) + 1e-6)), 6) AS std, min(l_quantity) AS low, max(l_quantity) AS high FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "softmax_weights": "SELECT event_id, round(exp(value / 100 - max(value / 100) OVER w) / sum(exp(value / 100)) OVER w * exp(max(value / 100) OVER w), 8) AS w FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id, event_type)",
    "argmax_rows": "SELECT o_custkey, max(o_totalprice) AS high, arg_max(o_orderkey, struct_pack(o_totalprice, k := -o_orderkey)) AS at FROM orders GROUP BY 1",
    "tree_totals": _TREE + " SELECT a.anc AS node, sum(t.v) AS total, max(depth) AS height FROM a JOIN t ON t.node = a.node GROUP BY 1",
    "tree_paths": _TREE + " SELECT node, string_agg(CAST(anc AS VARCHAR), '-' ORDER BY depth DESC) AS path FROM a GROUP BY 1",
    "whole_subgraph": "WITH e AS (SELECT DISTINCT l_returnflag AS g, l_suppkey * 2 + 1 AS s, l_partkey * 2 AS t FROM lineitem), k AS (SELECT s_suppkey * 2 + 1 AS node FROM supplier WHERE s_acctbal > 0 UNION SELECT p_partkey * 2 FROM part), n AS (SELECT node, CAST(row_number() OVER (ORDER BY node) - 1 AS INT) AS i FROM k) SELECT g, a.i AS s, b.i AS t FROM e JOIN n a ON a.node = e.s JOIN n b ON b.node = e.t",
    "whole_triangles": "WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), e AS (SELECT DISTINCT a.p AS u, b.p AS v FROM l a JOIN l b ON a.o = b.o AND a.p < b.p), t AS (SELECT x.u AS a, x.v AS b, y.v AS c FROM e x JOIN e y ON y.u = x.v JOIN e z ON z.u = x.u AND z.v = y.v) SELECT node, count(*) AS n FROM (SELECT unnest([a, b, c]) AS node FROM t) GROUP BY 1",
    "demeaned": "WITH l AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) SELECT l_orderkey, l_linenumber, round(q - avg(q) OVER (PARTITION BY l_orderkey), 8) AS q0 FROM l",
    "density_validity": "WITH l AS (SELECT p_brand, p_type, p_size, l_extendedprice AS x FROM lineitem JOIN part ON p_partkey = l_partkey)" + _DENS + ", j AS (SELECT x, CASE WHEN m0.mu IS NOT NULL THEN 0 WHEN m1.mu IS NOT NULL THEN 1 WHEN m2.mu IS NOT NULL THEN 2 ELSE -1 END AS level, coalesce(m0.mu, m1.mu, m2.mu) AS mu, coalesce(m0.sd, m1.sd, m2.sd) AS sd FROM l LEFT JOIN m0 USING (p_brand, p_type, p_size) LEFT JOIN m1 ON m1.p_brand = l.p_brand AND m1.p_type = l.p_type LEFT JOIN m2 ON m2.p_brand = l.p_brand), q AS (SELECT level, exp(-(((x - mu) / sd) ** 2) / 2) AS q FROM j) SELECT level, count(*) AS n, count(*) FILTER (coalesce(q > 0.2, true)) AS n_valid, round(avg(q), 8) AS mean_q FROM q GROUP BY 1",
    "bandwidths": "SELECT event_type, round(0.9 * least(stddev_pop(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34) * pow(count(value), -0.2), 8) AS h FROM events GROUP BY 1",
    "size_histogram": "WITH i AS (SELECT m.n_atoms AS n_atoms, m.n_residues AS n_residues FROM (SELECT item_id, max(struct_pack(t := ingested_at, n_atoms, n_residues)) AS m FROM dataset_items GROUP BY 1)) SELECT CAST(floor(n_atoms / 5) AS BIGINT) AS a, CAST(floor(n_residues / 5) AS BIGINT) AS r, count(*) AS n FROM i GROUP BY ALL",
    "conditional_sizes": "WITH i AS (SELECT m.n_atoms AS n_atoms, m.n_residues AS n_residues FROM (SELECT item_id, max(struct_pack(t := ingested_at, n_atoms, n_residues)) AS m FROM dataset_items GROUP BY 1)), h AS (SELECT CAST(floor(n_atoms / 5) AS BIGINT) AS a, CAST(floor(n_residues / 5) AS BIGINT) AS r, count(*) AS n FROM i WHERE n_atoms IS NOT NULL AND n_residues IS NOT NULL GROUP BY ALL) SELECT a, r, round(n / sum(n) OVER (PARTITION BY a), 9) AS p FROM h",
    "smoothed_log_sizes": "WITH i AS (SELECT m.n_atoms AS n_atoms, m.n_residues AS n_residues FROM (SELECT item_id, max(struct_pack(t := ingested_at, n_atoms, n_residues)) AS m FROM dataset_items GROUP BY 1)), h AS (SELECT CAST(floor(n_atoms / 5) AS BIGINT) AS a, CAST(floor(n_residues / 5) AS BIGINT) AS r, count(*) AS n FROM i WHERE n_atoms IS NOT NULL AND n_residues IS NOT NULL GROUP BY ALL) SELECT a, r, round(ln(round(n / sum(n) OVER (PARTITION BY a), 9) + 0.001), 7) AS log_p FROM h",
    "scott_bandwidths": "SELECT event_type, round(stddev_pop(value) * pow(count(value), -0.2), 8) AS scott, round(least(stddev_pop(value), 0.9 * least(stddev_pop(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34)) * pow(count(value), -0.2), 8) AS h FROM events GROUP BY 1",
}
