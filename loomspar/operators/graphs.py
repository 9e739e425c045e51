"""Segments, trees, graphs and hierarchical densities over edge and node tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspar.session import cut_lineage, drop_cut


def segment_stats(df: DataFrame, segments: DataFrame, by: str, value: str) -> DataFrame:
    """Sum, mean (count at least 1), deviation (unbiased, smoothed), extremes per segment; segments
    without rows have sum and mean 0."""
    v = F.col(value)
    n = F.count(v)
    agg = df.groupBy(by).agg(F.sum(v).alias("total"), n.alias("n"), (F.var_pop(v) * n).alias("ssd"), F.min(v).alias("low"), F.max(v).alias("high"))
    rows = segments.select(by).distinct().join(agg, by, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(
        by, zero("n").alias("n"), zero("total").alias("total"), (zero("total") / F.greatest(zero("n"), F.lit(1))).alias("mean"),
        F.sqrt(zero("ssd") / (F.greatest(zero("n") - 1, F.lit(1)) + 1e-6)).alias("std"), "low", "high",
    )


def segment_softmax(value: Column, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    e = F.exp(value - F.max(value).over(w))
    return e / F.sum(e).over(w)


def ancestors(tree: DataFrame, node: str, parent: str) -> DataFrame:
    """``(node, anc, depth)``: every node with itself and all its ancestors, by doubling steps: each
    round joins the pairs found so far, so the rounds grow with the logarithm of the depth."""
    done = tree.select(node, F.col(node).alias("anc"), F.lit(0).alias("depth"))
    step = tree.where(F.col(parent).isNotNull()).select(node, F.col(parent).alias("anc"), F.lit(1).alias("depth"))
    reach = cut_lineage(step)
    while True:
        longest = reach.agg(F.max("depth")).first()[0] or 0
        a, b = reach.where(F.col("depth") == longest), reach.select(F.col(node).alias("anc"), F.col("anc").alias("a2"), F.col("depth").alias("d2"))
        more = cut_lineage(a.join(b, "anc").select(node, F.col("a2").alias("anc"), (F.col("depth") + F.col("d2")).alias("depth"))) if longest else None
        if more is None or more.isEmpty():
            return done.unionByName(reach)
        reach = reach.unionByName(more)


FEW = 10_000  # rows of a table that is broadcast


def _sized(cut: DataFrame) -> DataFrame:
    """A table that cut lineage, broadcast or not by its rows: many sequential keys make a small file and a large broadcast."""
    return cut.hint("broadcast" if cut.count() <= FEW else "merge")


def _met(state: DataFrame) -> DataFrame:
    """``(p, ...)``: the rows of ``state`` whose node ``n`` another row points to by its ``p``."""
    wanted = cut_lineage(state.where("p is not null").select("p").distinct())
    met = cut_lineage(state.withColumnRenamed("p", "q").withColumnRenamed("n", "p").join(_sized(wanted), "p", "left_semi"))
    drop_cut(wanted)
    return met


def roll_up_tree(tree: DataFrame, node: str, parent: str, value: str) -> DataFrame:
    """Every node's own value plus those of its whole subtree (``total``), and how deep that is (``height``).

    By doubling: a node's row holds the sum over its subtree to a depth below ``reach`` and points ``p`` to
    the ancestor ``reach`` steps up, which takes the sum over. So a round has one row per node, and the
    rounds grow with the logarithm of the depth. Parents without a row of their own count as nodes."""
    state = tree.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("n")).agg(F.max(parent).alias("p"), F.sum(value).alias("s"), F.lit(0).alias("h"))
    state, reach = cut_lineage(state), 1
    kind = dict(state.dtypes)
    while True:
        live, none = state.where("p is not null"), F.lit(None).cast(kind["p"]).alias("p")
        ups = _met(state.select("n", "p").where("p is not null"))
        given = state.where("p is null").union(live.select(F.col("p").cast(kind["n"]).alias("n"), none, "s", (F.col("h") + reach).alias("h")))
        last = ups.isEmpty()
        lifted = live.select("n", none, "s", "h") if last else live.join(_sized(ups), "p", "left").select("n", F.col("q").alias("p"), "s", "h")
        new = given.union(lifted).groupBy("n").agg(F.max("p").alias("p"), F.sum("s").cast(kind["s"]).alias("s"), F.max("h").alias("h"))
        if last:
            return new.select(F.col("n").alias(node), F.col("s").alias("total"), F.col("h").alias("height"))
        before, state, reach = state, cut_lineage(new), 2 * reach
        drop_cut(before)
        drop_cut(ups)


def root_paths(tree: DataFrame, node: str, parent: str, between: str = "-") -> DataFrame:
    """``(node, path)``: every node's ancestors from the root down to itself, as a text. Each node has one row.

    By doubling: a row holds the stretch of path below its ``p``, which a round puts the stretch of ``p``
    before. Only stretches that another row points to are joined: towards the root these are ever fewer."""
    state = cut_lineage(tree.select(F.col(node).alias("n"), F.col(parent).alias("p"), F.col(node).cast("string").alias("path")))
    while True:
        ups = _met(state)
        longer = F.concat(F.coalesce("up", F.col("p").cast("string")), F.lit(between), "path").alias("path")
        new = state.where("p is null").union(state.where("p is not null").join(_sized(ups).withColumnRenamed("path", "up"), "p", "left").select("n", "q", longer))
        if ups.where("q is not null").isEmpty():
            return new.select(F.col("n").alias(node), "path")
        before, state = state, cut_lineage(new)
        drop_cut(before)
        drop_cut(ups)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, comp)``: the least node of each connected component. Each round every node takes the
    least label among its neighbours' and its label's own label (shortcut); rounds end when nothing changes."""
    both = cut_lineage(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = cut_lineage(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("comp")).withColumnRenamed("x", "node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels["node"] == near["x"]).select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        short = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = cut_lineage(step.join(short, "comp", "left").select("node", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")))
        changed = not new.where("old <> comp").isEmpty()
        labels = new.select("node", "comp")
        if not changed:
            return labels


def induced_subgraph(edges: DataFrame, nodes: DataFrame, graph: str, node: str, src: str, dst: str) -> DataFrame:
    """Edges of kept nodes, ends renumbered from 0 within each graph."""
    n = nodes.select(graph, node, (F.row_number().over(Window.partitionBy(graph).orderBy(node)) - 1).alias("i"))
    left = edges.join(n.withColumnsRenamed({node: src, "i": "s"}), [graph, src])
    return left.join(n.withColumnsRenamed({node: dst, "i": "t"}), [graph, dst]).select(graph, "s", "t")


WEDGES = 3  # per edge, that one pass over a graph's wedges ships at most: this bounds its shuffle files


def triangles(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """``(node, n)``: triangles at each node; edges point from the node of lower degree, which bounds the wedges of hubs.

    A node's out-neighbours stand in one list in order of degree. Each of them, ``b``, is sent the neighbours
    after it, and those that are in ``b``'s own list close a triangle: no wedge is a row of its own. This
    is done in as many passes over parts of ``b`` as keep each to ``WEDGES`` per edge."""
    e = cut_lineage(edges.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).where("u <> v").distinct())
    deg = cut_lineage(e.select(F.explode(F.array("u", "v")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("deg")))
    half = cut_lineage(e.join(deg.toDF("u", "du"), "u"))
    d = half.join(deg.toDF("v", "dv"), "v")
    flip = (F.col("du") > F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") > F.col("v")))
    o = d.select(F.when(flip, F.col("v")).otherwise(F.col("u")).alias("a"), F.struct(F.when(flip, F.col("du")).otherwise(F.col("dv")).alias("deg"), F.when(flip, F.col("u")).otherwise(F.col("v")).alias("x")).alias("b"))
    drop_cut(e)
    lists = cut_lineage(o.groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("b")).select("a", F.col("b.x").alias("out")))
    drop_cut(half)
    drop_cut(deg)
    n = F.size("out").cast("bigint")
    wedges, size = lists.agg(F.sum(n * (n - 1) / 2), F.sum(n)).first()
    passes = max(1, math.ceil((wedges or 0) / (WEDGES * (size or 1))))
    total = None
    for i in range(passes):
        mine = lambda c: F.pmod(F.xxhash64(c), F.lit(passes)) == i  # noqa: E731, B023
        sent = lists.select("a", "out", F.posexplode("out").alias("k", "b")).where((F.col("k") + 1 < F.size("out")) & mine("b"))
        met = sent.select("a", "b", F.expr("slice(out, k + 2, size(out))").alias("rest")).join(lists.where(mine("a")).toDF("b", "out"), "b")
        closed = met.select("a", "b", F.explode(F.array_intersect("rest", "out")).alias("c"))
        part = cut_lineage(closed.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")))
        total = part if total is None else total.union(part)
    return total.groupBy("node").agg(F.sum("n").alias("n"))


def level_densities(values: DataFrame, levels: list[list[str]], value: str, at_least: int) -> DataFrame:
    """Statistics per key at every level of a hierarchy (exact keys first), for groups of more than
    ``at_least`` values: one pass over grouping sets of keys."""
    keys = list(dict.fromkeys(k for level in levels for k in level))
    out = None
    for i, level in enumerate(levels):
        g = values.groupBy(*level).agg(F.count(value).alias("n"), F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd")).where(F.col("n") > at_least)
        g = g.select(F.lit(i).alias("level"), *[F.col(k) if k in level else F.lit(None).cast(dict(values.dtypes)[k]).alias(k) for k in keys], "n", "mu", "sd")
        out = g if out is None else out.unionByName(g)
    return out


def with_fallback(rows: DataFrame, models: DataFrame, levels: list[list[str]], take: list[str]) -> DataFrame:
    """For each row the model of the most exact level that has one; ``level`` is null where none has."""
    out = rows
    for i, level in enumerate(levels):
        m = models.where(F.col("level") == i).select(*level, F.struct(F.lit(i).alias("level"), *take).alias(f"__m{i}"))
        out = out.join(m, level, "left")
    best = F.coalesce(*[F.col(f"__m{i}") for i in range(len(levels))])
    return out.withColumn("__b", best).select(*rows.columns, F.col("__b.level").alias("level"), *[F.col(f"__b.{t}").alias(t) for t in take])
