"""Route search over a rule hypergraph, traces, and verification by replay."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspar.session import cut_lineage

TRACE_STEPS = "array<struct<depth:int,rule:string,product:string,parts:array<string>>>"


def find_routes(targets: DataFrame, edges: DataFrame, leaves: DataFrame, depth: int, k: int) -> DataFrame:
    """Best routes by depth-limited AND/OR search: ``(node, cost, trace)``, at most ``k`` per target.

    ``edges``: ``(product, rule, parts array<string>)``; a node is solved if it is a leaf (cost 0) or if
    some rule's parts are all solved within the depth left; cost counts the steps. The frontier of nodes
    is expanded level by level (distinct, so shared nodes are expanded once), then routes are combined
    from the deepest level up; each node keeps its ``k`` cheapest (ties by trace). Parts solved at
    different cost combine freely, up to three parts; rules of more parts are not searched. A route never
    makes its own product on the way, however deep: since a route through a product costs more than that
    product's own, the cheapest of a node is never among those left out.
    """
    leaf = leaves.select("node").distinct().withColumn("leaf", F.lit(True))
    levels, front = [], targets.select("node").distinct()
    for _ in range(depth):
        used = cut_lineage(front.join(edges, front["node"] == edges["product"]).select("product", "rule", "parts").where(~F.array_contains("parts", F.col("product"))))
        levels.append(used)
        front = used.select(F.explode("parts").alias("node")).distinct().join(leaf.select("node"), "node", "left_anti")
    solved = None
    for used in reversed(levels):
        known = leaf.select("node", F.lit(0).alias("cost"), F.concat(F.lit("<"), F.col("node"), F.lit(">")).alias("trace"))
        if solved is not None:
            known = known.unionByName(solved.join(leaf.select("node"), "node", "left_anti"))
        rows = used.withColumn("n", F.size("parts")).where("n between 1 and 3").withColumns({"cost": F.lit(1), "traces": F.array().cast("array<string>")})
        for i in range(3):
            part = known.withColumnsRenamed({"node": f"p{i}", "cost": f"c{i}", "trace": f"t{i}"})
            hit = rows.withColumn(f"p{i}", F.get("parts", F.lit(i))).join(part, f"p{i}", "left")
            rows = hit.where((F.col("n") <= i) | F.col(f"c{i}").isNotNull()).select(
                "product", "rule", "parts", "n", (F.col("cost") + F.coalesce(f"c{i}", F.lit(0))).alias("cost"),
                F.when(F.col("n") > i, F.concat("traces", F.array(f"t{i}"))).otherwise(F.col("traces")).alias("traces"),
            )
        again = F.concat(F.lit(":"), "product", F.lit(">"))
        rows = rows.where(~F.exists("traces", lambda t: F.contains(t, again)))
        built = rows.select(F.col("product").alias("node"), "cost", F.concat(F.lit("<"), F.array_join("traces", "."), F.lit(":"), "rule", F.lit(":"), F.col("product"), F.lit(">")).alias("trace")).distinct()
        best = F.row_number().over(Window.partitionBy("node").orderBy("cost", "trace"))
        solved = cut_lineage(built.withColumn("r", best).where(F.col("r") <= k).drop("r"))
    none = F.lit(None)
    own = targets.select("node").distinct().join(leaf, "node", "left_semi").select("node", F.lit(0).alias("cost"), F.concat(F.lit("<"), "node", F.lit(">")).alias("trace"))
    found = own if solved is None else own.unionByName(solved.join(leaf.select("node"), "node", "left_anti"))
    return targets.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("cost", none.cast("int")).alias("cost"), "trace")


def deepen(targets: DataFrame, edges: DataFrame, leaves: DataFrame, depths: list[int], k: int) -> DataFrame:
    """Iterative deepening: ``(node, depth, cost, trace)``; each depth searches only the targets that no
    smaller one solved, and those that none solves have null depth and cost."""
    todo, found = targets.select("node").distinct(), []
    for depth in depths:
        got = cut_lineage(find_routes(todo, edges, leaves, depth, k).where("cost is not null").withColumn("depth", F.lit(depth)))
        found.append(got)
        todo = cut_lineage(todo.join(got.select("node").distinct(), "node", "left_anti"))
        if todo.isEmpty():
            break
    solved = reduce(DataFrame.unionByName, found)
    return targets.select("node").distinct().join(solved, "node", "left").select("node", "depth", "cost", "trace")


def parse_one(trace: str | None) -> list[dict]:
    """Steps of a trace, children first: brackets nest, rule and product are the last two ``:`` parts."""
    if not trace:
        return []
    steps: list[dict] = []
    stack: list[list[str]] = [[]]
    text: list[str] = [""]
    for c in trace:
        if c == "<":
            stack.append([])
            text.append("")
        elif c == ">" and len(stack) > 1:
            own, parts = text.pop(), stack.pop()
            pieces = own.rsplit(":", 2)
            if len(pieces) == 3:
                name = pieces[2]
                steps.append({"depth": len(stack) - 1, "rule": pieces[1], "product": name, "parts": parts})
            else:
                name = own
            stack[-1].append(name)
        else:
            text[-1] += c
    return steps


def parse_traces(df: DataFrame, key: str, trace: str) -> DataFrame:
    """``(key, i, depth, rule, product, parts)``: the steps of each trace in post-order."""
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"k": f["k"], "steps": [parse_one(t) for t in f["t"]]})

    steps = df.select(F.col(key).alias("k"), F.col(trace).alias("t")).mapInPandas(run, f"k {kind}, steps {TRACE_STEPS}")
    return steps.select(F.col("k").alias(key), F.posexplode("steps").alias("i", "s")).select(key, "i", "s.*")


def replay(steps: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Verdict per route: every step must be an edge of the table with the same parts and product.
    ``(key, n_steps, n_bad, reason)``, reason ``unknown_rule`` or ``product_mismatch`` of the first bad step."""
    signature = lambda p: F.array_join(F.array_sort(p), ".")
    made = edges.select("rule", signature("parts").alias("sig"), F.col("product").alias("made")).distinct()
    rules = edges.select("rule").distinct().withColumn("known", F.lit(True))
    rows = steps.withColumn("sig", signature("parts")).join(rules, "rule", "left").join(made, ["rule", "sig"], "left")
    ok = F.coalesce(F.col("made") == F.col("product"), F.lit(False))
    per = rows.groupBy(key, "i").agg(F.max(ok).alias("ok"), F.max(F.coalesce("known", F.lit(False))).alias("known"))
    why = F.when(F.col("ok"), None).when(~F.col("known"), "unknown_rule").otherwise("product_mismatch")
    return per.groupBy(key).agg(F.count(F.lit(1)).alias("n_steps"), F.count_if(~F.col("ok")).alias("n_bad"), F.min_by(why, F.when(~F.col("ok"), F.col("i"))).alias("reason"))
