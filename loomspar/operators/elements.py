"""Per-element values rolled up to segments, items and profiles; selections among them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment_verdicts(elements: DataFrame, values: DataFrame, by: list[str], element: str, value: str, limit: float) -> DataFrame:
    """Per segment: whether any value is positive, none is, all are 1, and whether the mean is below a
    limit. Elements without a value count as 0; a mean over no element is null."""
    x = F.coalesce(F.col(value), F.lit(0.0))
    return elements.join(values, element, "left").groupBy(*by).agg(
        (F.sum(x) > 0).alias("any_positive"), (F.sum(x) == 0).alias("none_positive"), F.bool_and(x == 1).alias("all_one"), (F.avg(x) < limit).alias("low_mean")
    )


def summed_profile(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The columns' sum per key, null as 0: an element-wise sum of several columns in one pass."""
    return df.groupBy(*keys).agg(F.sum(sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))).alias("total"))


def positive_summary(values: Column) -> Column:
    """Mean, least and greatest of an array's positive elements; null where there is none."""
    p = F.filter(values, lambda x: x > 0)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(F.size(p) > 0, F.struct((total / F.size(p)).alias("mean"), F.array_min(p).alias("min"), F.array_max(p).alias("max")))


def zero_filled(df: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """Counts of a vocabulary's words, 0 for those that do not occur."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return vocabulary.select(column).distinct().join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def align_edges(source: DataFrame, target: DataFrame, ends: list[str], attribute: str) -> DataFrame:
    """Every target edge with the source's attribute, where the source has that edge."""
    return target.select(*ends).join(source.select(*ends, attribute, F.lit(True).alias("matched")), ends, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def pick_apart(df: DataFrame, by: str, begin: str, end: str, order: list[str]) -> DataFrame:
    """Greedy choice of intervals per group: in the given order (all ascending), each that overlaps none
    chosen before. Groups are single items with their fragments, which fit a row."""
    every = [*order, *[c for c in df.columns if c not in order and c != by]]
    sorted_ = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*every))).alias("f"))
    meets = lambda x: lambda y: (x[begin] < y[end]) & (y[begin] < x[end])
    none = F.slice("f", 1, 0)
    kept = F.aggregate("f", none, lambda acc, x: F.when(F.exists(acc, meets(x)), acc).otherwise(F.concat(acc, F.array(x))))
    return sorted_.select(by, F.explode(kept).alias("x")).select(by, "x.*").select(*df.columns)


def moments(df: DataFrame, vector: str, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance (unbiased) of a column of vectors: partial sums per batch, one row
    of fixed size each, summed in the JVM."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, np.zeros(dims), np.zeros((dims, dims))
        for f in frames:
            x = np.array([v for v in f["v"] if v is not None and len(v) == dims], float).reshape(-1, dims)
            n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        every = np.concatenate([[n], s, ss.ravel()])
        yield pd.DataFrame({"i": np.arange(len(every)), "x": every})

    rows = df.select(F.col(vector).cast("array<double>").alias("v")).mapInPandas(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # 1 + dims + dims^2 rows
    every = np.zeros(1 + dims + dims * dims)
    for r in rows:
        every[r["i"]] = r["x"]
    n, s, ss = int(every[0]), every[1 : dims + 1], every[dims + 1 :].reshape(dims, dims)
    if n == 0:
        return 0, s, ss
    return n, s / n, (ss - np.outer(s, s) / n) / max(1, n - 1)


def frechet(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> float:
    """Frechet distance (squared) of two normal laws given by their moments."""

    def root(m: np.ndarray) -> np.ndarray:
        w, v = np.linalg.eigh((m + m.T) / 2)
        return (v * np.sqrt(np.maximum(w, 0))) @ v.T

    half = root(a[2])
    return float(((a[1] - b[1]) ** 2).sum() + np.trace(a[2]) + np.trace(b[2]) - 2 * np.trace(root(half @ b[2] @ half)))


def laplacian_features(edges: DataFrame, graph: str, src: str, dst: str, k: int) -> DataFrame:
    """``(graph, node, features)``: each node's entries in the ``k`` eigenvectors of its graph's Laplacian
    after the constant one (zero-padded, the sign fixed by the greatest entry). Graphs are single items, which fit a task."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted({*f[src], *f[dst]})
        at = {n: i for i, n in enumerate(nodes)}
        m = np.zeros((len(nodes), len(nodes)))
        for a, b in zip(f[src], f[dst]):
            if a != b:
                m[at[a], at[b]] = m[at[b], at[a]] = 1
        _, v = np.linalg.eigh(np.diag(m.sum(1)) - m)
        v = v[:, 1 : k + 1] * np.where(np.take_along_axis(v, np.abs(v).argmax(0)[None], 0)[0] < 0, -1, 1)[1 : k + 1]
        out = np.zeros((len(nodes), k))
        out[:, : v.shape[1]] = v
        return pd.DataFrame({graph: f[graph].iloc[0], "node": nodes, "features": list(out)})

    kinds = dict(edges.dtypes)
    return edges.select(graph, src, dst).groupBy(graph).applyInPandas(run, f"`{graph}` {kinds[graph]}, node {kinds[src]}, features array<double>")


def rebased(df: DataFrame, by: list[str], offset: str) -> DataFrame:
    """Offsets of joined parts turned back into offsets within each part."""
    return df.withColumn(offset, F.col(offset) - F.min(offset).over(Window.partitionBy(*by)))
