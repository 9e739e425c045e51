"""Most similar sets for every set: a forest of random-projection trees.

Rows with equal sets form a class; the forest indexes classes, so copies cost nothing. Each tree
halves the space again and again by the sign of a projection on the difference of two centres
(found by 2-means from two random members, bits weighted by their inverse document frequency, cut
at the median). The upper levels are fitted on a bounded sample; levels below, which only large
catalogs need, use hash-made random projections and no fitting. Every class is indexed in its leaf
of every tree.

A search runs through all trees with one shared priority queue: a node's priority is the smallest
margin by which the query lies on its side along the path (negative where it does not), and the
leaves of highest priority are opened. As priorities only fall along a path, and one child always
keeps its node's negative priority, keeping the best ``probes`` nodes of all trees at every level
opens the same leaves as the queue would; that form runs on whole batches. Classes and the queries
that opened a leaf meet in one group per leaf, where similarities are computed exactly and the best
are kept.

The more leaves a catalog has, the fewer of them a search opens, and the more neighbours it misses. So
the best over all leaves are only a first graph: classes that share a neighbour in it are compared
exactly as well, round by round, until a round changes few entries. A missed neighbour is nearly always
a neighbour of one that was found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspar.session import cut_lineage

DIMS = 2048
TREES = 8
PROBES = 24  # leaves that a search opens, over all trees
LEAF = 256  # aimed-at classes of a leaf
SAMPLE = 16_384  # classes that the fitted levels are fitted on, at most
FITTED = 10  # fitted levels, at most
STILL = 0.002  # share of new entries of the lists at which the rounds end
HUB = 64  # neighbours of one class that are compared with each other at once


def set_classes(df: DataFrame, key: str, bits: str, dims: int = DIMS) -> DataFrame:
    """``(id, bits)``: one row per key, bits distinct and sorted; null and empty sets left out.

    Bits outside ``0 .. dims - 1`` and null bits are left out as well. Rows of one key agree in
    their set; if they do not, the one that sorts last is taken.
    """
    clean = F.array_sort(F.array_distinct(F.filter(F.col(f"`{bits}`").cast("array<int>"), lambda b: b.isNotNull() & (b >= 0) & (b < dims))))
    rows = df.select(F.col(f"`{key}`").cast("string").alias("id"), clean.alias("bits")).where(F.col("id").isNotNull() & (F.size("bits") > 0))
    return rows.groupBy("id").agg(F.max("bits").alias("bits"))


def padded(lists: list, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits as a matrix, filled up with ``dims``; and the sizes."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    out = np.full((len(lists), int(sizes.max(initial=1))), dims, np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate([np.asarray(x, np.int32) for x in lists]) if len(lists) else []
    return out, sizes


def dense(bits: np.ndarray, dims: int) -> np.ndarray:
    out = np.zeros((len(bits), dims + 1), np.float32)
    out[np.arange(len(bits))[:, None], bits] = 1
    return out[:, :dims]


def fit_tree(sample: np.ndarray, weight: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes 1 .. 2^depth - 1 of a tree: int8 weights, cuts and scales of their projections."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    ws, cut, scale = np.zeros((2**depth, dims + 1), np.int8), np.zeros(2**depth, np.float32), np.ones(2**depth, np.float32)
    groups = {1: np.arange(len(sample))}
    for node in range(1, 2**depth):
        own = groups.pop(node)
        w = rng.standard_normal(dims).astype(np.float32) * weight
        if len(own) >= 2:
            some = sample[own if len(own) <= 400 else rng.choice(own, 400, replace=False)] * weight
            a, b = some[rng.choice(len(some), 2, replace=False)]
            for _ in range(4):
                side = some @ (a - b) >= ((a**2).sum() - (b**2).sum()) / 2
                if side.all() or not side.any():
                    break
                a, b = some[side].mean(0), some[~side].mean(0)
            if np.abs(a - b).max() > 0:
                w = (a - b) * weight
        q = np.round(w / max(np.abs(w).max(), 1e-9) * 127).astype(np.int8)
        ws[node, :dims] = q
        scale[node] = max(1e-6, np.linalg.norm(q.astype(np.float32)))
        p = sample[own] @ q.astype(np.float32) if len(own) else np.zeros(0, np.float32)
        cut[node] = np.median(p) if len(p) else 0
        groups[2 * node], groups[2 * node + 1] = own[p <= cut[node]], own[p > cut[node]]
    return ws, cut, scale


class Forest:
    def __init__(self, ws: np.ndarray, cut: np.ndarray, scale: np.ndarray, weight: np.ndarray, fitted: int, depth: int):
        self.ws, self.cut, self.scale, self.fitted, self.depth = ws, cut, scale, fitted, depth
        self.weight = np.append(weight.astype(np.float32), np.float32(0))

    def margins(self, level: int, tree: np.ndarray, node: np.ndarray, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(node.shape, np.float32)
        if level < self.fitted:
            flat = (tree * self.ws.shape[1] + node) * self.ws.shape[2]
            table = self.ws.reshape(-1)
            for k in range(bits.shape[1]):
                out += table[flat + bits[:, k, None]]
            return (out - self.cut[tree, node]) / self.scale[tree, node]
        base = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (tree.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        for k in range(bits.shape[1]):
            b = bits[:, k, None]
            mixed = (base ^ (b.astype(np.uint64) * np.uint64(0x165667B19E3779F9))) * np.uint64(0xFF51AFD7ED558CCD)
            out += np.where(mixed >> np.uint64(63) == 1, self.weight[b], -self.weight[b])
        return out / np.float32(np.linalg.norm(self.weight) + 1e-9)

    def leaves(self, bits: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the leaves of highest priority, and which of them are the set's own."""
        trees = self.ws.shape[0]
        tree = np.tile(np.arange(trees), (len(bits), 1))
        node, best = np.ones_like(tree), np.full(tree.shape, np.inf, np.float32)
        for level in range(self.depth):
            m = self.margins(level, tree, node, bits)
            m = np.where(m == 0, np.float32(-1e-12), m)  # on the cut: the lower side
            best = np.concatenate([np.minimum(best, -m), np.minimum(best, m)], 1)
            node, tree = np.concatenate([2 * node, 2 * node + 1], 1), np.concatenate([tree, tree], 1)
            if best.shape[1] > probes:
                keep = np.argpartition(-best, probes - 1, axis=1)[:, :probes]
                best, node, tree = (np.take_along_axis(x, keep, 1) for x in (best, node, tree))
        return tree.astype(np.int64) << np.int64(40) | node, best > 0


def fit_forest(classes: DataFrame, n: int, dims: int, trees: int, leaf: int, sample: int, seed: int = 5) -> Forest:
    """Weights from all classes, fitted levels from a hash-ordered sample of at most ``sample``; each
    tree is fitted in a task of its own."""
    spark = classes.sparkSession
    depth = min(30, max(0, math.ceil(math.log2(max(1, n) / leaf))))
    fitted = min(depth, FITTED)
    counts = classes.select(F.explode("bits").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()  # at most dims rows
    df = np.ones(dims)
    for r in counts:
        df[r["b"]] = r["n"]
    weight = np.log(1 + n / df).astype(np.float32)
    if fitted == 0:
        return Forest(np.zeros((trees, 1, dims + 1), np.int8), np.zeros((trees, 1), np.float32), np.ones((trees, 1), np.float32), weight, 0, depth)
    some = classes.select("bits").orderBy(F.xxhash64("bits", F.lit(seed)), "bits").limit(sample).collect()  # bounded by the sample
    sent = spark.sparkContext.broadcast(padded([r["bits"] for r in some], dims)[0].astype(np.int16))

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for t in frame["id"]:
                ws, cut, scale = fit_tree(dense(sent.value.astype(np.int32), dims), weight, fitted, seed + int(t))
                yield pd.DataFrame({"t": [t], "ws": [ws.tobytes()], "cut": [cut.tobytes()], "scale": [scale.tobytes()]})

    rows = sorted(spark.range(0, trees, 1, trees).mapInPandas(fit, "t bigint, ws binary, cut binary, scale binary").collect(), key=lambda r: r["t"])
    part = lambda name, kind, *shape: np.stack([np.frombuffer(r[name], kind).reshape(shape) for r in rows])
    return Forest(part("ws", np.int8, 2**fitted, dims + 1), part("cut", np.float32, 2**fitted), part("scale", np.float32, 2**fitted), weight, fitted, depth)


def rank_leaf(table: pa.Table, dims: int, k: int, least: float) -> pa.Table:
    """Exact similarities of a leaf's queries with its members: the best ``k`` of each query."""
    table = table.sort_by("c")
    cls = table.column("c").to_numpy()
    raw = table.column("bits").to_pylist()
    bits, sizes = padded([np.frombuffer(x, np.int16) for x in raw], dims)
    member = np.flatnonzero(table.column("own").to_numpy(zero_copy_only=False))
    out_q, out_c, out_s = [], [], []
    if len(member):
        inside = dense(bits[member], dims)
        for at in range(0, len(cls), 2048):
            query = slice(at, min(at + 2048, len(cls)))
            both = dense(bits[query], dims) @ inside.T
            sim = both / (sizes[query][:, None] + sizes[member][None] - both).astype(np.float64)
            sim[cls[query][:, None] == cls[member][None]] = -1
            score = sim - np.arange(len(member)) * 1e-13  # members are in order of their ids
            best = np.argpartition(-score, k - 1, axis=1)[:, :k] if len(member) > k else np.tile(np.arange(len(member)), (len(sim), 1))
            top = np.take_along_axis(sim, best, 1)
            q, j = np.nonzero(top >= least)
            out_q.append(cls[query][q])
            out_c.append(cls[member][best[q, j]])
            out_s.append(top[q, j])
    flat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
    return pa.table({"c": flat(out_q, pa.int64()), "other": flat(out_c, pa.int64()), "sim": flat(out_s, pa.float64())})


def rank_around(table: pa.Table, dims: int, least: float) -> pa.Table:
    """Exact similarities of the members ``c`` around each ``m`` with each other; around a class with more
    than ``HUB`` members those of successive numbers are compared."""
    table = table.sort_by([("m", "ascending"), ("c", "ascending")])
    m, c = table.column("m").to_numpy(), table.column("c").to_numpy()
    bits, sizes = padded(table.column("bits").to_pylist(), dims)
    flat = np.zeros((len(c), -(-dims // 64) * 64 + 64), bool)
    flat[np.arange(len(c))[:, None], bits] = True
    flat[:, dims:] = False
    packed = np.packbits(flat, axis=1).view(np.uint64)
    starts = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
    degrees = np.diff(np.append(starts, len(m)))
    cuts = np.concatenate([np.arange(0, d, HUB) + at for at, d in zip(starts, degrees)])
    many = np.diff(np.append(cuts, len(m)))
    pairs = []
    for d in np.unique(many):
        i, j = np.triu_indices(d, 1)
        at = cuts[many == d][:, None]
        pairs.append(np.stack([(at + i).reshape(-1), (at + j).reshape(-1)]))
    i, j = np.concatenate(pairs, 1)
    _, some = np.unique(np.stack([c[i], c[j]]), axis=1, return_index=True)
    i, j = i[some], j[some]
    both = np.concatenate([np.bitwise_count(packed[i[k : k + 50_000]] & packed[j[k : k + 50_000]]).sum(1, dtype=np.int64) for k in range(0, max(1, len(i)), 50_000)])
    sim = both / (sizes[i] + sizes[j] - both).astype(np.float64)
    near = sim >= least
    a, b, sim = c[i][near], c[j][near], sim[near]
    return pa.table({"c": pa.array(np.concatenate([a, b]), pa.int64()), "other": pa.array(np.concatenate([b, a]), pa.int64()), "sim": pa.array(np.concatenate([sim, sim]), pa.float64())})


def best_of(rows: DataFrame, k: int) -> DataFrame:
    return rows.groupBy("c").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("sim")).alias("away"), "other"))), 1, k).alias("best"))


def refined(near: DataFrame, classes: DataFrame, n: int, k: int, least: float, dims: int) -> DataFrame:
    """``near`` after rounds in which classes that share a neighbour are compared."""
    entries = lambda lists: lists.select("c", F.explode("best").alias("b")).select("c", F.col("b.other").alias("other"), (-F.col("b.away")).alias("sim"))
    while True:
        known = entries(near)
        edges = known.select(F.col("c").alias("m"), F.col("other").alias("c")).union(known.select(F.col("other").alias("m"), "c")).distinct()
        around = edges.join(classes.select("c", "bits"), "c").groupBy(F.pmod(F.xxhash64("m"), F.lit(max(1, n // 1000))).alias("part"))
        met = around.applyInArrow(lambda t: rank_around(t, dims, least), "c bigint, other bigint, sim double")
        near = cut_lineage(best_of(known.union(met), k))
        new, every = entries(near).join(known, ["c", "other"], "left_anti").count(), known.count()
        if new <= STILL * every:
            return near


def similar_classes(classes: DataFrame, n: int, k: int, least: float, dims: int = DIMS, trees: int = TREES, probes: int = PROBES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """``(c, best)``: for each class the ``k`` most similar other classes, ``best`` an array of
    ``(away, other)`` with ``away = -similarity``; equal ones by smaller class number."""
    forest = classes.sparkSession.sparkContext.broadcast(fit_forest(classes, n, dims, trees, leaf, sample))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Forest = forest.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                bits, sizes = padded(part.column("bits").to_pylist(), dims)
                leaves, own = f.leaves(bits, probes)
                packed = np.array([row[:s].astype(np.int16).tobytes() for row, s in zip(bits, sizes)], object)
                of = np.repeat(np.arange(len(bits)), leaves.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaves.reshape(-1)), pa.array(part.column("c").to_numpy()[of]), pa.array(own.reshape(-1)), pa.array(packed[of], pa.binary())],
                    names=["leaf", "c", "own", "bits"],
                )

    routed = classes.select("c", "bits").mapInArrow(route, "leaf bigint, c bigint, own boolean, bits binary")
    near = routed.groupBy("leaf").applyInArrow(lambda t: rank_leaf(t, dims, k, least), "c bigint, other bigint, sim double")
    return refined(cut_lineage(best_of(near, k)), classes, n, k, least, dims)


def nearest_pairs(df: DataFrame, key: str, bits: str, k: int = 5, least: float = 0.5, dims: int = DIMS, **forest: int) -> DataFrame:
    """``(id_a, id_b, similarity)``, id_a < id_b: pairs of keys of which one has the other among its
    ``k`` most similar (Jaccard similarity of at least ``least``; equal ones by smaller key).

    Null and empty sets are left out, repeated rows count once. Copies of a set are expanded only to
    the pairs that belong to the result (at most ``k`` per key). Empty tables give an empty result;
    further columns do not matter.
    """
    rows = set_classes(df, key, bits, dims)
    rows = cut_lineage(rows.withColumn("set", F.array_join("bits", ",")))
    named = rows.groupBy("set").agg(F.min("id").alias("first"), F.any_value("bits").alias("bits"), F.count(F.lit(1)).alias("size"))
    # numbers in the order of the smallest keys: a sorted write fixes them
    classes = cut_lineage(named.orderBy("first").withColumn("c", F.monotonically_increasing_id()))
    near = similar_classes(classes.select("c", "bits"), classes.count(), k, least, dims, **forest)
    w = Window.partitionBy("set").orderBy("id")
    firsts = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("set").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    ids = classes.join(firsts, "set").select("c", "set", "ids", "size")
    entry = lambda sim, names: F.transform(names, lambda i: F.struct(sim.alias("away"), i.alias("id")))
    others = (
        near.select("c", F.explode("best").alias("b")).select("c", F.col("b.away").alias("away"), F.col("b.other").alias("other"))
        .join(ids.select(F.col("c").alias("other"), "ids"), "other")
        .groupBy("c").agg(F.flatten(F.collect_list(entry(F.col("away"), F.col("ids")))).alias("o"))
    )
    ranked = ids.join(others, "c", "left").select("set", F.array_sort(F.concat(entry(F.lit(-1.0), F.col("ids")), F.coalesce("o", F.array().cast("array<struct<away:double,id:string>>")))).alias("r"))
    ranked = ranked.select("set", F.slice("r", 1, k + 1).alias("r"))  # the key itself is at most one of them
    each = rows.select("set", "id").join(ranked, "set").select("id", F.explode(F.slice(F.filter("r", lambda x: x["id"] != F.col("id")), 1, k)).alias("x"))
    pairs = each.select(F.least("id", "x.id").alias("id_a"), F.greatest("id", "x.id").alias("id_b"), (-F.col("x.away")).alias("similarity"))
    return pairs.where(F.col("similarity") >= least).distinct()
