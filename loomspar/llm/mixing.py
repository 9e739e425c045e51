"""Mixing sources to target weights with a cap on repeats.

The plan of a mix is exact: every source's quota is fixed first, and a *splitting tree* hands the
quotas out to output shards. Each tree node holds the quotas of a range of shards; its left half
draws its part from the node by a multivariate hypergeometric distribution, the right half keeps
the rest. So every shard is as random as if all records had been shuffled, while each source's
total stays what it was, and no node needs anything but its own quotas and a seed made from its
place in the tree: lost tasks repeat to the same result.

A shard then takes, from each source, the next run of that source's permuted sequence: the source's
records lie in blocks (by hash of their id), the blocks follow each other in an order drawn for
each mix and pass over the source, and a record is repeated only when a pass begins again. Runs of
different shards are disjoint, so no record occurs more than ``max_repeats`` times. Within a shard
the records are put in a random order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspar.llm.items import path_key, split_name
from loomspar.session import cut_lineage

BLOCK_ROWS = 4096  # aimed-at records of a source block
SHARD_SIZE = 1024  # aimed-at samples of an output shard
SUBTREE = 4096  # shards of a node that is finished in one task


def source_blocks(items: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(source, split, block, block_n, n_records)``: the records of each source in blocks of bounded size.

    A record counts once however often it was delivered. Records without source or split belong to
    no source. Counting is per source and hash bucket, so no task sees a whole source.
    """
    placed = placed_items(items, block_rows)
    sizes = placed.groupBy("source", "split", "block").agg(F.count(F.lit(1)).alias("block_n"))
    w = Window.partitionBy("source", "split")
    return sizes.withColumn("n_records", F.sum("block_n").over(w))


def distinct_items(items: DataFrame) -> DataFrame:
    rows = items.select(F.col("item_id").alias("item_id"), path_key(F.col("datadir")).alias("source"), split_name(F.col("split")).alias("split"))
    return rows.where(F.col("item_id").isNotNull() & F.col("source").isNotNull() & F.col("split").isNotNull()).distinct()


def source_sizes(items: DataFrame) -> DataFrame:
    """``(source, split, n_records)``; the distinct records are counted map-side after one shuffle by record."""
    return distinct_items(items).groupBy("source", "split").agg(F.count(F.lit(1)).alias("n_records"))


def placed_items(items: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every record with its source block; the number of blocks follows the size of the source."""
    distinct = distinct_items(items)
    blocks = source_sizes(items).select("source", "split", F.ceil(F.col("n_records") / block_rows).alias("n_blocks"))
    return distinct.join(blocks, ["source", "split"]).withColumn("block", F.pmod(F.xxhash64("item_id", F.lit(7)), F.col("n_blocks"))).drop("n_blocks")


def mix_entries(mixes: DataFrame) -> DataFrame:
    """One row per entry of each mix: ``mix_id, dataset_pos, source, split, weight, weight_sum, epoch, max_repeats``.

    A redelivered mix counts once (the last load). Null weights mean equal weights, a null or NaN
    weight is 0. Mixes with a null or zero epoch, weights of another number than datasets, or
    weights that sum to 0 have no entries.
    """
    cols = ["stage", "datasets", "weights", "num_samples_per_epoch_per_gpu", "max_repeats"]
    once = (
        mixes.where(F.col("mix_id").isNotNull())
        .groupBy("mix_id")
        .agg(F.max(F.struct("ingested_at", *cols)).alias("m"))
        .select("mix_id", *[F.col(f"m.{c}").alias(c) for c in cols])
    )
    exact = lambda w: F.coalesce(F.when(F.isnan(w), F.lit(0.0)).otherwise(w), F.lit(0.0)).cast("decimal(24,9)")
    weights = F.when(F.col("weights").isNull(), F.transform("datasets", lambda _: F.lit(1).cast("decimal(24,9)"))).otherwise(F.transform("weights", exact))
    ok = once.withColumn("w", weights).where((F.col("num_samples_per_epoch_per_gpu") > 0) & (F.size("datasets") == F.size("w")))
    total = F.aggregate("w", F.lit(0).cast("decimal(34,9)"), lambda a, x: (a + x).cast("decimal(34,9)"))
    rows = ok.withColumn("weight_sum", total).where(F.col("weight_sum") > 0)
    return rows.select(
        "mix_id", F.posexplode(F.arrays_zip("datasets", "w")).alias("dataset_pos", "e"), split_name(F.col("stage")).alias("split"), "weight_sum",
        F.col("num_samples_per_epoch_per_gpu").cast("bigint").alias("epoch"), F.col("max_repeats").cast("bigint").alias("max_repeats"),
    ).select("mix_id", "dataset_pos", path_key(F.col("e.datasets")).alias("source"), "split", F.col("e.w").alias("weight"), "weight_sum", "epoch", "max_repeats")


def entry_quotas(entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Entries with ``n_records``, whether their target is beyond the cap (``over``), and whole ``quota``.

    ``over``: epoch x weight > max_repeats x records x sum of weights, compared exactly in decimals.
    The quotas of a mix are its targets rounded by largest remainder, then cut to the cap; entries
    that share a source share its cap in order of their place. What a capped source cannot give is
    not made up from others: the shares reached are reported instead. A null cap caps nothing.
    """
    rows = entries.join(sizes, ["source", "split"], "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)))
    product = (F.col("epoch").cast("decimal(20,0)") * F.col("weight").cast("decimal(18,9)")).cast("decimal(38,9)")
    cap = F.col("max_repeats") * F.col("n_records")
    bound = (cap.cast("decimal(18,0)") * F.col("weight_sum").cast("decimal(19,9)")).cast("decimal(38,9)")
    rows = rows.withColumn("over", F.coalesce(product > bound, F.lit(False))).withColumn("target", F.round(F.col("epoch") * (F.col("weight") / F.col("weight_sum")).cast("double"), 6))
    whole = F.floor("target")
    by_rest = Window.partitionBy("mix_id").orderBy(F.round(F.col("target") - whole, 6).desc(), "dataset_pos")
    spare = F.col("epoch") - F.sum(whole).over(Window.partitionBy("mix_id"))
    rows = rows.withColumn("wish", whole + F.when(F.row_number().over(by_rest) <= spare, 1).otherwise(0))
    earlier = Window.partitionBy("mix_id", "source").orderBy("dataset_pos").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.least(F.coalesce(F.sum("wish").over(earlier), F.lit(0)), cap)
    limited = F.when(F.col("max_repeats").isNull(), F.when(F.col("n_records") > 0, F.col("wish")).otherwise(0)).otherwise(F.least(F.col("wish"), cap - taken))
    return rows.withColumn("quota", limited.cast("bigint")).withColumn("source_start", F.when(F.col("max_repeats").isNull(), F.coalesce(F.sum("wish").over(earlier), F.lit(0))).otherwise(taken).cast("bigint"))


def node_rng(*place: int) -> np.random.Generator:
    digest = hashlib.blake2b(np.array(place, dtype=np.int64).tobytes(), digest_size=16).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(digest, "little")))


def log_factorial_step(a: int, b: int) -> float:
    """``log(a!) - log(b!)`` without the cancellation that the difference of two large values has."""
    if min(a, b) < 256:
        return math.lgamma(a + 1) - math.lgamma(b + 1)
    x, y, d = a + 1.0, b + 1.0, float(a - b)
    tail = lambda v: 1 / (12 * v) - 1 / (360 * v**3)
    return d * math.log(y) + (x - 0.5) * math.log1p(d / y) - d + tail(x) - tail(y)


def draw_good(rng: np.random.Generator, good: int, bad: int, size: int) -> int:
    """How many of ``size`` draws without replacement are good: hypergeometric at any size of the
    counts, by the ratio of uniforms with the probability taken relative to its mode."""
    total = good + bad
    if size == 0 or good == 0:
        return 0
    if bad == 0 or size == total:
        return min(good, size)
    few, draws = min(good, bad), min(size, total - size)
    share = few / total
    centre = draws * share + 0.5
    spread = math.sqrt((total - draws) * draws * share * (1 - share) / (total - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    mode = (draws + 1) * (few + 1) // (total + 2)
    most = min(draws, few)
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        x = centre + width * (v - 0.5) / u
        if not 0 <= x < most + 1:
            continue
        k = int(x)
        other = total - few - draws
        weight = log_factorial_step(mode, k) + log_factorial_step(few - mode, few - k) + log_factorial_step(draws - mode, draws - k) + log_factorial_step(other + mode, other + k)
        if 2 * math.log(u) <= weight:
            break
    k = k if good <= bad else draws - k
    return k if size == draws else good - k


def draw_part(rng: np.random.Generator, quotas: np.ndarray, size: int) -> np.ndarray:
    """How many of ``size`` draws without replacement come from each source: multivariate
    hypergeometric, source after source."""
    rest, left = int(quotas.sum()), max(0, size)
    out = np.zeros_like(quotas)
    for i, q in enumerate(map(int, quotas)):
        out[i] = n = q if left >= rest else draw_good(rng, q, rest - q, left)
        rest -= q
        left -= n
    return out


def shard_start(k: int, n_shards: int, total: int) -> int:
    return k * total // n_shards


def split_node(mix: int, lo: int, hi: int, n_shards: int, total: int, quotas: np.ndarray, offsets: np.ndarray, seed: int, stop: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Tree nodes of at most ``stop`` shards below this one: ``(lo, hi, quotas, offsets)``."""
    stack = [(lo, hi, quotas, offsets)]
    while stack:
        a, b, q, o = stack.pop()
        if b - a <= stop:
            yield a, b, q, o
            continue
        mid = (a + b) // 2
        left = draw_part(node_rng(seed, mix, a, b), q, shard_start(mid, n_shards, total) - shard_start(a, n_shards, total))
        stack.append((mid, b, q - left, o + left))
        stack.append((a, mid, left, o))


_NODE = "mix_id bigint, n_shards bigint, total bigint, lo bigint, hi bigint, quotas array<bigint>, offsets array<bigint>"


def _split(frames: Iterator[pd.DataFrame], seed: int, stop: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for r in frame.itertuples(index=False):
            node = split_node(r.mix_id, r.lo, r.hi, r.n_shards, r.total, np.array(r.quotas, np.int64), np.array(r.offsets, np.int64), seed, stop)
            out += [(r.mix_id, r.n_shards, r.total, a, b, q.tolist(), o.tolist()) for a, b, q, o in node]
        yield pd.DataFrame(out, columns=["mix_id", "n_shards", "total", "lo", "hi", "quotas", "offsets"])


def shard_quotas(quotas: DataFrame, shard_size: int = SHARD_SIZE, seed: int = 17) -> DataFrame:
    """The splitting tree: ``(mix_id, shard, dataset_pos, n, offset)`` for every shard and entry with n > 0.

    ``offset`` counts the entry's samples in earlier shards. The tree is split in two steps, first
    down to nodes of ``SUBTREE`` shards, which then spread over the cluster: a single huge mix is no
    single task.
    """
    rows = quotas.where(F.col("quota") > 0).groupBy("mix_id").agg(F.array_sort(F.collect_list(F.struct("dataset_pos", "quota"))).alias("e"), F.sum("quota").alias("total"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("total") / shard_size)).cast("bigint")
    roots = rows.select("mix_id", shards.alias("n_shards"), "total", F.lit(0).cast("bigint").alias("lo"), shards.alias("hi"), F.col("e.quota").alias("quotas"), F.transform("e", lambda _: F.lit(0).cast("bigint")).alias("offsets"))
    places = rows.select(F.col("mix_id"), F.col("e.dataset_pos").alias("places"))
    top = roots.mapInPandas(lambda it: _split(it, seed, SUBTREE), _NODE)
    parts = int(quotas.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, else small rows would be drawn in one task
    leaves = top.repartition(parts, "mix_id", "lo").mapInPandas(lambda it: _split(it, seed, 1), _NODE)
    drawn = leaves.join(places, "mix_id").select("mix_id", F.col("lo").alias("shard"), F.explode(F.arrays_zip("places", "quotas", "offsets")).alias("d"))
    return drawn.select("mix_id", "shard", F.col("d.places").alias("dataset_pos"), F.col("d.quotas").alias("n"), F.col("d.offsets").alias("offset")).where(F.col("n") > 0)


def mix_report(mixes: DataFrame, items: DataFrame, shard_size: int = SHARD_SIZE, seed: int = 17) -> DataFrame:
    """One row per entry of every mix: target, cap, and what the shards of the splitting tree drew.

    ``mix_id, dataset_pos, source, split, n_records, target, over, drawn, n_shards, share_wanted, share_reached``.
    Works on empty tables (no rows); further columns are ignored; see ``mix_entries`` for dirty mixes.
    """
    quotas = cut_lineage(entry_quotas(mix_entries(mixes), source_sizes(items)))  # one row per entry; the items are read once
    drawn = shard_quotas(quotas, shard_size, seed).groupBy("mix_id", "dataset_pos").agg(F.sum("n").alias("drawn"), F.count(F.lit(1)).alias("n_shards"))
    drawn = cut_lineage(drawn)  # else a reader that needs only columns of the quotas would skip the draws
    rows = quotas.join(drawn, ["mix_id", "dataset_pos"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    in_mix = F.sum("drawn").over(Window.partitionBy("mix_id"))
    return rows.select(
        "mix_id", "dataset_pos", "source", "split", "n_records", "target", "over", "drawn", F.coalesce("n_shards", F.lit(0)).alias("n_shards"),
        (F.col("weight") / F.col("weight_sum")).cast("double").alias("share_wanted"), F.when(in_mix > 0, F.col("drawn") / in_mix).alias("share_reached"),
    )


def block_draws(mixes: DataFrame, items: DataFrame, block_rows: int = BLOCK_ROWS, shard_size: int = SHARD_SIZE, seed: int = 17) -> DataFrame:
    """The mix as runs of blocks: ``(mix_id, shard, dataset_pos, source, split, pass, block, lo, hi)``.

    The run takes the records ``lo <= rank < hi`` of the block in the given pass over the source.
    """
    quotas = cut_lineage(entry_quotas(mix_entries(mixes), source_sizes(items)))  # one row per entry; the items are read once
    blocks = source_blocks(items, block_rows).drop("n_records")
    used = quotas.where(F.col("quota") > 0).select("mix_id", "dataset_pos", "source", "split", "n_records", "source_start", "quota")
    passes = used.groupBy("mix_id", "source", "split", "n_records").agg(F.max(F.col("source_start") + F.col("quota")).alias("end"))
    each = passes.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("end") - 1) / F.col("n_records")))))
    order = Window.partitionBy("mix_id", "source", "split", "pass").orderBy(F.xxhash64("mix_id", "source", "pass", "block", F.lit(seed)), "block")
    placed = each.join(blocks, ["source", "split"]).withColumn(
        "b_lo", F.col("pass") * F.col("n_records") + F.coalesce(F.sum("block_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    runs = shard_quotas(quotas, shard_size, seed).join(used, ["mix_id", "dataset_pos"]).withColumn("r_lo", F.col("source_start") + F.col("offset")).withColumn("r_hi", F.col("source_start") + F.col("offset") + F.col("n"))
    # both are intervals of one sequence: they meet in the stretches of block_rows that both touch, and count in the first of these
    stretch = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / block_rows), F.floor((F.col(hi) - 1) / block_rows)))
    runs = runs.withColumn("stretch", stretch("r_lo", "r_hi"))
    placed = placed.drop("n_records", "end").withColumn("b_hi", F.col("b_lo") + F.col("block_n")).withColumn("stretch", stretch("b_lo", "b_hi"))
    met = runs.join(placed, ["mix_id", "source", "split", "stretch"]).where(
        (F.col("r_lo") < F.col("b_hi")) & (F.col("r_hi") > F.col("b_lo")) & (F.col("stretch") == F.floor(F.greatest("r_lo", "b_lo") / block_rows))
    )
    return met.select(
        "mix_id", "shard", "dataset_pos", "source", "split", "pass", "block",
        F.greatest(F.col("r_lo") - F.col("b_lo"), F.lit(0)).alias("lo"), F.least(F.col("r_hi") - F.col("b_lo"), F.col("block_n")).alias("hi"),
    )


def draw_mix(mixes: DataFrame, items: DataFrame, block_rows: int = BLOCK_ROWS, shard_size: int = SHARD_SIZE, seed: int = 17) -> DataFrame:
    """The mix itself: ``(mix_id, shard, pos, dataset_pos, item_id)``, ``pos`` being the random order in the shard.

    Blocks and shards are arrays of bounded size: a run is cut out of its block where they meet, and
    a shard is put in order where its runs meet, so records are moved once, as plain ids.
    """
    ranked = F.array_sort(F.collect_list(F.struct(F.xxhash64("item_id", F.lit(seed)).alias("h"), "item_id")))
    blocks = placed_items(items, block_rows).groupBy("source", "split", "block").agg(ranked.alias("b")).select("source", "split", "block", F.col("b.item_id").alias("ids"))
    runs = block_draws(mixes, items, block_rows, shard_size, seed)
    cut = F.slice("ids", F.col("lo").cast("int") + 1, (F.col("hi") - F.col("lo")).cast("int"))
    taken = runs.join(blocks, ["source", "split", "block"]).select("mix_id", "shard", F.struct("dataset_pos", "pass", cut.alias("ids")).alias("run"))
    place = lambda r, i: F.xxhash64("mix_id", "shard", i, r["pass"], r["dataset_pos"], F.lit(seed))
    each = lambda r: F.transform(r["ids"], lambda i: F.struct(place(r, i).alias("h"), i.alias("item_id"), r["pass"].alias("pass"), r["dataset_pos"].alias("dataset_pos")))
    shards = taken.groupBy("mix_id", "shard").agg(F.collect_list("run").alias("runs")).select("mix_id", "shard", F.sort_array(F.flatten(F.transform("runs", each))).alias("d"))
    return shards.select("mix_id", "shard", F.posexplode("d").alias("pos", "d")).select("mix_id", "shard", "pos", F.col("d.dataset_pos").alias("dataset_pos"), F.col("d.item_id").alias("item_id"))
