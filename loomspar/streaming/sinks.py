"""Structured Streaming: incremental sinks, history deduplication, stateful batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def append_results(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Results of each micro-batch appended as parquet. A batch that is repeated after a failure
    replaces its own folder, so rows come once."""

    def write(df: DataFrame, batch: int) -> None:
        each(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """Each key's first row; state is dropped once the watermark has passed."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))


def packed_batches(stream: DataFrame, by: str, size: str, budget: int, order: str) -> DataFrame:
    """Batches of a budget: rows join the open batch of their group until the next would exceed it; the
    open batch is carried between micro-batches. Rows larger than the budget form a batch alone. Within a
    micro-batch a group's rows are taken in order of ``order``, so that packing can be repeated."""

    def pack(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, load = state.get if state.exists else (0, 0)
        out = []
        for n in pd.concat(list(frames)).sort_values(list(dict.fromkeys([order, size])))[size]:
            n = int(n)
            if load and load + n > budget:
                batch, load = batch + 1, 0
            load += n
            out.append((key[0], batch, n))
        state.update((batch, load))
        yield pd.DataFrame(out, columns=[by, "batch", "size"])

    kind = dict(stream.dtypes)[by]
    return stream.select(*dict.fromkeys([by, size, order])).groupBy(by).applyInPandasWithState(pack, f"`{by}` {kind}, batch bigint, size bigint", "batch bigint, load bigint", "append", GroupStateTimeout.NoTimeout)


def moving_thresholds(stream: DataFrame, by: str, value: str, order: str, last: int, q: float) -> DataFrame:
    """Thresholds that adapt: after every micro-batch, each group's lower and upper quantile over the
    values of its last rows (nulls and NaN among these left out); state is those rows."""

    def adapt(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        for x in pd.concat(list(frames)).sort_values(order)[value]:
            kept.append(float("nan") if x is None else float(x))
        kept = kept[-last:]
        state.update((kept,))
        some = pd.Series(kept).dropna()
        yield pd.DataFrame({by: [key[0]], "lower": [some.quantile(q) if len(some) else None], "upper": [some.quantile(1 - q) if len(some) else None], "n": [len(some)]})

    kind = dict(stream.dtypes)[by]
    return stream.select(by, value, order).groupBy(by).applyInPandasWithState(adapt, f"`{by}` {kind}, lower double, upper double, n bigint", "kept array<double>", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, mode: str, path: str) -> None:
    """All that is there now, as micro-batches into ``path``; in complete and update mode a batch replaces the one before."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/rows" if mode != "append" else f"{path}/rows/micro_batch={batch}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
