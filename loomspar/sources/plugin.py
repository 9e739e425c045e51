"""A data source plug-in: items from a generator, read in partitions, with a limit."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class SquaresReader(DataSourceReader):
    def __init__(self, n: int, parts: int):
        self.n, self.parts = n, parts

    def partitions(self) -> list[Range]:
        return [Range(k * self.n // self.parts, (k + 1) * self.n // self.parts) for k in range(self.parts)]

    def read(self, partition: Range) -> Iterator[tuple]:
        for k in range(partition.lo, partition.hi):
            yield k, k * k


class ItemSource(DataSource):
    """``spark.read.format("loom_items").option("limit", n).load()``; the base that file formats of items derive from."""

    @classmethod
    def name(cls) -> str:
        return "loom_items"

    def schema(self) -> str:
        return "item bigint, value bigint"

    def reader(self, schema) -> SquaresReader:  # noqa: ANN001
        return SquaresReader(int(self.options.get("limit", "1000")), int(self.options.get("parts", "4")))
