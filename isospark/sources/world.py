"""The world's lattice as a data source with pushed filters.

    register(spark)
    spark.read.format("world_lattice").option("lod", 1).load().where("j between 10 and 20")

A level's lattice has a cell for every pair of whole numbers (i, j). A scan is
bounded by the field's support around travel_x (an option, 0.5 at first), or by
the options first_i, last_i, first_j and last_j. Filters on i and j by constants
narrow that range before partitions are planned, so a filter on rows leaves fewer
partitions, and one on columns shorter ones. A partition is a range of rows of
about CELLS cells, which a task makes as Arrow batches from the range alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .. import params as P

#: Cells of a partition, about, and rows of a batch.
CELLS, BATCH = 1 << 20, 1 << 16
SCHEMA = "lod int, i long, j long, x double, y double"


@dataclass
class Rows(InputPartition):
    """Lattice rows first_j to last_j, each from first_i to last_i, both included."""

    first_i: int
    last_i: int
    first_j: int
    last_j: int


class WorldLattice(DataSource):
    @classmethod
    def name(cls) -> str:
        return "world_lattice"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LatticeReader(self.options)


class LatticeReader(DataSourceReader):
    def __init__(self, options):
        self.lod = int(options.get("lod", 0))
        self.step = 2.0**self.lod / P.BASE_GRID
        middle = float(options.get("travel_x", 0.5))
        bound = {"i": (middle - P.SUPPORT_X, middle + P.SUPPORT_X), "j": (0.5 - P.SUPPORT_Y, 0.5 + P.SUPPORT_Y)}
        self.low = {k: int(options.get(f"first_{k}", math.floor(low / self.step))) for k, (low, _) in bound.items()}
        self.high = {k: int(options.get(f"last_{k}", math.ceil(high / self.step) - 1)) for k, (_, high) in bound.items()}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of i or j with a number; In narrows the range, but Spark still has to pick from it."""
        for f in filters:
            axis = f.attribute[0] if getattr(f, "attribute", None) in (("i",), ("j",)) else None
            if axis is None or not self._narrow(axis, f):
                yield f

    def _narrow(self, axis: str, f: Filter) -> bool:
        whole = isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual)
        value = getattr(f, "value", None)
        if isinstance(f, In) and f.value and None not in f.value:
            self.low[axis], self.high[axis] = max(self.low[axis], min(f.value)), min(self.high[axis], max(f.value))
        if not whole or value is None:
            return False
        if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
            self.low[axis] = max(self.low[axis], value + isinstance(f, GreaterThan))
        if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
            self.high[axis] = min(self.high[axis], value - isinstance(f, LessThan))
        return True

    def partitions(self) -> list[Rows]:
        wide = self.high["i"] - self.low["i"] + 1
        if wide <= 0:
            return []
        tall = max(1, CELLS // wide)
        return [Rows(self.low["i"], self.high["i"], j, min(j + tall - 1, self.high["j"])) for j in range(self.low["j"], self.high["j"] + 1, tall)]

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        wide = partition.last_i - partition.first_i + 1
        cells = wide * (partition.last_j - partition.first_j + 1)
        for at in range(0, cells, BATCH):
            j, i = np.divmod(np.arange(at, min(at + BATCH, cells)), wide)
            i, j = i + partition.first_i, j + partition.first_j
            columns = [pa.array(np.full(len(i), self.lod, np.int32)), pa.array(i), pa.array(j), pa.array((i + 0.5) * self.step), pa.array((j + 0.5) * self.step)]
            yield pa.RecordBatch.from_arrays(columns, ["lod", "i", "j", "x", "y"])


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets Spark push filters to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorldLattice)
