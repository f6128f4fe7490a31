"""Datasets of HDF5 files by hyperslabs. They need the h5py library, which is looked for when a file is opened."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..runtime import ship

VALUES = 1 << 20


def library():
    try:
        import h5py
    except ModuleNotFoundError as e:
        raise ModuleNotFoundError("HDF5 files need the h5py library on the driver and the executors; Parquet streams need none", name=e.name) from e
    return h5py


def shape(path: str, dataset: str) -> tuple[int, ...] | None:
    """Sizes of a dataset's axes; None if the file has no such dataset."""
    with library().File(path, "r") as f:
        return tuple(f[dataset].shape) if dataset in f else None


def write(path: str, dataset: str, values: np.ndarray) -> None:
    """Adds a dataset to a file, in the place of one of the same name."""
    with library().File(path, "a") as f:
        if dataset in f:
            del f[dataset]
        f[dataset] = values


class Slab(InputPartition):
    def __init__(self, first: int, rows: int):
        self.first, self.rows = first, rows


class SlabReader(DataSourceReader):
    """A partition is a run of places along the first axis, within the slab asked for."""

    def __init__(self, path: str, dataset: str, start: list[int], count: list[int]):
        self.path, self.dataset = path, dataset
        size = shape(path, dataset)
        if size is None:
            raise ValueError(f"{path} has no dataset {dataset}")
        self.start = start or [0] * len(size)
        self.count = count or [n - s for n, s in zip(size, self.start, strict=True)]
        if len(self.start) != len(size) or len(self.count) != len(size) or any(not 0 <= s <= s + c <= n for s, c, n in zip(self.start, self.count, size, strict=True)):
            raise ValueError(f"the slab is not within {size}")

    def partitions(self) -> list[Slab]:
        if not self.count:
            return [Slab(0, 1)]
        step = max(1, VALUES // max(1, math.prod(self.count[1:])))
        return [Slab(self.start[0] + at, min(step, self.count[0] - at)) for at in range(0, self.count[0], step)] or [Slab(0, 0)]

    def read(self, part: Slab) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        start, count = [part.first, *self.start[1:]][: len(self.start)], [part.rows, *self.count[1:]][: len(self.count)]
        with library().File(self.path, "r") as f:
            values = np.asarray(f[self.dataset][tuple(slice(s, s + c) for s, c in zip(start, count, strict=True))], float)
        places = np.indices(values.shape, np.int64).reshape(values.ndim, values.size) + np.array(start, np.int64).reshape(-1, 1)
        yield pa.RecordBatch.from_arrays([*(pa.array(p) for p in places), pa.array(values.reshape(-1))], [*(f"i{k}" for k in range(values.ndim)), "value"])


class SlabSource(DataSource):
    """Options: path, dataset, and start and count (whole numbers by axis, comma-separated) of a hyperslab."""

    @classmethod
    def name(cls) -> str:
        return "strandmap_hdf5"

    def schema(self) -> str:
        size = shape(self.options["path"], self.options["dataset"])
        return ", ".join([*(f"i{k} long" for k in range(len(size or ()))), "value double"])

    def reader(self, schema: StructType) -> SlabReader:
        numbers = lambda k: [int(n) for n in self.options.get(k, "").split(",") if n.strip()]
        return SlabReader(self.options["path"], self.options["dataset"], numbers("start"), numbers("count"))


def read(spark: SparkSession, path: str, dataset: str, start: list[int] | None = None, count: list[int] | None = None) -> DataFrame:
    """Values of a dataset (or of a hyperslab of it) by their places from 0, in a file that every executor sees."""
    ship(spark)
    spark.dataSource.register(SlabSource)
    text = lambda n: ",".join(map(str, n or []))
    return spark.read.format("strandmap_hdf5").option("path", path).option("dataset", dataset).option("start", text(start)).option("count", text(count)).load()
