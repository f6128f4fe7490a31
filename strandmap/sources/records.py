"""Files of fixed-width binary records, as a data source of their own.

    spark.dataSource.register(RecordSource)
    spark.read.format("strandmap_records").option("path", ...).option("fields", "t f8, az f4, n i4").load()
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..runtime import ship
from .images import listed, opened

SPARK_KINDS = {"f8": "double", "f4": "float", "i8": "long", "i4": "int", "i2": "short", "i1": "byte"}
CHUNK = 32 << 20


def parse_fields(text: str) -> list[tuple[str, str]]:
    out = [tuple(f.split()) for f in text.split(",")]
    for name, kind in out:
        if kind not in SPARK_KINDS:
            raise ValueError(f"{name}: {kind} is none of {', '.join(SPARK_KINDS)}")
    return out


class Piece(InputPartition):
    def __init__(self, path: str, start: int, rows: int):
        self.path, self.start, self.rows = path, start, rows


class RecordReader(DataSourceReader):
    """Each partition is a run of whole records of one file, so long files are read by many tasks."""

    def __init__(self, path: str, fields: list[tuple[str, str]], skip: int):
        self.path, self.skip, self.fields = path, skip, fields
        self.dtype = np.dtype([(n, f"<{k}") for n, k in fields])

    def partitions(self) -> list[Piece]:
        step, out = max(1, CHUNK // self.dtype.itemsize), []
        for name, size in listed(self.path):
            rows = (size - self.skip) // self.dtype.itemsize
            out += [Piece(name, at, min(step, rows - at)) for at in range(0, rows, step)]
        return out or [Piece("", 0, 0)]

    def read(self, part: Piece) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        with opened(part.path) as f:
            f.seek(self.skip + part.start * self.dtype.itemsize)
            rows = np.frombuffer(f.read(part.rows * self.dtype.itemsize), self.dtype)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[n])) for n, _ in self.fields], [n for n, _ in self.fields])


class RecordSource(DataSource):
    """Options: path (file, folder or pattern), fields (``name kind``, comma-separated) and skip (bytes of a head)."""

    @classmethod
    def name(cls) -> str:
        return "strandmap_records"

    def schema(self) -> str:
        return ", ".join(f"`{n}` {SPARK_KINDS[k]}" for n, k in parse_fields(self.options["fields"]))

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.options["path"], parse_fields(self.options["fields"]), int(self.options.get("skip", 0)))


def read(spark, path: str, fields: str, skip: int = 0):
    """Records of files that every executor sees under ``path``."""
    ship(spark)
    spark.dataSource.register(RecordSource)
    return spark.read.format("strandmap_records").option("path", path).option("fields", fields).option("skip", skip).load()
