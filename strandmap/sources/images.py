"""Images: primary arrays of FITS files as a data source with slices, and maps as PNG files."""

from __future__ import annotations

import fnmatch
import math
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..runtime import ship

#: Fixed values of the format: bytes of a block and of a header card, kinds of numbers.
BLOCK, CARD = 2880, 80
KINDS = {8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
#: Values that a task reads at once, and pixels that an image may have.
VALUES, PIXELS = 1 << 20, 64 << 20


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def opened(path: str) -> pa.NativeFile:
    """A file on any file system that Arrow knows by its address, open for reading."""
    system, name = _place(path)
    return system.open_input_file(name)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of a folder's files or of those that a pattern in the last part of the path names."""
    system, name = _place(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.File:
        found = [info]
    elif info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(name))
    else:
        found = system.get_file_info(fs.FileSelector(os.path.dirname(name), allow_not_found=True))
        found = [f for f in found if fnmatch.fnmatchcase(f.base_name, os.path.basename(name))]
    start = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""
    return sorted((start + f.path, f.size) for f in found if f.type == fs.FileType.File)


def head(f: pa.NativeFile) -> tuple[dict[str, str], int]:
    """Cards of a header and where the data start."""
    cards, at = {}, 0
    while True:
        block = f.read(BLOCK)
        if len(block) < BLOCK or (at == 0 and not block.startswith(b"SIMPLE")):
            raise ValueError("no whole FITS header")
        at += BLOCK
        for i in range(0, BLOCK, CARD):
            card = block[i : i + CARD].decode("ascii", "replace")
            if card.rstrip() == "END":
                return cards, at
            if card[8:10] == "= ":
                cards.setdefault(card[:8].strip(), card[10:].split("/")[0].strip())


def ranges(text: str, sizes: list[int]) -> list[range]:
    """One range of 1-based places by axis, from ``first:last:step`` pieces; what is left out goes from end to end."""
    parts = text.split(",") if text else []
    if len(parts) > len(sizes):
        raise ValueError(f"{len(parts)} ranges of an image with {len(sizes)} axes")
    out = []
    for part, n in zip([*parts, *[":"] * (len(sizes) - len(parts))], sizes, strict=True):
        first, *more = part.split(":")
        last, step = [*more, "", ""][:2] if more else (first, "")
        out.append(range(int(first or 1), int(last or n) + 1, int(step or 1)))
        if out[-1].step < 1 or (out[-1] and not 1 <= out[-1][0] <= out[-1][-1] <= n):
            raise ValueError(f"{part} is no range of 1 to {n}")
    return out


class Plane(InputPartition):
    def __init__(self, lines: list[int]):
        self.lines = lines


class ImageReader(DataSourceReader):
    """Lines of the first axis are read one by one, those of the slice alone; a partition holds a run of them."""

    def __init__(self, path: str, text: str):
        self.path = path
        with opened(path) as f:
            cards, self.start = head(f)
        self.sizes = [int(cards[f"NAXIS{i}"]) for i in range(1, int(cards["NAXIS"]) + 1)]
        self.kind, self.scale, self.zero = np.dtype(KINDS[int(cards["BITPIX"])]), float(cards.get("BSCALE", 1)), float(cards.get("BZERO", 0))
        self.slice = ranges(text, self.sizes)

    def partitions(self) -> list[Plane]:
        n = math.prod(len(r) for r in self.slice[1:]) if self.sizes else 0
        step = max(1, VALUES // max(1, self.sizes[0] if self.sizes else 1))
        return [Plane([at, min(at + step, n)]) for at in range(0, n, step)] or [Plane([0, 0])]

    def read(self, part: Plane) -> Iterator[pa.RecordBatch]:
        names = [*(f"i{k}" for k in range(1, len(self.sizes) + 1)), "value"]
        with opened(self.path) as f:
            for line in range(*part.lines):
                at, left = [], line
                for r in self.slice[1:]:
                    at.append(r[left % len(r)])
                    left //= len(r)
                offset, stride = 0, self.sizes[0]
                for p, n in zip(at, self.sizes[1:], strict=True):
                    offset, stride = offset + (p - 1) * stride, stride * n
                f.seek(self.start + offset * self.kind.itemsize)
                first = np.array(self.slice[0], np.int64)
                row = np.frombuffer(f.read(self.sizes[0] * self.kind.itemsize), self.kind)[first - 1] * self.scale + self.zero
                yield pa.RecordBatch.from_arrays([pa.array(first), *(pa.array(np.full(len(first), p)) for p in at), pa.array(row.astype(float))], names)


class ImageSource(DataSource):
    """Options: path, and slice (1-based ``first:last:step`` by axis, comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "strandmap_image"

    def schema(self) -> str:
        n = len(ImageReader(self.options["path"], "").sizes)
        return ", ".join([*(f"i{k} long" for k in range(1, n + 1)), "value double"])

    def reader(self, schema: StructType) -> ImageReader:
        return ImageReader(self.options["path"], self.options.get("slice", ""))


def read_image(spark: SparkSession, path: str, slice: str = "") -> DataFrame:
    """Values of a FITS file's primary array by their places, those of ``slice`` alone."""
    ship(spark)
    spark.dataSource.register(ImageSource)
    return spark.read.format("strandmap_image").option("path", path).option("slice", slice).load()


def grid(m: DataFrame, x: str, y: str, value: str, width: int, height: int) -> np.ndarray:
    """A map's pixels from (0, 0) as a dense image of stated size (NaN where it has none); pixels beyond it are an error."""
    if width * height > PIXELS:
        raise ValueError(f"{width} x {height} pixels are over {PIXELS}")
    out = np.full((height, width), np.nan)
    one = m.groupBy(x, y).agg(F.first(value).cast("double").alias("v"), F.count("*").alias("n"))
    for r in one.toLocalIterator():
        if r["n"] > 1 or not (0 <= r[0] < width and 0 <= r[1] < height):
            raise ValueError(f"pixel ({r[0]}, {r[1]}) repeats or lies beyond {width} x {height}")
        out[r[1], r[0]] = np.nan if r["v"] is None else r["v"]
    return out


def write_image(values: np.ndarray, path: str) -> None:
    """An array as the primary array of a FITS file; its last axis is the file's first."""
    values = np.asarray(values, float)
    cards = ["SIMPLE  =                    T", "BITPIX  =                  -64", f"NAXIS   = {values.ndim:>20}"]
    cards += [f"NAXIS{i:<3}= {n:>20}" for i, n in enumerate(reversed(values.shape), 1)] + ["END"]
    text, data = "".join(c.ljust(CARD) for c in cards).encode(), values.astype(">f8").tobytes()
    system, name = _place(path)
    with system.open_output_stream(name) as f:
        f.write(text.ljust(-(-len(text) // BLOCK) * BLOCK) + data + b"\0" * (-len(data) % BLOCK))


def png(values: np.ndarray, low: float | None = None, high: float | None = None) -> bytes:
    """An array as a grey PNG with alpha, its first row at the bottom; NaN is transparent."""
    held = np.isfinite(values)
    low = float(values[held].min()) if low is None and held.any() else low or 0.0
    high = float(values[held].max()) if high is None and held.any() else high if high is not None else 1.0
    grey = np.where(held, np.clip((np.where(held, values, low) - low) / (high - low if high > low else 1.0), 0, 1) * 255 + 0.5, 0).astype(np.uint8)
    pixels = np.dstack([grey, np.where(held, 255, 0).astype(np.uint8)])[::-1]
    rows = b"".join(b"\0" + r.tobytes() for r in pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", values.shape[1], values.shape[0], 8, 4, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
