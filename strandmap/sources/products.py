"""Products on disk: streams by scan, maps by kind, spectra, and dense maps with a sentinel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mapalgebra import from_sentinel, to_sentinel


def write_streams(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Streams in folders by scan, so that a reader of one scan lists no others; each folder gets few files."""
    keys = by or ["scan_id"]
    df.repartition(*keys).sortWithinPartitions(*keys).write.mode("append").partitionBy(*keys).parquet(path)


def read_streams(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Streams; naming the columns keeps the others off the scan (pointing alone, say)."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df.select(*columns) if columns else df


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Streams one after the other; columns that a part lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_map(maps: dict[str, DataFrame], path: str) -> None:
    """Maps (sums or values by pixel) of several kinds in one product."""
    for kind, df in maps.items():
        df.write.mode("overwrite").parquet(f"{path}/kind={kind}")


def read_map(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path).filter(F.col("kind") == kind).drop("kind")


def dense(sparse: DataFrame, pixel: str, value: str, n: int) -> DataFrame:
    """All pixels from 0 to n - 1, the sentinel where the map has none."""
    return sparse.sparkSession.range(n).select(F.col("id").alias(pixel)).join(sparse, pixel, "left").select(pixel, to_sentinel(F.col(value)).alias(value))


def sparse(full: DataFrame, pixel: str, value: str) -> DataFrame:
    """Pixels that aren't missing."""
    return full.select(pixel, from_sentinel(F.col(value)).alias(value)).filter(F.col(value).isNotNull())


def simulated_cube(cube: DataFrame, sideband: str, freq: str, value: str, n_freq: int) -> DataFrame:
    """A simulated cube in microkelvin (sidebands and channels from 1) as kelvin in the order of the receiver, whose
    first and third sidebands run backwards."""
    back = F.col(sideband) % 2 == 1
    return cube.withColumn(freq, F.when(back, n_freq + 1 - F.col(freq)).otherwise(F.col(freq))).withColumn(value, F.col(value) / 1e6)


def write_table(df: DataFrame, path: str, mask: str | None = None) -> None:
    """Text rows of (unmasked) pixels."""
    (df.filter(F.col(mask) > 0.5) if mask else df).write.mode("overwrite").csv(path, sep=" ", header=True)
