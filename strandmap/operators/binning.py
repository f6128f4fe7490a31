"""Maps: noise-weighted binning of samples into pixels, co-adds, splits and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accumulate(samples: DataFrame, keys: list[str], value: Column, weight: Column) -> DataFrame:
    """Additive sums of a map: nhit, wsum (of value * weight) and div (of weight). One shuffle, combined map-side."""
    return samples.groupBy(*keys).agg(F.count("*").alias("nhit"), F.sum(value * weight).alias("wsum"), F.sum(weight).alias("div"))


def finalised(sums: DataFrame) -> DataFrame:
    """m = wsum / div and rms = 1 / sqrt(div), 0 where there is no weight."""
    seen = F.col("div") > 0
    return sums.withColumn("m", F.when(seen, F.col("wsum") / F.col("div")).otherwise(0.0)).withColumn("rms", F.when(seen, 1 / F.sqrt("div")).otherwise(0.0)).drop("wsum", "div")


def at_levels(sums: DataFrame, pixel: list[str], levels: list[list[str]], names: list[str]) -> DataFrame:
    """Sums of sums by several sets of extra keys at once (feed and co-add; scan, field and total), with ``level``.

    The sums are additive, so every level is made from the finest map and samples move once.
    """
    extra = [k for i, k in enumerate(k for lev in levels for k in lev) if k not in [x for lev in levels for x in lev][:i]]
    fine = sums.groupBy(*pixel, *extra).agg(*[F.sum(c).alias(c) for c in ("nhit", "wsum", "div")])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), *[(F.col(k) if k in lev else F.lit(None)).cast(fine.schema[k].dataType).alias(k) for k in extra]) for n, lev in zip(names, levels, strict=True)]))
    dealt = fine.select(*pixel, "nhit", "wsum", "div", rows.alias("_l")).select(*pixel, "_l.*", "nhit", "wsum", "div")
    return dealt.groupBy(*pixel, "level", *extra).agg(*[F.sum(c).alias(c) for c in ("nhit", "wsum", "div")])


def split_halves(samples: DataFrame, splits: dict[str, Column]) -> DataFrame:
    """Each sample once a split, with ``split`` and ``half`` (0 or 1); a null half takes no part."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("split"), c.cast("int").alias("half")) for n, c in splits.items()]))
    return samples.withColumn("_s", each).select(*samples.columns, "_s.split", "_s.half").filter(F.col("half").isNotNull())


def multi_split(test: Column, controls: list[Column]) -> Column:
    """Index of a sample among the products of a test bit and control bits: test * 2^n + control bits."""
    out = test.cast("int") * 2 ** len(controls)
    for i, c in enumerate(controls):
        out = out + c.cast("int") * 2**i
    return out


def split_bits(df: DataFrame, word: str, names: list[str]) -> DataFrame:
    """Rows of accepted words (bit 0 set), one a split: ``split`` and ``half`` (bit i of the word for the i-th name, from 1)."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("split"), F.getbit(F.col(word), F.lit(i)).cast("int").alias("half")) for i, n in enumerate(names, 1)]))
    return df.filter(F.getbit(F.col(word), F.lit(0)) == 1).withColumn("_s", each).select("*", "_s.*").drop("_s")


def degraded(pixels: DataFrame, pixel: str, value: str, steps: int, keys: list[str] | None = None) -> DataFrame:
    """Nested pixels 4^steps to 1: mean of those present, and how many there were."""
    k = keys or []
    return pixels.filter(F.col(value).isNotNull()).groupBy(*k, F.shiftright(pixel, 2 * steps).alias(pixel)).agg(F.avg(value).alias(value), F.count("*").alias("children"))


def upgraded(pixels: DataFrame, pixel: str, steps: int) -> DataFrame:
    n = 4**steps
    return pixels.withColumn(pixel, F.explode(F.sequence(F.col(pixel) * n, F.col(pixel) * n + n - 1)))


def degraded_noise(pixels: DataFrame, pixel: str, variance: str, steps: int) -> DataFrame:
    """Variance of the mean of the children."""
    return pixels.groupBy(F.shiftright(pixel, 2 * steps).alias(pixel)).agg((F.avg(variance) / F.count("*")).alias(variance))


def binned(df: DataFrame, x: str, edges: list[float], values: list[str], keys: list[str] | None = None) -> DataFrame:
    """Mean of values by half-open bin of x (from 0); empty bins are 0, as are their counts."""
    n, k = len(edges) - 1, keys or []
    b = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(x))) - 1
    got = df.withColumn("bin", b).filter((F.col("bin") >= 0) & (F.col("bin") < n)).groupBy(*k, "bin").agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])
    grid = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    grid = df.select(*k).distinct().crossJoin(F.broadcast(grid)) if k else grid
    return grid.join(got, [*k, "bin"], "left").fillna(0, ["n", *values])
