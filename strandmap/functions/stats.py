"""Statistics with exact order: medians, quantiles, bounds and moments under masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Shares below the median of a normal variable by one standard deviation and above it; fixed values.
LOW, HIGH = 0.15865, 0.84134


def order_stats(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Exact order statistics by group: column name -> 1-based rank, an expression over ``n`` (the group's size).

    Null and NaN values don't count. Equal values are counted before anything is ordered, so a group's window holds its
    distinct values only, and no list of a group is ever built.
    """
    counted = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    up = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_of = Window.partitionBy(*keys)
    placed = counted.withColumn("_to", F.sum("_c").over(up)).withColumn("n", F.sum("_c").over(all_of))
    takes = [F.min(F.when(F.col("_to") >= rank, F.col(value))).alias(name) for name, rank in ranks.items()]
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *takes)


def median_rank() -> Column:
    """The upper median: element n/2 + 1 of n in ascending order, without interpolation."""
    return F.floor(F.col("n") / 2) + 1


def quantile_rank(q: float) -> Column:
    return F.least(F.floor(F.col("n") * q) + 1, F.col("n"))


def bound_rank(q: float) -> Column:
    return F.greatest(F.lit(1), F.least(F.col("n"), F.floor(F.col("n") * q)))


def confidence_bounds(df: DataFrame, keys: list[str], value: str, k: float, side: str = "two_sided") -> DataFrame:
    """(lower, upper) by group: median -+ k times the distance to the order statistic one sigma away; an open side is null."""
    got = order_stats(df, keys, value, {"mid": bound_rank(0.5), "low": bound_rank(LOW), "high": bound_rank(HIGH)})
    lower = F.col("mid") - k * (F.col("mid") - F.col("low"))
    upper = F.col("mid") + k * (F.col("high") - F.col("mid"))
    none = F.lit(None).cast("double")
    return got.select(*keys, (none if side == "upper" else lower).alias("lower"), (none if side == "lower" else upper).alias("upper"))


def masked_moments(df: DataFrame, keys: list[str], value: str, mask: str, clip: float | None = None) -> DataFrame:
    """Mean and population sigma over rows whose mask is not 0, with at most one clip at ``clip`` sigma.

    An empty mask gives mean 0 and sigma 1e20.
    """

    def moments(d: DataFrame) -> DataFrame:
        return d.groupBy(*keys).agg(F.avg(F.when(F.col(mask) != 0, F.col(value))).alias("mean"), F.stddev_pop(F.when(F.col(mask) != 0, F.col(value))).alias("sigma"))

    got = moments(df)
    if clip is not None:
        near = df.join(got, keys).withColumn(mask, F.when(F.abs(F.col(value) - F.col("mean")) <= clip * F.col("sigma"), F.col(mask)).otherwise(F.lit(0)))
        got = moments(near.drop("mean", "sigma"))
    return got.select(*keys, F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("sigma", F.lit(1e20)).alias("sigma"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def inverse_variance(value: Column, sigma: Column) -> tuple[Column, Column]:
    """Mean weighted by 1/sigma^2, and its sigma."""
    w = F.when(sigma > 0, 1 / (sigma * sigma))
    return F.sum(value * w) / F.sum(w), 1 / F.sqrt(F.sum(w))
