"""Least squares, grids and likelihood sums by group: a few additive sums each, solved afterwards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import median_rank, order_stats
from ..runtime import ship


def line(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def remove_slope(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """y minus the fitted slope times x, with the mean of y kept. One aggregate a group joined back."""
    fit = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("_a"), F.avg(x).alias("_m"))
    return df.join(fit, keys).withColumn(y, F.col(y) - F.col("_a") * (F.col(x) - F.col("_m"))).drop("_a", "_m")


def normal_sums(df: DataFrame, keys: list[str], basis: list, y, weight=None) -> DataFrame:
    """Sums of the normal equations by group: a (upper triangle of B^T W B) and b (B^T W y) as arrays."""
    w = weight if weight is not None else F.lit(1.0)
    a = [F.sum(w * u * v) for i, u in enumerate(basis) for v in basis[i:]]
    return df.groupBy(*keys).agg(F.array(*a).alias("a"), F.array(*[F.sum(w * u * y) for u in basis]).alias("b"))


def solved(sums: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Solutions ``fit`` of normal equations, one small system a row, in batches of rows."""

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = np.triu_indices(n)
        for p in parts:
            m = np.zeros((len(p), n, n))
            m[:, upper[0], upper[1]] = np.array(p["a"].tolist()).reshape(len(p), -1)
            m = m + np.transpose(np.triu(m, 1), (0, 2, 1))
            b = np.array(p["b"].tolist()).reshape(len(p), n)
            fit = np.einsum("kij,kj->ki", np.linalg.pinv(m), b)
            yield p[keys].assign(fit=list(fit))

    ship(sums.sparkSession)
    fields = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in keys)
    return sums.select(*keys, "a", "b").mapInPandas(solve, f"{fields}, fit array<double>")


def polynomial(df: DataFrame, keys: list[str], x: str, y: str, degree: int) -> DataFrame:
    """Coefficients of a polynomial by group, lowest first."""
    basis = [F.pow(F.col(x), F.lit(float(i))) for i in range(degree + 1)]
    return solved(normal_sums(df, keys, basis, F.col(y)), keys, degree + 1)


def amplitude_grid(df: DataFrame, data: str, model: str, sigma: str, low: float, high: float, steps: int) -> DataFrame:
    """Best amplitude on a grid, its chi2, and posterior mean and deviation. chi2 is quadratic: three sums give the grid."""
    w = 1 / (F.col(sigma) * F.col(sigma))
    s = df.agg(F.sum(w * F.col(data) * F.col(data)).alias("dd"), F.sum(w * F.col(data) * F.col(model)).alias("dm"), F.sum(w * F.col(model) * F.col(model)).alias("mm"))
    a = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: low + k * (high - low) / (steps - 1)))
    grid = s.withColumn("a", a).withColumn("chi2", F.col("dd") - 2 * F.col("a") * F.col("dm") + F.col("a") * F.col("a") * F.col("mm"))
    least = grid.agg(F.min_by("a", "chi2").alias("best"), F.min("chi2").alias("chi2"))
    p = F.exp(-(F.col("g.chi2") - F.col("chi2_min")) / 2)
    both = grid.alias("g").crossJoin(F.broadcast(least.withColumnRenamed("chi2", "chi2_min")))  # one row
    mean, square = F.sum(p * F.col("g.a")) / F.sum(p), F.sum(p * F.col("g.a") * F.col("g.a")) / F.sum(p)
    return both.groupBy("best", F.col("chi2_min").alias("chi2")).agg(mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("sigma"))


def median_slope(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Upper median of the slopes of all pairs of a group's points. Groups are regions of few points: pairs are made by need."""
    a, b = df.select(*keys, F.col(x).alias("_xa"), F.col(y).alias("_ya")), df.select(*keys, F.col(x).alias("_xb"), F.col(y).alias("_yb"))
    s = a.join(b, keys).filter("_xa < _xb").withColumn("_s", (F.col("_yb") - F.col("_ya")) / (F.col("_xb") - F.col("_xa")))
    return order_stats(s, keys, "_s", {"slope": median_rank()})


def scatter_slopes(m1: DataFrame, m2: DataFrame, regions: DataFrame, pixel: list[str], value: str, region: str) -> DataFrame:
    """By region of pixels: the median slope of map 2 against map 1, the correlation of both and the pixels they share."""
    both = m1.select(*pixel, F.col(value).alias("_x")).join(m2.select(*pixel, F.col(value).alias("_y")), pixel).join(regions.select(*pixel, region), pixel)
    sums = both.groupBy(region).agg(F.corr("_x", "_y").alias("corr"), F.count("*").alias("n"))
    return sums.join(median_slope(both, [region], "_x", "_y").select(region, "slope"), region, "left")


def gain_amplitudes(gains: DataFrame, template: DataFrame, keys: list[str], time: str, value: str, sigma: str, width: float) -> DataFrame:
    """By group: the amplitude that best takes the template's mean in even bins of time to the measured gains, chi2 and n.

    The bins, each about ``width`` long, divide the whole template's range of time; gains beyond it belong to its first
    or last bin, those in a bin without template are left out. chi2 is quadratic in the amplitude, so three sums solve it.
    """
    ends = template.agg(F.min(time).alias("_lo"), F.max(time).alias("_hi"))  # one row
    n = F.ceil((F.col("_hi") - F.col("_lo")) / width) + 1
    place = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(time) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * n)).otherwise(F.lit(0))
    binned = lambda d: d.crossJoin(F.broadcast(ends)).withColumn("_b", F.greatest(F.lit(0), F.least(place, n - 1)))
    means = binned(template).groupBy(*keys, "_b").agg(F.avg(value).alias("_m"))
    w, m, y = 1 / (F.col(sigma) * F.col(sigma)), F.col("_m"), F.col(value)
    sums = binned(gains).join(means, [*keys, "_b"]).groupBy(*keys).agg(F.sum(w * y * m).alias("_ym"), F.sum(w * m * m).alias("_mm"), F.sum(w * y * y).alias("_yy"), F.count("*").alias("n"))
    amp = F.try_divide(F.col("_ym"), F.col("_mm"))
    return sums.select(*keys, amp.alias("amplitude"), (F.col("_yy") - amp * F.col("_ym")).alias("chi2"), "n")


def noise_model(nu, fknee: float, alpha: float):
    """1 + (nu / fknee)^alpha."""
    return 1 + F.pow(nu / fknee, F.lit(alpha))


def noise_sums(spectrum: DataFrame, nu: str, power: str, sigma0: float, fknee: float, alpha: float) -> DataFrame:
    """Of a noise model against a power spectrum: mean of power/model + ln(model), best sigma^2, and (sum(power/model) - n)/sqrt(n)."""
    shape = noise_model(F.col(nu), fknee, alpha)
    model = sigma0 * sigma0 * shape
    n = F.count("*")
    return spectrum.agg(F.avg(F.col(power) / model + F.ln(model)).alias("lnl"), F.avg(F.col(power) / shape).alias("sigma2"), ((F.sum(F.col(power) / model) - n) / F.sqrt(n)).alias("chi2"))
