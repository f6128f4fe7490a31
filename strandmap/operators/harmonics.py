"""Spherical harmonics of maps of moderate resolution: sums over pixels are distributed, coefficients are few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

#: Coefficients up to this degree are held on the driver and in each task.
MOST = 512


def legendre(lmax: int, m: int, x: np.ndarray) -> np.ndarray:
    """Normalised associated Legendre functions of degrees m..lmax at x, a row a degree."""
    out = np.zeros((lmax - m + 1, len(x)))
    s = np.sqrt(1 - x * x)
    first = np.full(len(x), np.sqrt(1 / (4 * np.pi)))
    for k in range(1, m + 1):
        first = -np.sqrt((2 * k + 1) / (2 * k)) * s * first
    out[0] = first
    if lmax > m:
        out[1] = np.sqrt(2 * m + 3) * x * first
    for deg in range(m + 2, lmax + 1):
        a = np.sqrt((4 * deg * deg - 1) / (deg * deg - m * m))
        b = np.sqrt(((deg - 1) ** 2 - m * m) / (4 * (deg - 1) ** 2 - 1))
        out[deg - m] = a * (x * out[deg - m - 1] - b * out[deg - m - 2])
    return out


def analyse(pixels: DataFrame, theta: str, phi: str, value: str, area: float, lmax: int) -> DataFrame:
    """(l, m, re, im) for m >= 0 of pixels of equal area: each task sums its own pixels, tasks add up by (l, m)."""
    if lmax > MOST:
        raise ValueError(f"lmax above {MOST}")
    ship(pixels.sparkSession)

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((lmax + 1, lmax + 1), complex)
        for p in parts:
            x, f, v = np.cos(p[theta].to_numpy(float)), p[phi].to_numpy(float), p[value].to_numpy(float)
            for m in range(lmax + 1):
                total[m:, m] += legendre(lmax, m, x) @ (v * np.exp(-1j * m * f)) * area
        deg, m = np.tril_indices(lmax + 1)
        yield pd.DataFrame({"l": deg.astype(np.int32), "m": m.astype(np.int32), "re": total[deg, m].real, "im": total[deg, m].imag})

    got = pixels.filter(F.col(value).isNotNull()).select(theta, phi, value).mapInPandas(sums, "l int, m int, re double, im double")
    return got.groupBy("l", "m").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def synthesise(pixels: DataFrame, theta: str, phi: str, alm: DataFrame, out: str) -> DataFrame:
    """Adds the map of the coefficients at each pixel. The coefficients, (lmax + 1)^2 / 2 numbers, go to every task; an l
    beyond MOST is an error."""
    ship(pixels.sparkSession)
    lmax = alm.agg(F.max("l")).head()[0] or 0
    if lmax > MOST:
        raise ValueError(f"l is {lmax}, at most {MOST} fits in a task")
    rows = alm.collect()
    a = np.zeros((lmax + 1, lmax + 1), complex)
    for r in rows:
        a[r["l"], r["m"]] = complex(r["re"], r["im"])

    def values(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            x, f, v = np.cos(p[theta].to_numpy(float)), p[phi].to_numpy(float), np.zeros(len(p))
            for m in range(lmax + 1):
                v += (1 if m == 0 else 2) * ((a[m:, m] @ legendre(lmax, m, x)) * np.exp(1j * m * f)).real
            yield p.assign(**{out: v})

    schema = pixels.drop(out).schema.add(out, "double")
    return pixels.drop(out).mapInPandas(values, schema)


def refined(pixels: DataFrame, theta: str, phi: str, value: str, area: float, lmax: int, rounds: int = 3) -> DataFrame:
    """analyse(), then ``rounds`` times the same of what the coefficients leave over, which mends the sums' error."""
    alm = analyse(pixels, theta, phi, value, area, lmax)
    for _ in range(rounds):
        left = synthesise(pixels.select(theta, phi, value), theta, phi, alm, "_m").withColumn(value, F.col(value) - F.col("_m"))
        alm = alm.unionByName(analyse(left, theta, phi, value, area, lmax)).groupBy("l", "m").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return alm


def beam(fwhm: float, lmax: int) -> np.ndarray:
    """Window of a Gaussian beam (fwhm in radians)."""
    k = np.arange(lmax + 1)
    return np.exp(-k * (k + 1) * fwhm**2 / (16 * np.log(2)))


def windowed(alm: DataFrame, window) -> DataFrame:
    """Coefficients times a factor by degree (0 beyond its end)."""
    w = F.coalesce(F.get(F.array(*[F.lit(float(x)) for x in window]), F.col("l")), F.lit(0.0))
    return alm.select("l", "m", (F.col("re") * w).alias("re"), (F.col("im") * w).alias("im"))


def degree_range(alm: DataFrame, low: int, high: int) -> DataFrame:
    return alm.filter(F.col("l").between(low, high))


def merged(a: DataFrame, b: DataFrame, start: int, stop: int) -> DataFrame:
    """Low degrees of a, high ones of b, a cosine taper between start and stop."""
    x = (F.col("l") - start) / float(stop - start)
    w = F.when(F.col("l") <= start, 1.0).when(F.col("l") >= stop, 0.0).otherwise(0.5 * (1 + F.cos(x * float(np.pi))))
    part = lambda d, f: d.select("l", "m", (F.col("re") * f).alias("re"), (F.col("im") * f).alias("im"))
    return part(a, w).unionByName(part(b, 1 - w)).groupBy("l", "m").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def spectrum(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """(l, c): auto or cross spectrum of coefficients with m >= 0."""
    both = a.select("l", "m", F.col("re").alias("ar"), F.col("im").alias("ai")).join((b if b is not None else a).select("l", "m", F.col("re").alias("br"), F.col("im").alias("bi")), ["l", "m"])
    p = (F.col("ar") * F.col("br") + F.col("ai") * F.col("bi")) * F.when(F.col("m") == 0, 1).otherwise(2)
    return both.groupBy("l").agg((F.sum(p) / (2 * F.col("l") + 1)).alias("c"))


def transfer(out: DataFrame, given: DataFrame) -> DataFrame:
    """Ratio of two spectra by degree."""
    return out.withColumnRenamed("c", "_o").join(given.withColumnRenamed("c", "_g"), "l").select("l", F.try_divide("_o", "_g").alias("ratio"))


def smooth_transfer(ratios: DataFrame, half: int = 25, start: int = 100) -> DataFrame:
    """Running mean from ``start`` on; below it the parabola through (0, 1), (1, 1) and its value there."""
    from pyspark.sql.window import Window

    w = Window.orderBy("l").rowsBetween(-half, half)  # at most MOST rows
    got = ratios.withColumn("s", F.avg("ratio").over(w))
    at = got.filter(F.col("l") == start).agg(F.max("s").alias("_at"))
    curve = 1 + (F.col("_at") - 1) * F.col("l") * (F.col("l") - 1) / (start * (start - 1))
    return got.crossJoin(F.broadcast(at)).select("l", F.when(F.col("l") < start, curve).otherwise(F.col("s")).alias("ratio"))  # one row


def random_coefficients(spark, spectrum_values: np.ndarray, seed: int) -> DataFrame:
    """A Gaussian draw of coefficients with the given spectrum."""
    r, rows = np.random.default_rng(seed), []
    for deg, c in enumerate(spectrum_values):
        s = float(np.sqrt(c))
        rows.append((deg, 0, s * float(r.normal()), 0.0))
        rows += [(deg, m, s * float(r.normal()) / 2**0.5, s * float(r.normal()) / 2**0.5) for m in range(1, deg + 1)]
    return spark.createDataFrame(rows, "l int, m int, re double, im double")
