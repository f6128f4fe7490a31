"""Maps as (pixel, value) rows: missing pixels are null or absent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.angles import antenna_to_thermodynamic

#: What files of dense maps hold where a pixel is missing; fixed value.
SENTINEL = -1.6375e30


def from_sentinel(v: Column) -> Column:
    return F.when(F.abs(v / SENTINEL - 1) >= 1e-5, v)


def to_sentinel(v: Column) -> Column:
    return F.coalesce(v, F.lit(SENTINEL))


def single(operation: str, v: Column, value: float = 0.0, top: Column | None = None) -> Column:
    """An operation on one map's values. ``top``: the largest value of the map, for hitcount2mask."""
    ops = {
        "scale": lambda: v * value,
        "a2t": lambda: v * antenna_to_thermodynamic(F.lit(value)),
        "t2a": lambda: v / antenna_to_thermodynamic(F.lit(value)),
        "add_offset": lambda: v + value,
        "log": lambda: F.when(v > 0, F.log10(v)),
        "ln": lambda: F.when(v > 0, F.ln(v)).otherwise(v),
        "exp": lambda: F.exp(v),
        "abs": lambda: F.abs(v),
        "asinh": lambda: F.asinh(v),
        "sqrt": lambda: F.when(v > 0, F.sqrt(v)).otherwise(v),
        "inv": lambda: F.when(v != 0, 1 / v).otherwise(v),
        "hitcount2rms": lambda: F.when(v > 0, value / F.sqrt(v)),
        "max_scalar": lambda: F.greatest(v, F.lit(value)),
        "min_scalar": lambda: F.least(v, F.lit(value)),
        "missing2mask": lambda: F.when(v.isNull(), 0.0).otherwise(1.0),
        "rms2mask": lambda: F.when(v.isNull() | (v >= value), 0.0).otherwise(1.0),
        "amp2mask": lambda: F.when(v.isNull() | (F.abs(v) > value), 0.0).otherwise(1.0),
        "hitcount2mask": lambda: F.when(v > top / (value * value), 1.0).otherwise(0.0),
    }
    return ops[operation]()


def polarised_intensity(q: Column, u: Column) -> Column:
    return F.sqrt(q * q + u * u)


def pair(operation: str, a: Column, b: Column) -> Column:
    """An operation on two maps; missing where either is, but for splice, which takes the first that isn't."""
    ops = {
        "add": lambda: a + b,
        "subtract": lambda: a - b,
        "multiply": lambda: a * b,
        "divide": lambda: F.try_divide(a, b),
        "half_sum": lambda: (a + b) / 2,
        "half_diff": lambda: (a - b) / 2,
        "max": lambda: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)),
        "min": lambda: F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)),
        "splice": lambda: F.coalesce(a, b),
    }
    return ops[operation]()


def combine(m1: DataFrame, m2: DataFrame, pixel: list[str], value: str, operation: str) -> DataFrame:
    how = "full" if operation == "splice" else "inner"
    b = m2.select(*pixel, F.col(value).alias("_b"))
    return m1.select(*pixel, F.col(value).alias("_a")).join(b, pixel, how).select(*pixel, pair(operation, F.col("_a"), F.col("_b")).alias(value))


def weighted_sum(maps: list[DataFrame], weights: list[float], pixel: list[str], value: str) -> DataFrame:
    """Sum of weighted maps over the pixels that all of them have; one shuffle for any number of maps."""
    rows = reduce(DataFrame.unionByName, [m.select(*pixel, (F.col(value) * w).alias(value)) for m, w in zip(maps, weights, strict=True)])
    got = rows.groupBy(*pixel).agg(F.sum(value).alias(value), F.count(value).alias("_n"))
    return got.filter(F.col("_n") == len(maps)).drop("_n")


def mean_and_deviation(maps: list[DataFrame], pixel: list[str], value: str) -> DataFrame:
    rows = reduce(DataFrame.unionByName, [m.select(*pixel, value) for m in maps])
    return rows.groupBy(*pixel).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def blended(m: DataFrame, weight: str, value: str, low: float, high: float, constant: float) -> Column:
    """The map where the weight exceeds ``high``, a constant where it is below ``low``, a linear blend between."""
    w, v = F.col(weight), F.col(value)
    f = (w - low) / (high - low)
    return F.when(w > high, v).when(w < low, F.lit(constant)).otherwise(f * v + (1 - f) * constant)


def statistics(m: DataFrame, value: str, mask: str, keys: list[str] | None = None) -> DataFrame:
    """Mean and sample sigma over unmasked pixels."""
    return m.filter(F.col(mask) > 0.5).groupBy(*(keys or [])).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sigma"), F.count(value).alias("n"))


def index_map(a: Column, b: Column, nu1: float, nu2: float, convert: bool = True) -> Column:
    """Spectral index between two frequencies in GHz, where both values have one sign."""
    import math

    f = antenna_to_thermodynamic(F.lit(nu1)) / antenna_to_thermodynamic(F.lit(nu2)) if convert and nu1 > 0 else F.lit(1.0)
    return F.when(a * b > 0, F.ln(a / b / f) / math.log(nu1 / nu2))


def strip_differences(m1: DataFrame, m2: DataFrame, pixel: list[str], value: str, lon: Column, lat: Column, alphas: list[float], half: float, step: float) -> DataFrame:
    """Mean of m1 - alpha * m2 by alpha and bin of longitude (nearest multiple of ``step``), over pixels with |lat| < half.

    ``lon`` and ``lat`` are expressions over the pixel's columns. Differences of 0 don't count.
    """
    both = m1.select(*pixel, F.col(value).alias("_a")).join(m2.select(*pixel, F.col(value).alias("_b")), pixel).filter(F.abs(lat) < half)
    both = both.select(F.floor(lon / step + 0.5).alias("bin"), "_a", "_b").withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    d = F.col("_a") - F.col("alpha") * F.col("_b")
    return both.filter(d != 0).groupBy("alpha", "bin").agg(F.avg(d).alias("mean"), F.count("*").alias("n"))


def columns_shifted(m: DataFrame, columns: list[str], by: int) -> DataFrame:
    """The values of ``columns`` moved ``by`` columns on, those at the end to the front."""
    n = len(columns)
    moved = {columns[(i + by) % n]: F.col(c) for i, c in enumerate(columns)}
    return m.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in m.columns])


def neighbours(pixels: DataFrame, x: str, y: str, reach: int, metric: str = "disc") -> DataFrame:
    """Each pixel with the cells within ``reach`` of it (nx, ny): cells are generated, not joined, so the cost is linear."""
    d = F.sequence(F.lit(-reach), F.lit(reach))
    got = pixels.withColumn("_dx", F.explode(d)).withColumn("_dy", F.explode(d))
    if metric == "disc":
        got = got.filter(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy") <= reach * reach)
    return got.withColumn("nx", F.col(x) + F.col("_dx")).withColumn("ny", F.col(y) + F.col("_dy")).drop("_dx", "_dy")


def smoothed(pixels: DataFrame, x: str, y: str, value: str, reach: int, sigma: float) -> DataFrame:
    """Gaussian-weighted mean over the disc around each present pixel."""
    near = neighbours(pixels.select(x, y, value), x, y, reach)
    w = F.exp(-(F.pow(F.col("nx") - F.col(x), F.lit(2.0)) + F.pow(F.col("ny") - F.col(y), F.lit(2.0))) / (2 * sigma * sigma))
    sums = near.groupBy("nx", "ny").agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value))
    return pixels.select(x, y).join(sums.withColumnsRenamed({"nx": x, "ny": y}), [x, y])


def mask_edge(pixels: DataFrame, x: str, y: str, mask: str, reach: int) -> DataFrame:
    """``border`` is 0 for pixels whose disc holds both masked and unmasked pixels, else 1."""
    near = neighbours(pixels.select(x, y, mask), x, y, reach).groupBy("nx", "ny").agg(F.min(mask).alias("_lo"), F.max(mask).alias("_hi"))
    return pixels.join(near.withColumnsRenamed({"nx": x, "ny": y}), [x, y]).withColumn("border", F.when(F.col("_lo") == F.col("_hi"), 1).otherwise(0)).drop("_lo", "_hi")


def filled(pixels: DataFrame, x: str, y: str, value: str, reach: int, least: int = 4) -> DataFrame:
    """Missing pixels become the upper median of the smallest disc up to ``reach`` with more than ``least`` values."""
    near = neighbours(pixels.filter(F.col(value).isNotNull()).select(x, y, F.col(value).alias("_v")), x, y, reach)
    d2 = F.pow(F.col("nx") - F.col(x), F.lit(2.0)) + F.pow(F.col("ny") - F.col(y), F.lit(2.0))
    gaps = pixels.filter(F.col(value).isNull()).select(F.col(x).alias("nx"), F.col(y).alias("ny"))
    around = near.withColumn("_ring", F.ceil(F.sqrt(d2))).join(gaps, ["nx", "ny"], "left_semi")
    lists = around.groupBy("nx", "ny").agg(F.collect_list(F.struct("_ring", "_v")).alias("_l"))  # at most a disc of pixels
    within = lambda r: lambda e: e["_ring"] <= r
    got = F.lit(None).cast("double")
    for r in range(reach, 0, -1):
        s = F.sort_array(F.transform(F.filter("_l", within(r)), lambda e: e["_v"]))
        got = F.when(F.size(s) > least, F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))).otherwise(got)
    fills = lists.select(F.col("nx").alias(x), F.col("ny").alias(y), got.alias("_fill"))
    return pixels.join(fills, [x, y], "left").withColumn(value, F.coalesce(value, "_fill")).drop("_fill")


def best_angle(m: DataFrame, q: str, u: str, steps: int) -> DataFrame:
    """The angle among ``steps`` over half a turn that minimises sum((u cos 2a - q sin 2a)^2): from three sums over the map."""
    import math

    s = m.agg(F.sum(F.col(q) * F.col(q)).alias("qq"), F.sum(F.col(u) * F.col(u)).alias("uu"), F.sum(F.col(q) * F.col(u)).alias("qu"))
    a = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i * math.pi / steps))
    c, n = F.cos(2 * F.col("angle")), F.sin(2 * F.col("angle"))
    grid = s.withColumn("angle", a).withColumn("chi2", F.col("uu") * c * c - 2 * F.col("qu") * c * n + F.col("qq") * n * n)
    return grid.agg(F.min_by("angle", F.struct("chi2", "angle")).alias("angle"), F.min("chi2").alias("chi2"))


def remove_monopole_dipole(m: DataFrame, vector: list[str], value: str, mask: str) -> DataFrame:
    """Value minus the masked least-squares fit of an offset and a dipole: ten sums over the map, solved on the driver."""
    import numpy as np

    base = [F.lit(1.0), *[F.col(c) for c in vector]]
    sums = [F.sum(a * b) for i, a in enumerate(base) for b in base[i:]] + [F.sum(a * F.col(value)) for a in base]
    got = [v or 0.0 for v in m.filter(F.col(mask) > 0.5).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).head()]
    n, normal = len(base), np.zeros((len(base), len(base)))
    at = iter(got)
    for i in range(n):
        for j in range(i, n):
            normal[i, j] = normal[j, i] = next(at)
    fit = np.linalg.lstsq(normal, np.array(got[-n:]), rcond=None)[0]
    return m.withColumn(value, F.col(value) - sum(b * float(f) for b, f in zip(base, fit, strict=True)))


def row_index(mask: DataFrame, component: str, pixel: str, flag: str) -> DataFrame:
    """Index from 1 of unmasked pixels, in order, by component."""
    w = Window.partitionBy(component).orderBy(pixel)
    return mask.filter(F.col(flag) > 0).withColumn("index", F.row_number().over(w)).select(component, pixel, "index")
