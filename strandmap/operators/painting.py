"""Shapes on maps: discs, strips, boxes, sources and clusters, as predicates and profiles of pixel directions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.angles import difference, distance


def disc(lon: Column, lat: Column, lon0: float, lat0: float, radius: float) -> Column:
    return distance(lon, lat, F.lit(lon0), F.lit(lat0)) <= radius


def strip(lat: Column, low: float, high: float) -> Column:
    return (lat >= low) & (lat <= high)


def box(lon: Column, lat: Column, lon0: float, lat0: float, width: float, height: float, flat: bool = False) -> Column:
    """Sides in longitude (true angles unless ``flat``) and latitude."""
    d = F.abs(difference(lon, F.lit(lon0)))
    return ((d if flat else d * F.cos(lat)) <= width / 2) & (F.abs(lat - lat0) <= height / 2)


def paint(m: DataFrame, value: str, shape: Column, what: float, mode: str = "replace") -> DataFrame:
    """Replaces or adds to the value inside a shape."""
    new = F.lit(float(what)) if mode == "replace" else F.coalesce(value, F.lit(0.0)) + what
    return m.withColumn(value, F.when(shape, new).otherwise(F.col(value)))


def near_sources(pixels: DataFrame, sources: DataFrame, reach: float, cell: float) -> DataFrame:
    """Pixels (lon, lat) with the sources (slon, slat) within ``reach``, and the distance: an equi-join on cells of latitude."""
    s = sources.withColumn("_cell", F.explode(F.sequence(F.floor((F.col("slat") - reach) / cell), F.floor((F.col("slat") + reach) / cell))))
    got = pixels.withColumn("_cell", F.floor(F.col("lat") / cell)).join(s, "_cell").withColumn("dist", distance(F.col("lon"), F.col("lat"), F.col("slon"), F.col("slat")))
    return got.filter(F.col("dist") <= reach).drop("_cell")


def source_map(pixels: DataFrame, sources: DataFrame, pixel: str, fwhm: float, cell: float) -> DataFrame:
    """Gaussian sources of given ``flux``, each normalised over its own pixels within five sigma."""
    sigma = fwhm / math.sqrt(8 * math.log(2))
    near = near_sources(pixels, sources, 5 * sigma, cell).withColumn("_g", F.exp(-F.col("dist") * F.col("dist") / (2 * sigma * sigma)))
    each = near.withColumn("_n", F.sum("_g").over(Window.partitionBy("slon", "slat", "flux")))  # a source's disc of pixels
    return each.groupBy(pixel).agg(F.sum(F.col("flux") * F.col("_g") / F.col("_n")).alias("v"))


def pressure_profile(x: Column, p0: float, c500: float, gamma: float, alpha: float, beta: float) -> Column:
    """Generalised NFW pressure at radius x, in units of R500."""
    r = c500 * x
    return p0 / (F.pow(r, F.lit(gamma)) * F.pow(1 + F.pow(r, F.lit(alpha)), F.lit((beta - gamma) / alpha)))


def add_clusters(pixels: DataFrame, clusters: DataFrame, pixel: str, reach: float, cell: float, profile: tuple[float, float, float, float, float]) -> DataFrame:
    """Sum of cluster profiles (columns slon, slat, r500 angle, amplitude) over the pixels within ``reach``."""
    near = near_sources(pixels, clusters, reach, cell)
    x = F.greatest(F.col("dist") / F.col("r500"), F.lit(1e-3))
    return near.groupBy(pixel).agg(F.sum(F.col("amplitude") * pressure_profile(x, *profile)).alias("v"))


def calmest_patch(pixels: DataFrame, centres: DataFrame, value: str, mask: str, radius: float, cell: float) -> DataFrame:
    """Mean and deviation in a disc about each centre of which at least half is unmasked; the calmest first."""
    near = near_sources(pixels, centres, radius, cell)
    ok = F.col(mask) > 0.5
    got = near.groupBy("slon", "slat").agg(F.avg(F.when(ok, F.col(value))).alias("mean"), F.stddev_pop(F.when(ok, F.col(value))).alias("rms"), F.avg(ok.cast("double")).alias("open"))
    return got.filter("open >= 0.5").orderBy("rms")


def angle_moments(samples: DataFrame, pixel: str, psi: str, most: int) -> DataFrame:
    """By pixel and spin s up to ``most``: mean cos and sin of s times the detector's angle, and hits."""
    each = samples.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(most))))
    return each.groupBy(pixel, "s").agg(F.avg(F.cos(F.col("s") * F.col(psi))).alias("cos"), F.avg(F.sin(F.col("s") * F.col(psi))).alias("sin"), F.count("*").alias("hits"))


def sun_mask(pixels: DataFrame, pixel: str, value: str, levels: int, limit: float) -> DataFrame:
    """Nested pixels to mask: all children of a pixel i levels coarser whose mean times 2^i exceeds the limit."""
    hit = None
    for i in range(levels + 1):
        coarse = F.shiftright(pixel, 2 * i)
        bad = pixels.groupBy(coarse.alias("_c")).agg(F.avg(value).alias("_v")).filter(F.col("_v") * 2**i > limit).select("_c")
        of = pixels.withColumn("_c", coarse).join(bad, "_c", "left_semi").select(pixel)
        hit = of if hit is None else hit.union(of)
    return hit.distinct()


def focal_plane(theta: Column, phi: Column) -> tuple[Column, Column]:
    return theta * F.cos(phi), theta * F.sin(phi)


def tilt(x: Column, y: Column) -> tuple[Column, Column]:
    """(direction, size) of a mean tilt."""
    return F.atan2(y, x), F.sqrt(x * x + y * y)
