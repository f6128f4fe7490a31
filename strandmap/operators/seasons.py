"""Statistics over many scans and detectors, and models against tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels


def pixel_covariance(samples: DataFrame, scan: list[str], index: str, pixel: str, kernel: list[float]) -> DataFrame:
    """(i, j, v): kernel[lag] summed over pairs of samples of a scan at most len(kernel) - 1 apart. Lags are generated, so the
    join is by sample and its cost the samples times the lags."""
    lags = F.explode(F.sequence(F.lit(-(len(kernel) - 1)), F.lit(len(kernel) - 1)))
    a = samples.select(*scan, F.col(index).alias("_i"), F.col(pixel).alias("i"), lags.alias("_lag")).withColumn(index, F.col("_i") + F.col("_lag"))
    b = samples.select(*scan, index, F.col(pixel).alias("j"))
    weight = F.get(F.array(*[F.lit(float(k)) for k in kernel]), F.abs("_lag"))
    return a.join(b, [*scan, index]).groupBy("i", "j").agg(F.sum(weight).alias("v"))


def fourier(df: DataFrame, keys: list[str], order: str, value: str, rate: float) -> DataFrame:
    """freq, re and im by channel, above frequency 0."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x = p.sort_values(order)[value].to_numpy(float)
        f = np.fft.rfft(x)[1:]
        out = pd.DataFrame({"freq": np.fft.rfftfreq(len(x), 1 / rate)[1:], "re": f.real, "im": f.imag})
        for k in keys:
            out[k] = p[k].iloc[0]
        return out[[*keys, "freq", "re", "im"]]

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, f"{kernels.fields(df, keys)}, freq double, re double, im double")


def exponential_bin(freq: Column, lowest: float, per_octave: int) -> Column:
    return F.floor(F.log2(freq / lowest) * per_octave).cast("int")


def mode_correlation(modes: DataFrame, scan: list[str], detector: str, lowest: float, per_octave: int) -> DataFrame:
    """Mean over modes of Re(f1 f2*) / (|f1| |f2|) by pair of detectors and exponential frequency bin, and how many."""
    unit = modes.withColumn("_s", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).filter("_s > 0").select(*scan, "freq", F.col(detector).alias("d"), (F.col("re") / F.col("_s")).alias("re"), (F.col("im") / F.col("_s")).alias("im"))
    a, b = unit.withColumnsRenamed({"d": "d1", "re": "_ar", "im": "_ai"}), unit.withColumnsRenamed({"d": "d2", "re": "_br", "im": "_bi"})
    both = a.join(b, [*scan, "freq"]).filter("d1 < d2")
    return both.groupBy("d1", "d2", exponential_bin(F.col("freq"), lowest, per_octave).alias("bin")).agg(F.avg(F.col("_ar") * F.col("_br") + F.col("_ai") * F.col("_bi")).alias("corr"), F.count("*").alias("n"))


def ratio_moments(df: DataFrame, keys: list[str], ratio: str, weight: str) -> DataFrame:
    """Weighted mean and deviation of spectrum-to-model ratios, and the mean's sigma, by any keys (bin, detector, model, weighting)."""
    w, c = F.col(weight), F.col(ratio)
    got = df.groupBy(*keys).agg(F.sum(w).alias("_w"), F.sum(w * c).alias("_1"), F.sum(w * c * c).alias("_2"))
    mean = F.col("_1") / F.col("_w")
    return got.select(*keys, mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("_2") / F.col("_w") - mean * mean)).alias("dev"), (1 / F.sqrt("_w")).alias("sigma"))


def detector_correlation(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean covariance and correlation of pairs (corr, noise1, noise2) over scans: cov, cov2, corr and n by keys."""
    v = F.col("corr") * F.col("noise1") * F.col("noise2")
    return rows.groupBy(*keys).agg(F.avg(v).alias("cov"), F.avg(v * v).alias("cov2"), F.avg("corr").alias("corr"), F.count("*").alias("n"))


def gain_sums(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Inverse correlations scaled by both gains over both noises, summed over scans whose gains are known."""
    ok = F.col("gain1").isNotNull() & F.col("gain2").isNotNull() & (F.col("sigma1") > 0) & (F.col("sigma2") > 0)
    return pairs.filter(ok).groupBy(*keys).agg(F.sum(F.col("icorr") * F.col("gain1") * F.col("gain2") / (F.col("sigma1") * F.col("sigma2"))).alias("v"), F.count("*").alias("n"))


def best_curve(data: DataFrame, curves: DataFrame, weights: DataFrame) -> DataFrame:
    """chi2 of each model curve (curve, i, model) against data (i, value) under an inverse covariance (i, j, w), least first."""
    r = curves.join(data, "i").select("curve", "i", (F.col("value") - F.col("model")).alias("r"))
    left = r.join(weights, "i").select("curve", "j", (F.col("r") * F.col("w")).alias("_l")).groupBy("curve", "j").agg(F.sum("_l").alias("_l"))
    both = left.join(r.select("curve", F.col("i").alias("j"), F.col("r").alias("_r")), ["curve", "j"])
    return both.groupBy("curve").agg(F.sum(F.col("_l") * F.col("_r")).alias("chi2")).orderBy("chi2")


def template_free(corr: DataFrame, templates: list[DataFrame]) -> tuple[DataFrame, list[float]]:
    """A correlation table (i, j, v) minus its least-squares combination of template tables, and the amplitudes."""
    rows = corr
    for k, t in enumerate(templates):
        rows = rows.join(t.select("i", "j", F.col("v").alias(f"_t{k}")), ["i", "j"], "left").fillna(0.0, [f"_t{k}"])
    n = len(templates)
    sums = [F.sum(F.col(f"_t{a}") * F.col(f"_t{b}")) for a in range(n) for b in range(n)] + [F.sum(F.col(f"_t{a}") * F.col("v")) for a in range(n)]
    got = np.array([v or 0.0 for v in rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).head()])
    amp = np.linalg.lstsq(got[: n * n].reshape(n, n), got[n * n :], rcond=None)[0]
    fit = sum((F.col(f"_t{k}") * float(a) for k, a in enumerate(amp)), F.lit(0.0))
    return rows.select("i", "j", (F.col("v") - fit).alias("v")), amp.tolist()


def mini_maps(pixels: DataFrame, positions: DataFrame, cov: DataFrame, radius: float, cell: float) -> tuple[DataFrame, DataFrame]:
    """Pixels (pix, lon, lat, v) in a disc about each position, and the blocks of a covariance (i, j, v) between them."""
    from .painting import near_sources

    near = near_sources(pixels.filter(F.col("v").isNotNull()), positions, radius, cell)
    ids = near.select("slon", "slat", "pix")
    block = cov.join(ids.withColumnRenamed("pix", "i"), "i").join(ids.withColumnRenamed("pix", "j"), ["slon", "slat", "j"]).select("slon", "slat", "i", "j", "v")
    return near, block


def seed_regions(m: DataFrame, pixel: str, value: str, least: float, apart: float, most: int) -> DataFrame:
    """Regions of a map (lon, lat): 1 below a threshold; above it the nearest of seeds, which are the brightest pixels chosen
    one after the other, each at least ``apart`` from those before. Seeds are few (``most`` at most)."""
    from ..functions.angles import distance

    bright = m.filter(F.col(value) >= least)
    seeds: list[tuple[float, float]] = []
    far = F.lit(True)
    while len(seeds) < most:
        top = bright.filter(far).orderBy(F.col(value).desc(), pixel).select("lon", "lat").first()
        if top is None:
            break
        seeds.append((top["lon"], top["lat"]))
        far = far & (distance(F.col("lon"), F.col("lat"), F.lit(seeds[-1][0]), F.lit(seeds[-1][1])) > apart)
    if not seeds:
        return m.withColumn("region", F.lit(1))
    nearest = F.array_min(F.array(*[F.struct(distance(F.col("lon"), F.col("lat"), F.lit(a), F.lit(b)).alias("d"), F.lit(k).alias("k")) for k, (a, b) in enumerate(seeds, 2)]))
    return m.withColumn("region", F.when(F.col(value) < least, 1).otherwise(nearest["k"]))


def sweeps(df: DataFrame, keys: list[str], order: str, az: str) -> DataFrame:
    """Numbers runs of one direction of azimuth."""
    from .timeseries import channel, islands

    up = F.signum(F.col(az) - F.lag(az).over(channel(keys, order)))
    return islands(df.withColumn("_u", up), keys, order, F.coalesce(F.nullif(F.col("_u"), F.lit(0.0)), F.lit(1.0)), "sweep").drop("_u")


def sweep_slopes_removed(df: DataFrame, keys: list[str], order: str, az: str, value: str) -> DataFrame:
    """value minus, in each sweep, the median of pairwise slopes times azimuth, the sweep's mean kept. Pairs stay within a sweep."""
    from .fits import median_slope

    s = sweeps(df, keys, order, az)
    slope = median_slope(s, [*keys, "sweep"], az, value).select(*keys, "sweep", F.col("slope").alias("_a"))
    mean = s.groupBy(*keys, "sweep").agg(F.avg(az).alias("_m"))
    joined = s.join(slope, [*keys, "sweep"], "left").join(mean, [*keys, "sweep"])
    return joined.withColumn(value, F.col(value) - F.coalesce("_a", F.lit(0.0)) * (F.col(az) - F.col("_m"))).drop("_a", "_m")


def weather_template(df: DataFrame, scan: list[str], order: str, value: str, rate: float, cut: float) -> DataFrame:
    """The slow part of the mean over channels, by scan."""
    mean = df.groupBy(*scan, order).agg(F.avg(value).alias(value))
    return kernels.per_channel(mean, scan, order, value, lambda x: kernels.lowpassed(x, rate, cut, 8))


def gain_rows_ok(df: DataFrame) -> Column:
    """Fraction within 0.3 of -1, amplitude not 0 and at most 40, at most 0.6 degrees from the centre; limits are fixed values."""
    return (F.abs(F.col("fraction") + 1) <= 0.3) & (F.col("amplitude") != 0) & (F.abs("amplitude") <= 40) & (F.col("distance") <= math.radians(0.6))


def transport_angle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Turn of a polarisation's reference when it is carried along the great circle from one point to another."""
    d = lon2 - lon1
    a = F.atan2(F.sin(d) * F.cos(lat2), F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(d))
    b = F.atan2(F.sin(d) * F.cos(lat1), -F.cos(lat2) * F.sin(lat1) + F.sin(lat2) * F.cos(lat1) * F.cos(d))
    return b - a


def feed_pair_spectra(cubes: DataFrame, feed: str, edges: list[float], steps: tuple[float, float, float]) -> DataFrame:
    """Cross spectra of all pairs i < j of feeds of cubes (feed, x, y, z, v): one group a pair, of two cubes. Feeds are few."""
    feeds = cubes.select(F.col(feed).alias("i")).distinct()
    pairs = feeds.crossJoin(F.broadcast(feeds.withColumnRenamed("i", "j"))).filter("i < j")  # tens of feeds
    sides = pairs.select("i", "j", F.explode(F.array("i", "j")).alias(feed))
    rows = cubes.select(feed, "x", "y", "z", "v").join(F.broadcast(sides), feed)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        i, j = p["i"].iloc[0], p["j"].iloc[0]
        shape = [int(p[c].max()) + 1 for c in "xyz"]
        a, b = np.zeros(shape), np.zeros(shape)
        for cube, k in ((a, i), (b, j)):
            q = p[p[feed] == k]
            cube[q["x"], q["y"], q["z"]] = q["v"]
        s, n = kernels.cube_spectrum(a, b, np.array(edges), steps)
        return pd.DataFrame({"i": i, "j": j, "bin": np.arange(len(s)), "power": s, "modes": n})

    kind = cubes.schema[feed].dataType.simpleString()
    return rows.groupBy("i", "j").applyInPandas(run, f"i {kind}, j {kind}, bin int, power double, modes long")
