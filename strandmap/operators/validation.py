"""Validation statistics of streams and spectra, bounds that adapt to each detector, and accept decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stats import confidence_bounds
from .masking import chi2_sigma, status_word


def stream_statistics(df: DataFrame, keys: list[str], index: str, value: str, sigma: str, thin: int = 10) -> DataFrame:
    """chi2 (of every ``thin``-th sample) and largest size in sigmas."""
    z = F.col(value) / F.col(sigma)
    some = F.when(F.col(index) % thin == 0, F.col(value))
    return df.groupBy(*keys).agg(chi2_sigma(some, F.col(sigma)).alias("chi2"), F.max(F.abs(z)).alias("absmax"))


def azimuth_chi2(binned: DataFrame, keys: list[str], value: str, n: str, sigma: str) -> DataFrame:
    """chi2 of azimuth-binned means, each of variance sigma^2 / n."""
    used = binned.filter(F.col(n) > 0)
    return used.groupBy(*keys).agg(chi2_sigma(F.col(value) * F.sqrt(n), F.col(sigma)).alias("chi2_az"))


def fourier_chi2(power: Column, model: Column, weight: Column) -> Column:
    """(sum(w P / N) - sum w) / sqrt(sum w^2)."""
    return (F.sum(weight * power / model) - F.sum(weight)) / F.sqrt(F.sum(weight * weight))


def band_chi2(spectra: DataFrame, keys: list[str], freq: str, power: str, model: str, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Fourier chi2 by named bands [low, high), all in one pass."""
    inside = {n: F.when((F.col(freq) >= a) & (F.col(freq) < b), 1.0).otherwise(0.0) for n, (a, b) in bands.items()}
    return spectra.groupBy(*keys).agg(*[fourier_chi2(F.col(power), F.col(model), w).alias(n) for n, w in inside.items()])


def worst_harmonic(spectra: DataFrame, keys: list[str], freq: str, power: str, model: str, bases: list[float], width: float) -> DataFrame:
    """Largest ratio of power to model near a multiple of any base frequency."""
    near = F.lit(False)
    for b in bases:
        near = near | (F.abs(F.col(freq) - F.round(F.col(freq) / b) * b) <= width)
    return spectra.filter(near & (F.col(freq) > width)).groupBy(*keys).agg(F.max(F.col(power) / F.col(model)).alias("spike"))


def fourier_outlier(spectra: DataFrame, keys: list[str], freq: str, power: str, half: int = 50) -> DataFrame:
    """Largest and smallest running mean of 2 * half + 1 powers over the mean of all."""
    w = Window.partitionBy(*keys).orderBy(freq).rowsBetween(-half, half)
    got = spectra.withColumn("_m", F.avg(power).over(w)).groupBy(*keys).agg(F.max("_m").alias("_hi"), F.min("_m").alias("_lo"), F.avg(power).alias("_all"))
    return got.select(*keys, (F.col("_hi") / F.col("_all")).alias("high"), (F.col("_lo") / F.col("_all")).alias("low"))


def type_b(df: DataFrame, keys: list[str], second: str, demod: str, tp: str, sigma0: str, rate: float) -> DataFrame:
    """Reduced chi2 of the 1 Hz demodulated stream against a line in the 1 Hz total power."""
    sec = df.groupBy(*keys, second).agg(F.avg(demod).alias("_y"), F.avg(tp).alias("_x"), F.first(sigma0).alias("_s"))
    n = F.count("*")
    left = F.regr_syy("_y", "_x") - F.pow(F.regr_sxy("_y", "_x"), F.lit(2.0)) / F.regr_sxx("_y", "_x")
    return sec.groupBy(*keys).agg((left / (F.first("_s") * F.first("_s") / rate) / (n - 2)).alias("type_b"))


def bounded(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """True where a value is out of bounds, NaN or missing."""
    bad = value.isNull() | F.isnan(value.cast("double"))
    for limit, beyond in ((low, lambda v, x: v < x), (high, lambda v, x: v > x)):
        if limit is not None:
            bad = bad | beyond(value, F.lit(limit))
    return bad


def static_cuts(stats: DataFrame, bounds: dict[str, tuple[int, float | None, float | None]], out: str = "status") -> DataFrame:
    """One word from fixed bounds: column -> (bit, low, high)."""
    return stats.withColumn(out, status_word({bit: bounded(F.col(c), lo, hi) for c, (bit, lo, hi) in bounds.items()}))


def adaptive_cuts(stats: DataFrame, detector: list[str], columns: dict[str, tuple[int, float]], out: str = "status") -> DataFrame:
    """Sets bits where a value leaves its detector's own bounds: column -> (bit, k of confidence_bounds)."""
    for c, (bit, k) in columns.items():
        b = confidence_bounds(stats, detector, c, k).withColumnsRenamed({"lower": "_lo", "upper": "_hi"})
        hit = F.when((F.col(c) < F.col("_lo")) | (F.col(c) > F.col("_hi")) | F.isnan(F.col(c).cast("double")) | F.col(c).isNull(), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
        stats = stats.join(b, detector, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0).cast("long")).bitwiseOR(hit)).drop("_lo", "_hi")
    return stats


def weather_cut(values: DataFrame, scan: list[str], value: str, limit: float, share: float) -> DataFrame:
    """Scans in which more than a share of detectors is above the limit."""
    return values.groupBy(*scan).agg(F.avg((F.col(value) > limit).cast("double")).alias("bad")).withColumn("reject", F.col("bad") > share)


def season_summary(stats: DataFrame, target: list[str], word: str, names: dict[int, str]) -> DataFrame:
    """By target and cut, in order of bits: rows cut, and rows left after all cuts up to it."""
    upto, rows = 0, []
    for bit, name in sorted(names.items()):
        upto |= 1 << bit
        rows.append(F.struct(F.lit(bit).alias("bit"), F.lit(name).alias("cut"), (F.col(word).bitwiseAND(F.lit(1 << bit)) != 0).alias("hit"), (F.col(word).bitwiseAND(F.lit(upto)) == 0).alias("left")))
    got = stats.select(*target, F.explode(F.array(*rows)).alias("r"))
    return got.groupBy(*target, "r.bit", "r.cut").agg(F.count_if("r.hit").alias("cut_rows"), F.count_if("r.left").alias("left_rows"))


def report(scans: DataFrame, keys: list[str], status: str, detector: str, scan: str, seconds: str) -> DataFrame:
    """Totals of a reduction by ``keys``: scans, detectors and detector-scans, those accepted (status 0), and hours of each."""
    ok = F.col(status) == 0
    return scans.groupBy(*keys).agg(
        F.countDistinct(scan).alias("scans"),
        F.countDistinct(detector).alias("detectors"),
        F.count("*").alias("rows"),
        F.count_if(ok).alias("accepted"),
        (F.sum(seconds) / 3600).alias("hours"),
        (F.coalesce(F.sum(F.when(ok, F.col(seconds))), F.lit(0.0)) / 3600).alias("accepted_hours"),
    )


def scan_kind(chunks: DataFrame, keys: list[str], az: str, el: str, still: float) -> DataFrame:
    """Mode of each chunk by what moves: stationary, constant elevation, constant azimuth or raster."""
    a, e = F.max(az) - F.min(az), F.max(el) - F.min(el)
    got = chunks.groupBy(*keys).agg(a.alias("_a"), e.alias("_e"))
    fixed_a, fixed_e = F.col("_a") < still, F.col("_e") < still
    return got.select(*keys, F.when(fixed_a & fixed_e, "stationary").when(fixed_e, "ces").when(fixed_a, "cas").otherwise("raster").alias("mode"))


def map_acceptance(m: DataFrame, keys: list[str], value: str, rms: str, most: float, chi: float) -> DataFrame:
    """Largest size in rms and chi2 of maps, and whether both are within limits."""
    got = m.filter(F.col(rms) > 0).groupBy(*keys).agg(F.max(F.abs(F.col(value) / F.col(rms))).alias("absmax"), chi2_sigma(F.col(value), F.col(rms)).alias("chi2"))
    return got.withColumn("accept", (F.col("absmax") <= most) & (F.abs("chi2") <= chi))


def knife_correlation(weights: DataFrame, member: list[str]) -> DataFrame:
    """Correlation of null tests (knife, members, group 1 or 2): +1/n1 and -1/n2 weights, normalised."""
    n = weights.groupBy("knife", "group").agg(F.count("*").alias("_n"))
    w = weights.join(n, ["knife", "group"]).withColumn("_w", F.when(F.col("group") == 1, 1 / F.col("_n")).otherwise(-1 / F.col("_n")))
    a, b = w.select(*member, F.col("knife").alias("i"), F.col("_w").alias("_a")), w.select(*member, F.col("knife").alias("j"), F.col("_w").alias("_b"))
    c = a.join(b, member).groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))
    from .matrices import correlation

    return correlation(c)
