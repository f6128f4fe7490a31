"""Whole plans: a raw stream to a calibrated one, streams to maps, maps to spectra."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import binning, fits, kernels, masking, timeseries


def level2(raw: DataFrame, rate: float, gain_cut: float, gain_alpha: float, degree: int, components: int, time_step: int, freq_step: int) -> DataFrame:
    """Rows (scan_id, feed, sb, freq, i, value) to calibrated, filtered and decimated ones.

    Masks channels with NaNs or zeros alone, fills isolated NaNs before that, divides by the slow gain, takes a
    polynomial over channels and common modes out, and averages with inverse-variance weights. A feed's sideband of a
    scan is one group, and all per-group kernels run in that one group, so samples move once for them.
    """
    side, chan = ["scan_id", "feed", "sb"], ["scan_id", "feed", "sb", "freq"]
    filled = timeseries.fill_isolated(raw, chan, "i", "value")
    mask = masking.channel_reasons(filled, chan, "value").filter("ok").select(*chan)
    good = filled.join(mask, chan, "left_semi")

    def clean(m: np.ndarray) -> np.ndarray:
        m = np.stack([kernels.gain_normalised(c, rate, gain_cut, gain_alpha) for c in m.T], 1)
        m = kernels.polynomial_filtered(m, np.ones(m.shape[1], bool), min(degree, m.shape[1] - 1))
        return kernels.without_components(m, min(components, m.shape[1])) if components else m

    cleaned = kernels.per_feed(good, side, "i", "freq", "value", clean)
    noise = timeseries.white_noise(cleaned, chan, "i", "value").withColumn("w", F.when(F.col("sigma0") > 0, 1 / (F.col("sigma0") * F.col("sigma0"))).otherwise(0.0))
    weighted = cleaned.join(noise, chan)
    w = F.sum("w")
    return weighted.groupBy(*side, F.floor(F.col("freq") / freq_step).alias("freq"), F.floor(F.col("i") / time_step).alias("i")).agg((F.sum(F.col("w") * F.col("value")) / w).alias("value"), (w * 1.0).alias("weight"))


def make_maps(streams: DataFrame, pointing: DataFrame, grid: tuple[float, float, float, float, int, int], splits: dict | None = None) -> dict[str, DataFrame]:
    """Maps from streams (scan_id, feed, sb, freq, i, value, weight) and pointing (scan_id, feed, i, ra, dec).

    grid: x0, y0, dx, dy, nx, ny. The outermost pixels take no samples. One join by sample and one aggregation make
    the feed maps; the co-add comes from their sums.
    """
    from ..functions.angles import grid_index

    x0, y0, dx, dy, nx, ny = grid
    p = pointing.select("scan_id", "feed", "i", grid_index(F.col("ra"), x0, dx, nx, 1).alias("x"), grid_index(F.col("dec"), y0, dy, ny, 1).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    hit = streams.join(p, ["scan_id", "feed", "i"])
    sums = binning.accumulate(hit, ["x", "y", "freq", "sb", "feed"], F.col("value"), F.col("weight"))
    out = {"levels": binning.finalised(binning.at_levels(sums, ["x", "y", "freq", "sb"], [["feed"], []], ["feed", "coadd"]))}
    if splits:
        halves = binning.split_halves(hit, splits)
        out["splits"] = binning.finalised(binning.accumulate(halves, ["split", "half", "x", "y", "freq", "sb"], F.col("value"), F.col("weight")))
    return out


def cube_spectra(cubes: DataFrame, keys: list[str], edges: list[float], steps: tuple[float, float, float]) -> DataFrame:
    """Spherically averaged spectra of cubes (keys, x, y, z, v), one group a cube; missing cells are 0."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        cube = np.zeros([int(p[c].max()) + 1 for c in "xyz"])
        cube[p["x"], p["y"], p["z"]] = p["v"]
        s, n = kernels.cube_spectrum(cube, cube, np.array(edges), steps)
        out = pd.DataFrame({"bin": np.arange(len(s)), "power": s, "modes": n})
        for k in keys:
            out[k] = p[k].iloc[0]
        return out[[*keys, "bin", "power", "modes"]]

    return cubes.groupBy(*keys).applyInPandas(run, f"{kernels.fields(cubes, keys)}, bin int, power double, modes long")


def transfer_function(out: DataFrame, noise: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """(P_out - P_noise) / P_in by bin."""
    j = out.select(*keys, F.col("power").alias("o")).join(noise.select(*keys, F.col("power").alias("n")), keys).join(given.select(*keys, F.col("power").alias("g")), keys)
    return j.select(*keys, F.try_divide(F.col("o") - F.col("n"), F.col("g")).alias("transfer"))


def mean_cross_spectrum(pairs: DataFrame, bins: str, power: str, sigma: str, chi: str, a: str, b: str, most: float = 5.0) -> DataFrame:
    """Inverse-variance mean over pairs of different feeds whose chi is below ``most`` in size."""
    w = 1 / (F.col(sigma) * F.col(sigma))
    good = pairs.filter((F.abs(chi) < most) & (F.col(a) != F.col(b)))
    return good.groupBy(bins).agg((F.sum(w * F.col(power)) / F.sum(w)).alias(power), (1 / F.sqrt(F.sum(w))).alias(sigma))


def noise_realisations(df: DataFrame, rms: str, value: str, n: int, seed: int) -> DataFrame:
    """n noise maps, each a draw by the map's rms: rows times n, drawn where they are."""
    return df.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(value, F.randn(seed) * F.col(rms))


def chunk_templates(df: DataFrame, keys: list[str], time: str, chunk: float, x: str, y: str) -> DataFrame:
    """y without its slope against x (azimuth, or 1/sin of elevation) in each chunk of time, the chunk's mean kept."""
    return fits.remove_slope(df.withColumn("chunk", F.floor(F.col(time) / chunk)), [*keys, "chunk"], x, y)


