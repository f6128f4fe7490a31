"""Likelihoods on grids and Gauss-Newton fits of a few parameters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import fields


def grid(df: DataFrame, names: dict[str, tuple[float, float, int]]) -> DataFrame:
    """All combinations of evenly spaced parameters: name -> (low, high, steps)."""
    out = df.sparkSession.range(1).select()
    for n, (a, b, k) in names.items():
        out = out.withColumn(n, F.explode(F.array(*[F.lit(float(v)) for v in np.linspace(a, b, k)])))
    return out


def line_grid(points: DataFrame, x: str, y: str, sx: str, sy: str, slope: tuple[float, float, int], offset: tuple[float, float, int]) -> DataFrame:
    """chi2 of y = slope x + offset with errors in both, on a grid. For each slope the chi2 is quadratic in the offset, so
    three sums over the points by slope give the whole grid."""
    s = grid(points, {"slope": slope})
    d, v = F.col(y) - F.col("slope") * F.col(x), F.col(sy) * F.col(sy) + F.col("slope") * F.col("slope") * F.col(sx) * F.col(sx)
    sums = points.crossJoin(F.broadcast(s)).groupBy("slope").agg(F.sum(d * d / v).alias("dd"), F.sum(d / v).alias("d1"), F.sum(1 / v).alias("n"))  # slopes: a fixed few
    o = grid(points, {"offset": offset})
    return sums.crossJoin(F.broadcast(o)).select("slope", "offset", (F.col("dd") - 2 * F.col("offset") * F.col("d1") + F.col("offset") * F.col("offset") * F.col("n")).alias("chi2"))


def zoomed_line(points: DataFrame, x: str, y: str, sx: str, sy: str, slope: tuple[float, float], offset: tuple[float, float], steps: int = 100, within: float = 11.8) -> tuple[float, float, float]:
    """(slope, offset, chi2) of least chi2: a first grid, then one over the part within ``within`` of its minimum."""
    best = None
    for _ in range(2):
        g = line_grid(points, x, y, sx, sy, (*slope, steps), (*offset, steps)).cache()
        best = g.orderBy("chi2", "slope", "offset").first()
        e = g.filter(F.col("chi2") <= best["chi2"] + within).agg(F.min("slope"), F.max("slope"), F.min("offset"), F.max("offset")).head()
        ds, do = (slope[1] - slope[0]) / steps, (offset[1] - offset[0]) / steps
        slope, offset = (e[0] - ds, e[1] + ds), (e[2] - do, e[3] + do)
        g.unpersist()
    return best["slope"], best["offset"], best["chi2"]


def gauss_newton(model, start: np.ndarray, data: np.ndarray, weight: np.ndarray, steps: int = 50, tol: float = 1e-10) -> np.ndarray:
    """Damped least squares of a model(parameters) -> values."""
    p, damp = np.array(start, float), 1e-3
    r = data - model(p)
    cost = float((weight * r * r).sum())
    for _ in range(steps):
        jac = np.stack([(model(p + e) - model(p - e)) / (2 * h) for i in range(len(p)) for h in [1e-6 * max(1.0, abs(p[i]))] for e in [np.eye(len(p))[i] * h]], 1)
        a, b = jac.T @ (weight[:, None] * jac), jac.T @ (weight * r)
        new = p + np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-30), b)
        r2 = data - model(new)
        c2 = float((weight * r2 * r2).sum())
        if c2 < cost:
            done = cost - c2 <= tol * cost
            p, r, cost, damp = new, r2, c2, damp / 5
            if done:
                break
        else:
            damp *= 5
    return p


def gaussian_model(x: np.ndarray, y: np.ndarray):
    return lambda p: p[0] * np.exp(-((x - p[1]) ** 2 + (y - p[2]) ** 2) / (2 * p[3] ** 2)) + p[4]


def fit_gaussians(df: DataFrame, keys: list[str], x: str, y: str, value: str, weight: str) -> DataFrame:
    """amplitude, x0, y0, width and offset of a round Gaussian by group (a patch of pixels around a source)."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        xs, ys, v, w = (p[c].to_numpy(float) for c in (x, y, value, weight))
        top = int(np.argmax(v))
        start = [v.max() - np.median(v), xs[top], ys[top], max(1e-6, (np.ptp(xs) + np.ptp(ys)) / 8), np.median(v)]
        fit = gauss_newton(gaussian_model(xs, ys), np.array(start), v, w)
        fit[3] = abs(fit[3])
        return p[keys].head(1).assign(**dict(zip(("amplitude", "x0", "y0", "width", "offset"), fit, strict=True)))

    kind = ", ".join(f"{c} double" for c in ("amplitude", "x0", "y0", "width", "offset"))
    return df.select(*keys, x, y, value, weight).groupBy(*keys).applyInPandas(run, f"{fields(df, keys)}, {kind}")


def fit_template(df: DataFrame, keys: list[str], value: str, template: str, rms: str) -> DataFrame:
    """Amplitude of a template and its sigma by group."""
    w = 1 / (F.col(rms) * F.col(rms))
    t: Column = F.col(template)
    return df.groupBy(*keys).agg((F.sum(w * t * F.col(value)) / F.sum(w * t * t)).alias("amplitude"), (1 / F.sqrt(F.sum(w * t * t))).alias("sigma"))


def orthogonal_slope(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope of the line of least perpendicular distance."""
    d = (F.var_samp(x) - F.var_samp(y)) / (2 * F.covar_samp(x, y))
    return df.groupBy(*keys).agg((-d + F.signum(F.covar_samp(x, y)) * F.sqrt(1 + d * d)).alias("slope"))
