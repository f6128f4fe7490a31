"""Maximum-likelihood maps: noise-weighted normal equations by preconditioned conjugate gradients over DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels


def _weighted(tod: DataFrame, scan: list[str], order: str, value: str, rate: float) -> DataFrame:
    """N^-1 of each scan's stream, by its own sigma0, fknee and alpha, in Fourier space (mirrored)."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order)
        s, f, a = (float(p[c].iloc[0]) for c in ("sigma0", "fknee", "alpha"))
        x = kernels.filtered(p[value].to_numpy(float), rate, lambda q: kernels.inverse_noise(q, s, f, a))
        return p[[*scan, order]].assign(**{value: x})

    return tod.select(*scan, order, value, "sigma0", "fknee", "alpha").groupBy(*scan).applyInPandas(run, f"{kernels.fields(tod, [*scan, order])}, `{value}` double")


def make_map(tod: DataFrame, scan: list[str], order: str, pixel: list[str], value: str, rate: float, steps: int = 30, tol: float = 1e-6) -> DataFrame:
    """Solves P^T N^-1 P m = P^T N^-1 d; ``tod`` carries sigma0, fknee and alpha of its scan.

    Each step reads the map at each sample (a join by pixel), weights each scan's stream in its own group, and sums by
    pixel; the preconditioner is hits over variance. Sums over pixels alone come to the driver. checkpoint() cuts the
    lineage of the map-sized vectors.
    """
    keys = [*scan, order]
    point = tod.select(*keys, *pixel, "sigma0", "fknee", "alpha").checkpoint()

    def binned(stream: DataFrame) -> DataFrame:
        return stream.join(point.select(*keys, *pixel), keys).groupBy(*pixel).agg(F.sum(value).alias("_v"))

    rhs = binned(_weighted(tod, scan, order, value, rate))
    diag = point.groupBy(*pixel).agg(F.sum(1 / (F.col("sigma0") * F.col("sigma0"))).alias("diag"))
    x = rhs.join(diag, pixel).select(*pixel, F.lit(0.0).alias("m"), F.col("_v").alias("r"), "diag", (F.col("_v") / F.col("diag")).alias("p")).checkpoint()
    rz = first = x.agg(F.sum(F.col("r") * F.col("r") / F.col("diag"))).head()[0] or 0.0
    for _ in range(steps):
        if rz <= tol * tol * first or rz == 0:
            break
        seen = point.join(x.select(*pixel, F.col("p").alias(value)), pixel)
        x = x.join(binned(_weighted(seen, scan, order, value, rate)), pixel).checkpoint()
        alpha = rz / x.agg(F.sum(F.col("p") * F.col("_v"))).head()[0]
        x = x.withColumn("m", F.col("m") + alpha * F.col("p")).withColumn("r", F.col("r") - alpha * F.col("_v")).drop("_v")
        new = x.agg(F.sum(F.col("r") * F.col("r") / F.col("diag"))).head()[0]
        x, rz = x.withColumn("p", F.col("r") / F.col("diag") + new / rz * F.col("p")), new
    return x.select(*pixel, "m")
