"""Destriping: baselines of a long stream solved together with its map, as distributed conjugate gradients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def destripe(tod: DataFrame, pixel: list[str], baseline: list[str], value: str, weight: str, steps: int = 50, tol: float = 1e-6, ridge: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(baselines, map): offsets a by baseline that minimise the scatter of value - a about a common map.

    What the samples say is summed once into pairs (pixel, baseline) -> weight and weighted value; each step is two
    joins and two aggregations of that table, which is as small as the scan pattern is, and three numbers on the
    driver. The lineage is cut by checkpoint() at every step.
    """
    spark = tod.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        raise ValueError("set a checkpoint directory")
    w = F.col(weight)
    hits = tod.groupBy(*pixel, *baseline).agg(F.sum(w).alias("w"), F.sum(w * F.col(value)).alias("wd")).checkpoint()
    per_pixel = hits.groupBy(*pixel).agg(F.sum("w").alias("W"), F.sum("wd").alias("WD")).checkpoint()
    diag = hits.groupBy(*baseline).agg((F.sum("w") * (1 + ridge)).alias("diag"))

    def off_map(v: DataFrame, col: str) -> DataFrame:
        """F^T Z F v: weighted offsets less their own binned map, by baseline."""
        spread = hits.join(v.select(*baseline, F.col(col).alias("_v")), baseline)
        binned = spread.groupBy(*pixel).agg(F.sum(F.col("w") * F.col("_v")).alias("_b")).join(per_pixel, pixel).select(*pixel, (F.col("_b") / F.col("W")).alias("_m"))
        return spread.join(binned, pixel).groupBy(*baseline).agg(F.sum(F.col("w") * (F.col("_v") * (1 + ridge) - F.col("_m"))).alias("_q"))

    rhs = hits.join(per_pixel.select(*pixel, (F.col("WD") / F.col("W")).alias("_m")), pixel).groupBy(*baseline).agg(F.sum(F.col("wd") - F.col("w") * F.col("_m")).alias("r"))
    state = rhs.join(diag, baseline).select(*baseline, F.lit(0.0).alias("a"), "r", "diag", (F.col("r") / F.col("diag")).alias("p")).checkpoint()
    rz = first = state.agg(F.sum(F.col("r") * F.col("r") / F.col("diag"))).head()[0] or 0.0
    for _ in range(steps):
        if rz <= tol * tol * first or rz == 0:
            break
        state = state.join(off_map(state, "p"), baseline).checkpoint()
        alpha = rz / state.agg(F.sum(F.col("p") * F.col("_q"))).head()[0]
        state = state.withColumn("a", F.col("a") + alpha * F.col("p")).withColumn("r", F.col("r") - alpha * F.col("_q")).drop("_q")
        new = state.agg(F.sum(F.col("r") * F.col("r") / F.col("diag"))).head()[0]
        state, rz = state.withColumn("p", F.col("r") / F.col("diag") + new / rz * F.col("p")), new
    base = state.select(*baseline, "a")
    cleaned = hits.join(base, baseline)
    sums = cleaned.groupBy(*pixel).agg(F.sum(F.col("wd") - F.col("w") * F.col("a")).alias("s"), F.sum("w").alias("w"))
    return base, sums.select(*pixel, (F.col("s") / F.col("w")).alias("m"), (1 / F.sqrt("w")).alias("rms"))
