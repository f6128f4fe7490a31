"""Matrices as (i, j, v) rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship


#: Samples whose products a task takes at once.
SAMPLES = 512


#: Rows and columns of the blocks that are multiplied.
BLOCK = 256


def multiply(a: DataFrame, b: DataFrame, block: int = BLOCK) -> DataFrame:
    """Matrix product, block by block, so that a product of n x n entries shuffles n^3 / block rows at most.

    Indices are whole numbers, an entry is one row, and a null entry counts as absent. The result has the entries for
    which some k holds both factors, as doubles.
    """
    ship(a.sparkSession)

    def blocks(m: DataFrame, row: str, col: str) -> DataFrame:
        at = [F.col(c).cast("long") for c in "ij"]
        cell = F.struct(*[F.pmod(c, F.lit(block)).cast("int").alias(n) for c, n in zip(at, "rc", strict=True)], F.col("v").cast("double").alias("v"))
        return m.filter("v IS NOT NULL").groupBy(*[F.floor(c / block).alias(n) for c, n in zip(at, (row, col), strict=True)]).agg(F.collect_list(cell).alias(f"{row}{col}"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                sides = []
                for side in ("IK", "KJ"):
                    cells = batch.column(side).slice(n, 1).flatten()
                    r, c = cells.field("r").to_numpy(), cells.field("c").to_numpy()
                    m, held = np.zeros((block, block)), np.zeros((block, block), np.float32)
                    m[r, c], held[r, c] = cells.field("v").to_numpy(), 1
                    sides.append((m, held))
                (x, hx), (y, hy) = sides
                i, j = np.nonzero(hx @ hy)
                at = [batch.column(s)[n].as_py() * block for s in "IJ"]
                yield pa.RecordBatch.from_arrays([pa.array(i + at[0]), pa.array(j + at[1]), pa.array((x @ y)[i, j])], ["i", "j", "v"])

    pairs = blocks(a, "I", "K").join(blocks(b, "K", "J"), "K").select("I", "J", "IK", "KJ")
    got = pairs.mapInArrow(products, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return got.select(F.col("i").cast(a.schema["i"].dataType).alias("i"), F.col("j").cast(b.schema["j"].dataType).alias("j"), "v")


def transposed(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def smoothed_variance(variance: DataFrame, weights: DataFrame) -> DataFrame:
    """Variances (i, x) of a map after smoothing by weights (i, j, v): the sum of v^2 x over j."""
    return apply(weights.select("i", "j", (F.col("v") * F.col("v")).alias("v")), variance)


def smoothed_covariance(noise: DataFrame, weights: DataFrame) -> DataFrame:
    """Covariance W N W^T of a smoothed map, N a covariance (i, j, v) or the variances (i, x) of independent pixels."""
    if "x" in noise.columns:
        left = weights.join(noise.select(F.col("i").alias("j"), "x"), "j").select("i", "j", (F.col("v") * F.col("x")).alias("v"))
    else:
        left = multiply(weights, noise)
    return multiply(left, transposed(weights))


def apply(a: DataFrame, x: DataFrame) -> DataFrame:
    """Matrix times vector (i, x)."""
    return a.join(x.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("x"))


def solve(a: DataFrame, b: DataFrame, tol: float = 1e-10, steps: int = 1000) -> DataFrame:
    """x of A x = b for a symmetric positive definite A (i, j, v) and b (i, x), by conjugate gradients.

    A and the vectors stay distributed: a step is one product and two sums, of which the driver sees two numbers. A row
    that A lacks has x 0. Vectors are checkpointed, so spark.checkpoint.dir must be set.
    """
    dot = lambda d, u, v: d.agg(F.sum(F.col(u) * F.col(v))).head()[0] or 0.0
    state = b.select("i", F.lit(0.0).alias("x"), F.col("x").cast("double").alias("r"), F.col("x").cast("double").alias("p")).checkpoint()
    size = first = dot(state, "r", "r")
    for _ in range(steps):
        if size <= tol * tol * first:
            return state.select("i", "x")
        q = apply(a, state.select("i", F.col("p").alias("x"))).withColumnRenamed("x", "q")
        state = state.join(q, "i", "left").withColumn("q", F.coalesce("q", F.lit(0.0))).checkpoint()
        bend = dot(state, "p", "q")
        if bend <= 0:
            raise ValueError("the matrix is not positive definite")
        step = size / bend
        state = state.select("i", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("q")).alias("r"), "p")
        before, size = size, dot(state, "r", "r")
        state = state.withColumn("p", F.col("r") + (size / before) * F.col("p"))
    raise ValueError(f"{steps} steps leave a residual of {(size / first) ** 0.5:.1e}")


def total(parts: list[DataFrame]) -> DataFrame:
    """Sum over the union of entries."""
    return reduce(DataFrame.unionByName, parts).groupBy("i", "j").agg(F.sum("v").alias("v"))


def elementwise(a: DataFrame, b: DataFrame, operation: str) -> DataFrame:
    from .mapalgebra import pair

    joined = a.withColumnRenamed("v", "_a").join(b.withColumnRenamed("v", "_b"), ["i", "j"])
    return joined.select("i", "j", pair(operation, F.col("_a"), F.col("_b")).alias("v"))


def diagonal(a: DataFrame) -> DataFrame:
    return a.filter("i = j").select("i", "v")


def rms(a: DataFrame) -> DataFrame:
    return diagonal(a).select("i", F.sqrt("v").alias("rms"))


def from_rms(r: DataFrame) -> DataFrame:
    return r.select("i", F.col("i").alias("j"), (F.col("rms") * F.col("rms")).alias("v"))


def correlation(a: DataFrame) -> DataFrame:
    d = diagonal(a)
    joined = a.join(d.select("i", F.col("v").alias("_i")), "i").join(d.select(F.col("i").alias("j"), F.col("v").alias("_j")), "j")
    return joined.select("i", "j", (F.col("v") / F.sqrt(F.col("_i") * F.col("_j"))).alias("v"))


def masked(a: DataFrame, keep: DataFrame) -> DataFrame:
    k = keep.select("i").distinct()
    return a.join(k, "i", "left_semi").join(k.select(F.col("i").alias("j")), "j", "left_semi").select("i", "j", "v")


def block_diagonal(parts: list[DataFrame], sizes: list[int]) -> DataFrame:
    out, at = [], 0
    for p, n in zip(parts, sizes, strict=True):
        out.append(p.select((F.col("i") + at).alias("i"), (F.col("j") + at).alias("j"), "v"))
        at += n
    return reduce(DataFrame.unionByName, out)


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Root mean square deviation and correlation over common entries."""
    j = a.withColumnRenamed("v", "_a").join(b.withColumnRenamed("v", "_b"), ["i", "j"])
    return j.agg(F.sqrt(F.avg(F.pow(F.col("_a") - F.col("_b"), F.lit(2.0)))).alias("rmsd"), F.corr("_a", "_b").alias("corr"), F.count("*").alias("n"))


def up_add(fine: DataFrame, coarse: DataFrame, step: int) -> DataFrame:
    """Adds to each entry that of the coarse pixels it lies in."""
    c = coarse.select(F.col("i").alias("_ci"), F.col("j").alias("_cj"), F.col("v").alias("_c"))
    keyed = fine.withColumn("_ci", F.floor(F.col("i") / step)).withColumn("_cj", F.floor(F.col("j") / step))
    return keyed.join(c, ["_ci", "_cj"], "left").select("i", "j", (F.col("v") + F.coalesce("_c", F.lit(0.0))).alias("v"))


def channel_correlation(tod: DataFrame, time: list[str], channel: str, value: str) -> DataFrame:
    """Correlation (population) of all pairs i < j of channels, over the samples that hold both; a null value is not held.

    A sample's channels (of distinct, whole numbers) come together in one row; each task adds up products of whole
    blocks of samples, so what is shuffled after that is a matrix a task and not the squares of all samples. Values are
    taken from their channel's mean, the only thing, a number a channel, that the driver sees. The correlation is null
    where a channel is constant.
    """
    ship(tod.sparkSession)
    kind = tod.schema[channel].dataType
    tod = tod.select(*time, F.col(channel).cast("long").alias("i"), F.col(value).cast("double").alias("v")).filter("i IS NOT NULL AND v IS NOT NULL")
    means = {r["i"]: r["m"] for r in tod.groupBy("i").agg(F.avg("v").alias("m")).collect()}
    names = np.array(sorted(means), np.int64)
    mean = np.array([means[k] for k in names.tolist()])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(names), len(names)))
        for b in batches:
            for part in (b.column(0).slice(lo, SAMPLES) for lo in range(0, b.num_rows, SAMPLES)):
                flat, sizes = part.flatten(), part.value_lengths().to_numpy()
                at = np.searchsorted(names, flat.field("i").to_numpy())
                row = np.repeat(np.arange(len(part)), sizes)
                x, held = np.zeros((len(part), len(names))), np.zeros((len(part), len(names)))
                x[row, at], held[row, at] = flat.field("v").to_numpy() - mean[at], 1
                square = x * x
                for k, (left, right) in enumerate(((held, held), (x, held), (held, x), (square, held), (held, square), (x, x))):
                    total[k] += left.T @ right
        i, j = np.nonzero(np.triu(total[0], 1))
        yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(names[j]), *(pa.array(t[i, j]) for t in total)], ["i", "j", "n", "a", "b", "aa", "bb", "ab"])

    rows = tod.groupBy(*time).agg(F.collect_list(F.struct("i", "v")).alias("c")).select("c")
    sums = rows.mapInArrow(products, "i long, j long, n double, a double, b double, aa double, bb double, ab double")
    sums = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")])
    spread = lambda s, q: F.col(q) - F.col(s) * F.col(s) / F.col("n")
    v = F.try_divide(F.col("ab") - F.col("a") * F.col("b") / F.col("n"), F.sqrt(spread("a", "aa") * spread("b", "bb")))
    return sums.select(F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j"), v.alias("v"), F.col("n").cast("long").alias("n"))


def block_statistics(corr: DataFrame, size: int, n_samples: int) -> DataFrame:
    """chi2, product and mean statistics of blocks of size x size correlations, each of variance 1 / n_samples."""
    b = lambda c: F.floor(F.col(c) / size).alias(f"b{c}")
    n = F.count("*")
    chi2 = (F.sum(F.col("v") * F.col("v")) * n_samples - n) / F.sqrt(2 * n)
    return corr.groupBy(b("i"), b("j")).agg(n.alias("n"), chi2.alias("chi2"), (F.sum("v") * (n_samples**0.5) / F.sqrt(n)).alias("mean"))


def channel_extremes(corr: DataFrame) -> DataFrame:
    """Mean, largest size and mean size of each channel's non-zero correlations."""
    both = corr.select("i", "v").union(corr.select(F.col("j").alias("i"), "v")).filter("v <> 0")
    return both.groupBy("i").agg(F.avg("v").alias("mean"), F.max(F.abs("v")).alias("largest"), F.avg(F.abs("v")).alias("mean_size"))
