"""Operators over ordered samples of a channel. ``keys`` name the channel, ``order`` its time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.angles import unwrap_step
from ..runtime import ship


def channel(keys: list[str], order: list[str] | str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def upto_here(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def differences(df: DataFrame, keys: list[str], order, value: str, out: str = "diff") -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value).over(channel(keys, order)))


def white_noise(df: DataFrame, keys: list[str], order, value: str) -> DataFrame:
    """sigma0 by channel: sqrt(sample variance of first differences / 2)."""
    return differences(df, keys, order, value, "_d").groupBy(*keys).agg(F.sqrt(F.var_samp("_d") / 2).alias("sigma0"))


def fill_isolated(df: DataFrame, keys: list[str], order, value: str) -> DataFrame:
    """A NaN between two numbers becomes their mean; longer gaps and ends stay NaN."""
    w = channel(keys, order)
    a, b = F.lag(value).over(w), F.lead(value).over(w)
    return df.withColumn(value, F.when(F.isnan(value) & ~F.isnan(a) & ~F.isnan(b), (a + b) / 2).otherwise(F.col(value)))


def running(df: DataFrame, keys: list[str], order, value: str, half: int, kind: str = "median", out: str = "smooth") -> DataFrame:
    """Running median or mean over 2 * half + 1 samples, over fewer, but as many on either side, towards the ends."""
    w = channel(keys, order)
    i, n = F.row_number().over(w), F.count("*").over(Window.partitionBy(*keys))
    near = F.collect_list(value).over(w.rowsBetween(-half, half))
    df = df.withColumn("_i", i).withColumn("_n", n).withColumn("_near", near)
    k = F.least(F.lit(half), F.col("_i") - 1, F.col("_n") - F.col("_i")).cast("int")
    at = (F.col("_i") - F.greatest(F.lit(1), F.col("_i") - half) + 1).cast("int")
    part = F.slice("_near", at - k, 2 * k + 1)
    got = F.element_at(F.sort_array(part), k + 1) if kind == "median" else F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / (2 * k + 1)
    return df.withColumn(out, got).drop("_i", "_n", "_near")


def islands(df: DataFrame, keys: list[str], order, flag: Column, out: str = "run") -> DataFrame:
    """Numbers runs of equal ``flag`` within a channel, from 1."""
    w = channel(keys, order)
    df = df.withColumn("_f", flag)
    new = F.when(F.row_number().over(w) == 1, 1).when(F.col("_f").eqNullSafe(F.lag("_f").over(w)), 0).otherwise(1)
    return df.withColumn("_n", new).withColumn(out, F.sum("_n").over(upto_here(w))).drop("_n", "_f")


def runs(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """A row a run: channel, run, flag, start, end and n."""
    got = islands(df.withColumn("flag", flag), keys, order, F.col("flag"))
    return got.groupBy(*keys, "run", "flag").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"))


def longest_run(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """Samples in the longest run of a true flag, 0 if there is none."""
    return runs(df, keys, order, flag).groupBy(*keys).agg(F.max(F.when(F.col("flag"), F.col("n")).otherwise(0)).alias("longest"))


def absorb_short(df: DataFrame, keys: list[str], order: str, mode: str, least: int) -> DataFrame:
    """Runs of fewer than ``least`` samples take the mode of the last longer run before them, if there is one."""
    got = islands(df, keys, order, F.col(mode))
    long = F.count("*").over(Window.partitionBy(*keys, "run")) >= least
    kept = F.last(F.when(long, F.col(mode)), ignorenulls=True).over(upto_here(channel(keys, order)))
    return got.withColumn(mode, F.coalesce(kept, F.col(mode))).drop("run")


def sessions(df: DataFrame, keys: list[str], order: str, gap: float, breaks: Column | None = None, out: str = "session") -> DataFrame:
    """Numbers sessions from 1: a new one where the step exceeds ``gap`` or ``breaks`` holds."""
    w = channel(keys, order)
    step = F.col(order) - F.lag(order).over(w)
    new = F.when(step.isNull() | (step > gap) | (breaks if breaks is not None else F.lit(False)), 1).otherwise(0)
    return df.withColumn("_n", new).withColumn(out, F.sum("_n").over(upto_here(w))).drop("_n")


def session_ranges(df: DataFrame, keys: list[str], order: str, gap: float, least: float = 0, values: list[str] | None = None) -> DataFrame:
    """A row a session of at least ``least`` duration: start, end, n, and mean and population deviation of ``values``."""
    aggs = [a for v in values or [] for a in (F.avg(v).alias(f"mean_{v}"), F.stddev_pop(v).alias(f"std_{v}"))]
    got = sessions(df, keys, order, gap).groupBy(*keys, "session").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"), *aggs)
    return got.filter(F.col("end") - F.col("start") >= least)


def corrected_steps(df: DataFrame, keys: list[str], order, time: str, step: float) -> DataFrame:
    """Times in which a step of no length moves its sample and all later ones by ``step``."""
    w = channel(keys, order)
    stuck = F.when(F.col(time) <= F.lag(time).over(w), F.lit(step)).otherwise(0.0)
    return df.withColumn("_s", stuck).withColumn(time, F.col(time) + F.sum("_s").over(upto_here(w))).drop("_s")


def unwrapped(df: DataFrame, keys: list[str], order, angle: str, period: float) -> DataFrame:
    """The angle without jumps: steps beyond a quarter of the period are taken for turns."""
    w = channel(keys, order)
    step = F.coalesce(unwrap_step(F.col(angle), F.lag(angle).over(w), period), F.lit(0.0))
    return df.withColumn("_s", step).withColumn(angle, F.col(angle) + F.sum("_s").over(upto_here(w))).drop("_s")


def last_change(df: DataFrame, keys: list[str], order: str, value: str, least: float) -> DataFrame:
    """Adds the last time at which the value moved by more than ``least``."""
    moved = F.abs(F.col(value) - F.lag(value).over(channel(keys, order))) > least
    df = df.withColumn("_m", F.when(moved, F.col(order)))
    return df.withColumn("changed", F.last("_m", ignorenulls=True).over(upto_here(channel(keys, order)))).drop("_m")


def travel(df: DataFrame, keys: list[str], order, value: str) -> DataFrame:
    """Running extrema and travel in either direction up to each sample."""
    df = differences(df, keys, order, value, "_d")
    w = upto_here(channel(keys, order))
    up, down = F.sum(F.greatest(F.coalesce("_d", F.lit(0.0)), F.lit(0.0))), F.sum(F.greatest(-F.coalesce("_d", F.lit(0.0)), F.lit(0.0)))
    return df.withColumns({"lo": F.min(value).over(w), "hi": F.max(value).over(w), "up": up.over(w), "down": down.over(w)}).drop("_d")


def turnarounds(df: DataFrame, keys: list[str], order, az: str, reach: int = 12) -> DataFrame:
    """Flags samples within ``reach`` of a change of direction."""
    w = channel(keys, order)
    before = F.lag(az, 1).over(w) - F.lag(az, 2).over(w)
    after = F.lead(az, 1).over(w) - F.col(az)
    df = df.withColumn("_t", F.when(before * after < 0, 1).otherwise(0))
    return df.withColumn("turn", F.max("_t").over(w.rowsBetween(-reach, reach))).drop("_t")


def decimated(df: DataFrame, keys: list[str], index: str, n: int, value: str, weight: str | None = None, parity: bool = False) -> DataFrame:
    """Weighted mean of blocks of n samples. ``parity`` divides by the weights of one sample only, so that it is n times that."""
    w = F.col(weight) if weight else F.lit(1.0)
    mean = F.sum(F.col(value) * w) / F.sum(w)
    return df.groupBy(*keys, F.floor(F.col(index) / n).alias(index)).agg((mean * n if parity else mean).alias(value), F.count("*").alias("n"))


def azimuth_bins(df: DataFrame, keys: list[str], az: str, value: str, bins: int) -> DataFrame:
    """Mean of value in equal bins over the channel's range of azimuth, with the counts; empty bins are NaN."""
    all_of = Window.partitionBy(*keys)
    lo, hi = F.min(az).over(all_of), F.max(az).over(all_of)
    b = F.least(F.floor(bins * (F.col(az) - lo) / (hi - lo)), F.lit(bins - 1))
    got = df.withColumn("bin", b).groupBy(*keys, "bin").agg(F.avg(value).alias(value), F.count("*").alias("n"))
    grid = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return grid.join(got, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce(value, F.lit(float("nan"))).alias(value), F.coalesce("n", F.lit(0)).alias("n"))


def balanced_groups(df: DataFrame, keys: list[str], stat: str, weight: str, n: int, out: str = "group") -> DataFrame:
    """n groups of about equal weight by ascending statistic, from 1; leading rows without weight get 0."""
    w = channel(keys, stat)
    cum = F.sum(weight).over(upto_here(w)) / F.sum(weight).over(Window.partitionBy(*keys))
    df = df.withColumn("_c", cum)
    first = F.min(F.when(F.col(weight) > 0, F.col("_c"))).over(Window.partitionBy(*keys))
    g = F.floor((F.col("_c") - first) * n).cast("int") + 1
    return df.withColumn(out, F.when(F.col("_c") < first, 0).otherwise(F.least(g, F.lit(n)))).drop("_c")


def baselines(df: DataFrame, keys: list[str], order, length: int) -> DataFrame:
    """Numbers half-open segments of ``length`` samples from 0."""
    return df.withColumn("baseline", F.floor((F.row_number().over(channel(keys, order)) - 1) / length))


def shifted(df: DataFrame, keys: list[str], order, value: str, steps: float, out: str = "shifted") -> DataFrame:
    """The value ``steps`` samples earlier (later if negative), interpolated; null beyond the ends."""
    whole = int(steps // 1)
    part, w = steps - whole, channel(keys, order)
    got = F.lag(value, whole).over(w)
    return df.withColumn(out, got if part == 0 else (1 - part) * got + part * F.lag(value, whole + 1).over(w))


def block_rms(df: DataFrame, keys: list[str], index: str, n: int, value: str) -> DataFrame:
    """Sample deviation of blocks of n samples, and its ratio to the block before."""
    got = df.groupBy(*keys, F.floor(F.col(index) / n).alias("block")).agg(F.stddev_samp(value).alias("rms"))
    before = F.lag("rms").over(channel(keys, "block"))
    return got.withColumn("ratio", F.when(before > 0, F.col("rms") / before))


def weather(df: DataFrame, keys: list[str], time: str, value: str, inner: float, outer: float) -> DataFrame:
    """Deviation over blocks of ``outer`` of the deviations of blocks of ``inner``, averaged over a channel."""
    a = df.groupBy(*keys, F.floor(F.col(time) / inner).alias("_i")).agg(F.avg(value).alias("_v"))
    b = a.groupBy(*keys, F.floor(F.col("_i") * inner / outer).alias("_o")).agg(F.stddev_samp("_v").alias("_s"))
    return b.groupBy(*keys).agg(F.stddev_samp("_s").alias("stat"))


def jumps(df: DataFrame, keys: list[str], order, value: str, reach: int, smooth: int) -> DataFrame:
    """Largest |x(i + reach) - x(i - reach)| of the boxcar-smoothed stream by channel."""
    w = channel(keys, order)
    df = df.withColumn("_s", F.avg(value).over(w.rowsBetween(-smooth, smooth)))
    return df.withColumn("_j", F.abs(F.lead("_s", reach).over(w) - F.lag("_s", reach).over(w))).groupBy(*keys).agg(F.max("_j").alias("jump"))


def spikes(df: DataFrame, keys: list[str], order: str, value: str, keep: float = 0.7, limit: float = 5.0, rest: int = 10, near: int = 10, far: int = 20) -> DataFrame:
    """Samples at which the decaying sum s = keep * s + step exceeds ``limit`` in size, with their kind.

    A trigger sets s to 0 and the next ``rest`` samples are passed over. The kind compares the means from ``near`` to
    ``far`` samples on either side: edge if a side is missing, jump if they differ by more than the limit, spike if
    the sample stands out from both, else anomaly. Samples stream through in order (those of equal order by value), as
    the windows leave them clustered and sorted by channel; a task holds a batch and three numbers, never a channel.
    """
    ship(df.sparkSession)
    w = channel(keys, order)
    left, right = F.avg(value).over(w.rowsBetween(-far, -near)), F.avg(value).over(w.rowsBetween(near, far))
    d = df.select(*keys, order, F.col(value).cast("double").alias(value)).withColumns({"_l": left, "_r": right}).sortWithinPartitions(*keys, order, value)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, s, last, wait = None, 0.0, None, 0
        for b in batches:
            found = []
            of = zip(*(b.column(k).to_pylist() for k in keys), strict=True) if keys else [()] * b.num_rows
            for i, (key, x) in enumerate(zip(of, b.column(value).to_pylist(), strict=True)):
                if key != at:
                    at, s, last, wait = key, 0.0, None, 0
                if last is None or wait > 0:
                    s = 0.0
                else:
                    s = None if x is None or s is None else keep * s + x - last
                last, wait = x, max(wait - 1, 0)
                if s is not None and (abs(s) > limit or s != s):  # NaN is above any limit, as in SQL
                    found.append(i)
                    s, wait = 0.0, rest
            yield b.take(pa.array(found, pa.int64()))

    got = d.mapInArrow(fold, d.schema)
    kind = (
        F.when(F.col("_l").isNull() | F.col("_r").isNull(), "edge")
        .when(F.abs(F.col("_r") - F.col("_l")) > limit, "jump")
        .when((F.abs(F.col(value) - F.col("_l")) > limit) & (F.abs(F.col(value) - F.col("_r")) > limit), "spike")
        .otherwise("anomaly")
    )
    return got.select(*keys, order, value, kind.alias("kind"))


def best_lag(a: DataFrame, b: DataFrame, keys: list[str], index: str, value: str, lags: int) -> DataFrame:
    """The lag of b against a, up to ``lags`` samples either way, at which the mean product of their steps is largest."""
    a, b = differences(a, keys, index, value, "_a").select(*keys, index, "_a"), differences(b, keys, index, value, "_b").select(*keys, index, "_b")
    near = b.withColumn("lag", F.explode(F.sequence(F.lit(-lags), F.lit(lags)))).withColumn(index, F.col(index) - F.col("lag"))
    got = a.join(near, [*keys, index]).groupBy(*keys, "lag").agg(F.avg(F.col("_a") * F.col("_b")).alias("match"))
    return got.groupBy(*keys).agg(F.min_by("lag", F.struct(-F.col("match"), F.abs("lag"), F.col("lag"))).alias("lag"))
