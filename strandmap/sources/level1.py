"""Raw streams: what is done to them as they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tidied(raw: DataFrame, channel: list[str], scan: list[str], index: str, value: str, most_nan: float = 0.1, most_trim: int = 500) -> DataFrame:
    """Rows of a scan without its trailing samples of NaNs in all channels (``most_trim`` at most); channels of which more than
    a share ``most_nan`` is NaN are set to 0."""
    ends = raw.groupBy(*scan).agg(F.max(index).alias("_end"), F.max(F.when(~F.isnan(value), F.col(index))).alias("_last"))
    kept = raw.join(ends, scan).filter(F.col(index) <= F.greatest(F.coalesce("_last", F.lit(-1)), F.col("_end") - most_trim)).drop("_end", "_last")
    share = F.avg(F.isnan(value).cast("double")).over(Window.partitionBy(*channel))
    return kept.withColumn("_s", share).withColumn(value, F.when(F.col("_s") > most_nan, F.lit(0.0)).otherwise(F.col(value))).drop("_s")


def sample_rate(times: DataFrame, scan: list[str], time: str) -> DataFrame:
    """Samples a unit of time by scan."""
    return times.groupBy(*scan).agg(((F.count("*") - 1) / (F.max(time) - F.min(time))).alias("rate"))


def housekeeping_slice(hk: DataFrame, scans: DataFrame, time: str, start: str, end: str, width: float) -> DataFrame:
    """Housekeeping rows within each scan's range."""
    from ..operators.joins import within

    return within(hk, scans, time, start, end, width, "both")


def housekeeping_summary(hk: DataFrame, scans: DataFrame, time: str, start: str, end: str, width: float, parts: dict[str, tuple[str, str | None]]) -> DataFrame:
    """A summary of the housekeeping rows within each distinct range of scans (see ``joins.summed_within``)."""
    from ..operators.joins import summed_within

    return summed_within(hk, scans, time, start, end, width, parts, "both")


def calibrated(tod: DataFrame, tsys: DataFrame, channel: list[str], value: str, most: float) -> DataFrame:
    """Values times their channel's system temperature, with the reason (60 too high, 70 NaN) of those that lose it; these are null."""
    t = F.col("tsys")
    got = tod.join(tsys.select(*channel, "tsys"), channel, "left")
    reason = F.when(t.isNull() | F.isnan(t), 70).when(t > most, 60).otherwise(0)
    return got.withColumn("reason", reason).withColumn(value, F.when(F.col("reason") == 0, F.col(value) * t)).drop("tsys")


def converted(readings: DataFrame, boards: DataFrame, board: str, value: str) -> DataFrame:
    """Housekeeping readings in physical units: a board's ``scale`` * reading + ``offset``, null where the reading is
    beyond its ``low`` or ``high``; boards that the table lacks stay as they are."""
    b = boards.select(board, "scale", "offset", "low", "high")
    got = readings.join(b, board, "left")
    inside = F.coalesce(F.col(value) >= F.col("low"), F.lit(True)) & F.coalesce(F.col(value) <= F.col("high"), F.lit(True))
    v = F.when(F.col("scale").isNull(), F.col(value)).when(inside, F.col("scale") * F.col(value) + F.col("offset"))
    return got.select(*[v.alias(c) if c == value else F.col(c) for c in readings.columns])


def system_temperature(load: DataFrame, keys: list[str], hot: str, cold: str, t_hot: str, t_cold: float) -> DataFrame:
    """(t_hot - t_cold) / (p_hot / p_cold - 1) by channel from mean powers on an ambient load and on the sky."""
    y = F.avg(hot) / F.avg(cold)
    return load.groupBy(*keys).agg(((F.avg(t_hot) - t_cold) / (y - 1)).alias("tsys"))
