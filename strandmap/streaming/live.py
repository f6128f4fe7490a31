"""The batch operators over unbounded streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..runtime import ship


def decimated(stream: DataFrame, keys: list[str], ts: str, value: str, width: str, late: str) -> DataFrame:
    """Mean and count of tumbling windows; rows later than ``late`` behind the newest are left out."""
    got = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, width)).agg(F.avg(value).alias(value), F.count("*").alias("n"))
    return got.select(*keys, F.col("window.start").alias("start"), value, "n")


def sessions(stream: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """Scans: runs of rows without a gap, sent once the watermark has passed their end."""
    got = stream.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap)).agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    return got.drop("session_window")


def live_map(stream: DataFrame, pixel: list[str], value: str, weight: str) -> DataFrame:
    """Running sums of a map, for output mode update or complete; sums of sums make any level."""
    w = F.col(weight)
    return stream.groupBy(*pixel).agg(F.count("*").alias("nhit"), F.sum(F.col(value) * w).alias("wsum"), F.sum(w).alias("div"))


def spikes(stream: DataFrame, key: str, ts: str, value: str, keep: float = 0.7, limit: float = 5.0, rest: int = 10) -> DataFrame:
    """Triggers of the decaying sum of steps, whose state (sum, last value, samples to pass over) goes on from batch to batch.

    Rows of a key are folded in order of time within a batch; state is three numbers a key and goes after an hour
    without rows.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s, last, wait = state.get if state.exists else (0.0, None, 0)
        hits = []
        for t, x in sorted((t, x) for p in parts for t, x in zip(p[ts], p[value], strict=True)):
            s = 0.0 if last is None or wait > 0 else keep * s + x - last
            wait, last = max(0, wait - 1), float(x)
            if abs(s) > limit:
                hits.append((k[0], t, float(x)))
                s, wait = 0.0, rest
        state.update((s, last, wait))
        state.setTimeoutDuration(3_600_000)
        if hits:
            yield pd.DataFrame(hits, columns=[key, ts, value])

    ship(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, ts, value).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, `{ts}` timestamp, `{value}` double", "s double, last double, wait int", "update", GroupStateTimeout.ProcessingTimeTimeout)
