"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for each end of ``edges`` (a, b): c is the smallest id that v reaches.

    Each round takes the least label among the neighbours and then that label's own label (pointer jumping),
    so the rounds grow with the logarithm of the longest path. Nothing but a count comes to the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "edges")
    state = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("c")), "labels")
    while True:
        least = both.join(state.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        step = state.join(least, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = state.select(F.col("v").alias("c"), F.col("c").alias("further"))
        new = stored(step.join(jump, "c", "left").select("v", F.coalesce(F.least("c", "further"), F.col("c")).alias("c"), "old"), "labels")
        changed = new.filter("c <> old").limit(1).count()
        drop(state)
        state = new
        if not changed:
            drop(both)
            return state.select("v", "c")
