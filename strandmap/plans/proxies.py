"""The supplied tables read as streams, maps and matrices, and the same in SQL.

Values are whole numbers held as doubles, so that sums don't depend on the order in which a cluster adds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import table

EV = "ev AS (SELECT event_id, epoch_us(ts) / 1000000 AS t, user_id, user_id % 19 AS feed, event_type, round(value * 100) AS c FROM events)"
LI = "li AS (SELECT l_orderkey, l_linenumber AS feed, l_suppkey % 20 AS x, l_partkey % 25 AS y, round(l_extendedprice * 100) AS d, l_quantity AS w FROM lineitem)"
CH = "ch AS (SELECT vec_id, label AS feed, unnest(embedding) AS e, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS freq FROM embeddings), chn AS (SELECT vec_id, feed, freq, round(e * 1000) AS v FROM ch)"
MP = "m1 AS (SELECT x, y, sum(d) AS v FROM li GROUP BY x, y), m2 AS (SELECT x, y, sum(w) AS v FROM li WHERE feed = 1 GROUP BY x, y)"


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return e.select("event_id", t.alias("t"), "user_id", (F.col("user_id") % 19).alias("feed"), "event_type", F.round(F.col("value") * 100).alias("c"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", F.col("l_linenumber").alias("feed"), (F.col("l_suppkey") % 20).alias("x"), (F.col("l_partkey") % 25).alias("y"), F.round(F.col("l_extendedprice") * 100).alias("d"), F.col("l_quantity").alias("w"))


def channels(spark: SparkSession, sf: str) -> DataFrame:
    """Values are multiplied as the floats they are, as in the SQL: as doubles some would fall on the other side of a half."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("feed"), F.posexplode("embedding").alias("freq", "e"))
    return e.select("vec_id", "feed", "freq", F.round((F.col("e") * F.lit(1000.0).cast("float")).cast("double")).alias("v"))


def map_values(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    li = samples(spark, sf)
    return li.groupBy("x", "y").agg(F.sum("d").alias("v")), li.filter("feed = 1").groupBy("x", "y").agg(F.sum("w").alias("v"))
