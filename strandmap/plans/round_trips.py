"""Queries that write a product and read it back, and on gains, mounts, noise and pickup."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import angles
from ..operators import fits, matrices
from ..registry import query, table
from ..runtime import scratch
from ..sources import catalogs, images, products
from .checks import SKY, rounded, sky
from .maps import MAT, two_matrices
from .proxies import CH, EV, LI, channels, events, samples


@query("stream_product", f"WITH {EV} SELECT event_id, feed, t, c FROM ev")
def _(spark, sf):
    path = scratch(spark, "streams")
    products.write_streams(events(spark, sf).select("event_id", F.col("feed").cast("long").alias("feed"), "t", "c"), path, ["feed"])
    return products.read_streams(spark, path, ["event_id", F.col("feed").cast("long").alias("feed"), "t", "c"])


@query("stream_pointing_only", f"WITH {EV} SELECT event_id, t FROM ev WHERE feed = 3")
def _(spark, sf):
    """One scan's folder and two of the columns; the others stay off the scan."""
    path = scratch(spark, "streams")
    products.write_streams(events(spark, sf).select("event_id", "feed", "t", "c"), path, ["feed"])
    return products.read_streams(spark, path).filter("feed = 3").select("event_id", "t")


@query("streams_concatenated", f"WITH {EV} SELECT event_id, c, CASE WHEN event_type = 'view' THEN t END AS t FROM ev WHERE event_type IN ('view', 'click')")
def _(spark, sf):
    e = events(spark, sf)
    return products.concatenated([e.filter("event_type = 'click'").select("event_id", "c"), e.filter("event_type = 'view'").select("event_id", "t", "c")]).select("event_id", "c", "t")


@query("map_product", f"WITH {LI} SELECT feed, x, y, sum(d * w) / sum(w) AS v, count(*) AS nhit FROM li GROUP BY feed, x, y UNION ALL SELECT -1, x, y, sum(d * w) / sum(w), count(*) FROM li GROUP BY x, y")
def _(spark, sf):
    li, path = samples(spark, sf), scratch(spark, "map")
    value = (F.sum(F.col("d") * F.col("w")) / F.sum("w")).alias("v")
    products.write_map({"feed": li.groupBy("feed", "x", "y").agg(value, F.count("*").alias("nhit")), "all": li.groupBy("x", "y").agg(value, F.count("*").alias("nhit"))}, path)
    both = [products.read_map(spark, path, "feed"), products.read_map(spark, path, "all").withColumn("feed", F.lit(-1))]
    return both[0].select("feed", "x", "y", "v", "nhit").union(both[1].select("feed", "x", "y", "v", "nhit"))


@query("submap_product", f"WITH {LI} SELECT x, y, sum(d) AS v FROM li WHERE x >= 5 AND x < 12 AND y >= 3 AND y < 9 GROUP BY x, y")
def _(spark, sf):
    path = scratch(spark, "submap")
    products.write_map({"sky": samples(spark, sf).groupBy("x", "y").agg(F.sum("d").alias("v"))}, path)
    return products.read_map(spark, path, "sky").filter("x >= 5 AND x < 12 AND y >= 3 AND y < 9").select("x", "y", "v")


@query("full_map_product", f"WITH {LI}, p AS (SELECT x AS pix, sum(d) AS v FROM li WHERE x % 4 < 2 GROUP BY x) SELECT pix, v FROM p")
def _(spark, sf):
    """A sparse map as all pixels with the sentinel, on disk, and back without it."""
    p, path = samples(spark, sf).filter("x % 4 < 2").groupBy(F.col("x").alias("pix")).agg(F.sum("d").alias("v")), scratch(spark, "full")
    products.write_map({"full": products.dense(p, "pix", "v", 40)}, path)
    return products.sparse(products.read_map(spark, path, "full"), "pix", "v")


@query("equation_set_product", f"WITH {MAT} SELECT 'covariance' AS part, i, j, v FROM a UNION ALL SELECT 'right side', i, 0, sum(v) FROM a GROUP BY i")
def _(spark, sf):
    a, path = two_matrices(spark, sf)[0], scratch(spark, "equations")
    products.write_map({"covariance": a, "right_side": a.groupBy("i").agg(F.sum("v").alias("x"))}, path)
    left = products.read_map(spark, path, "covariance").select(F.lit("covariance").alias("part"), "i", "j", "v")
    right = products.read_map(spark, path, "right_side").select(F.lit("right side").alias("part"), "i", F.lit(0).cast(a.schema["j"].dataType).alias("j"), F.col("x").alias("v"))
    return left.union(right)


@query("map_text", f"WITH {LI} SELECT x, y, CAST(sum(d) AS BIGINT) AS v FROM li GROUP BY x, y HAVING count(*) > 20")
def _(spark, sf):
    path = scratch(spark, "text")
    m = samples(spark, sf).groupBy("x", "y").agg(F.sum("d").cast("long").alias("v"), F.when(F.count("*") > 20, 1.0).otherwise(0.0).alias("mask"))
    products.write_table(m, path, "mask")
    return spark.read.schema("x long, y long, v long, mask double").option("sep", " ").option("header", True).csv(path).select("x", "y", "v")


@query("run_list_product", "SELECT c_mktsegment AS object, CAST(c_custkey AS VARCHAR) AS scan, CAST(c_nationkey + 1 AS VARCHAR) AS sub FROM customer")
def _(spark, sf):
    """A scan of one sub-scan for each customer, written as text by object and read back."""
    path, k = scratch(spark, "runs"), F.col("c_custkey")
    runs = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("object"), k.alias("scan_id"), (50000.0 + k).alias("scan_start"), (50000.5 + k).alias("scan_end"), F.lit("/a.h5").alias("file"),
        (F.col("c_nationkey") + 1).alias("sub_id"), (50000.0 + k).alias("start"), (50000.25 + k).alias("end"), F.lit(32).alias("feature"), F.lit(10.0).alias("az"), F.lit(50.0).alias("el"), F.lit(0.0).alias("dk"),
    )
    catalogs.write_run_list(runs, path)
    names = table(spark, sf, "customer").select("c_mktsegment").distinct().collect()  # objects: a handful of files
    parts = [catalogs.run_list(spark, f"{path}/object={r[0]}") for r in names]
    return products.concatenated(parts).select("object", F.col("scan_id").cast("string").alias("scan"), F.col("sub_id").cast("string").alias("sub"))


@query("image_slice", f"WITH {LI}, p AS (SELECT x, y, sum(d) AS v FROM li GROUP BY x, y), g AS (SELECT unnest(range(3, 18, 2)) AS i1), h AS (SELECT unnest(range(5, 26)) AS i2) SELECT i1, i2, v AS value FROM g, h LEFT JOIN p ON p.x = i1 - 1 AND p.y = i2 - 1")
def _(spark, sf):
    """A map as a FITS image, of which every second column from the third to the 17th and the rows from the fifth on are read."""
    path = scratch(spark, "image")
    m = samples(spark, sf).groupBy("x", "y").agg(F.sum("d").alias("v"))
    spark.range(1).write.parquet(path)  # makes the folder
    images.write_image(images.grid(m, "x", "y", "v", 20, 25), f"{path}/map.fits")
    return images.read_image(spark, f"{path}/map.fits", "3:17:2,5:").select("i1", "i2", F.nanvl("value", F.lit(None)).alias("value"))


CUBE = f"WITH {CH}, q AS (SELECT feed % 4 + 1 AS sb, freq + 1 AS f, sum(v) AS v FROM chn GROUP BY ALL)"


@query("simulated_cube", f"{CUBE} SELECT CAST(sb AS BIGINT) AS sb, CAST(CASE WHEN sb IN (1, 3) THEN 65 - f ELSE f END AS BIGINT) AS f, v / 1e6 AS v FROM q")
def _(spark, sf):
    q = channels(spark, sf).groupBy((F.col("feed") % 4 + 1).cast("long").alias("sb"), (F.col("freq") + 1).cast("long").alias("f")).agg(F.sum("v").alias("v"))
    return products.simulated_cube(q, "sb", "f", "v", 64)


GAIN = "e AS (SELECT event_id, feed, t / 86400 AS day, c, event_type FROM ev), z AS (SELECT min(day) AS lo, max(day) AS hi FROM e WHERE event_type = 'view')"


@query(
    "gain_amplitudes",
    f"WITH {EV}, {GAIN}, n AS (SELECT *, ceil((hi - lo) / 5.0) + 1 AS n FROM z), b AS (SELECT e.*, greatest(0, least(floor((day - lo) / (hi - lo) * n), n - 1)) AS b FROM e, n), "
    "m AS (SELECT feed, b, avg(c) AS m FROM b WHERE event_type = 'view' GROUP BY feed, b), g AS (SELECT b.feed, b.c, m.m, 1 + b.event_id % 3 AS s FROM b JOIN m USING (feed, b) WHERE event_type = 'click') "
    "SELECT feed, round(sum(c * m / (s * s)) / sum(m * m / (s * s)), 8) AS amplitude, count(*) AS n FROM g GROUP BY feed",
)
def _(spark, sf):
    e = events(spark, sf).withColumn("day", F.col("t") / 86400).withColumn("s", 1.0 + F.col("event_id") % 3)
    return rounded(fits.gain_amplitudes(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), ["feed"], "day", "c", "s", 5.0), 8, "amplitude").drop("chi2")


@query("mount_residuals", f"WITH {SKY}, p AS (SELECT k, lon, lat, lon - 0.01 AS a, lat + 0.02 - 0.003 * cos(lat + 0.02) AS e FROM s) SELECT k, round(cos(a), 7) AS x, round(sin(a), 7) AS y, round(degrees(e - lat) * 60, 5) AS off FROM p")
def _(spark, sf):
    s = sky(spark, sf)
    az, el = angles.mounted(F.col("lon"), F.col("lat"), F.lit(0.3), daz=0.01, **{"del": 0.02}, flex=0.003)
    return s.select("k", F.round(F.cos(az), 7).alias("x"), F.round(F.sin(az), 7).alias("y"), F.round(F.degrees(el - F.col("lat")) * 60, 5).alias("off"))


@query("smoothed_noise", f"WITH {MAT}, n AS (SELECT i, sum(v) AS x FROM a GROUP BY i) SELECT p.i, q.i AS j, CAST(sum(p.v * q.v * n.x) AS DOUBLE) AS v FROM b p JOIN b q ON p.j = q.j JOIN n ON n.i = p.j GROUP BY p.i, q.i")
def _(spark, sf):
    a, b = two_matrices(spark, sf)
    return matrices.smoothed_covariance(a.groupBy("i").agg(F.sum("v").alias("x")), b)


@query("smoothed_noise_full", f"WITH {MAT} SELECT p.i, q.i AS j, CAST(sum(p.v * a.v * q.v) AS DOUBLE) AS v FROM b p JOIN a ON p.j = a.i JOIN b q ON q.j = a.j GROUP BY p.i, q.i")
def _(spark, sf):
    a, b = two_matrices(spark, sf)
    return matrices.smoothed_covariance(a, b)


@query("smoothed_variance", f"WITH {MAT}, n AS (SELECT i, sum(v) AS x FROM a GROUP BY i) SELECT b.i, CAST(sum(b.v * b.v * n.x) AS DOUBLE) AS x FROM b JOIN n ON n.i = b.j GROUP BY b.i")
def _(spark, sf):
    a, b = two_matrices(spark, sf)
    return matrices.smoothed_variance(a.groupBy("i").agg(F.sum("v").alias("x")), b)


HORIZON = [0.1 * math.sin(0.7 * k) for k in range(36)]


@query("beam_pickup", f"WITH {SKY}, h AS (SELECT {HORIZON} AS h), u AS (SELECT k, lon, unnest([lat + 0.1, lat, lat - 0.1]) AS up, unnest([1.0, 2.0, 1.0]) AS g FROM s) SELECT k, sum(CASE WHEN up < h[CAST(floor(lon / (2 * pi() / 36) + 0.5) AS BIGINT) % 36 + 1] THEN g ELSE 0 END) / 4 AS share FROM u, h GROUP BY k")
def _(spark, sf):
    s = sky(spark, sf)
    return s.select("k", angles.pickup(F.col("lon"), F.col("lat"), F.lit(0.0), [(0.0, 0.1, 1.0), (0.0, 0.0, 2.0), (0.0, -0.1, 1.0)], HORIZON).alias("share"))
