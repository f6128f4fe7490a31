"""Queries on validation statistics, pointing, solvers and map pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import angles
from ..operators import fits, joins, mapalgebra, matrices, validation
from ..registry import query, table
from ..sources import level1, products
from .proxies import CH, EV, LI, MP, channels, events, map_values, samples

#: A spectrum by channel: power and model over whole frequencies.
SP = f"WITH {CH}, sp AS (SELECT feed, freq * 1.0 AS freq, sum(v * v) AS power, sum(v * v) / count(*) * 10 + freq AS model FROM chn GROUP BY feed, freq)"


def spectra(spark, sf):
    v = F.col("v") * F.col("v")
    got = channels(spark, sf).groupBy("feed", "freq").agg(F.sum(v).alias("power"), (F.sum(v) / F.count("*") * 10 + F.col("freq")).alias("model"))
    return got.withColumn("freq", F.col("freq").cast("double"))


def rounded(df, places, *cols):
    return df.withColumns({c: F.round(c, places) for c in cols})


@query("stream_statistics", f"WITH {EV} SELECT user_id, round((sum(CASE WHEN event_id % 10 = 0 THEN c * c / 1e8 END) - count(CASE WHEN event_id % 10 = 0 THEN c END)) / sqrt(2 * count(CASE WHEN event_id % 10 = 0 THEN c END)), 5) AS chi2, round(max(abs(c / 1e4)), 6) AS absmax FROM ev GROUP BY user_id")
def _(spark, sf):
    e = events(spark, sf).withColumn("s", F.lit(1e4))
    return rounded(rounded(validation.stream_statistics(e, ["user_id"], "event_id", "c", "s"), 5, "chi2"), 6, "absmax")


@query("azimuth_chi2", f"WITH {LI}, b AS (SELECT feed, x, avg(d) / 1e6 AS v, count(*) AS n FROM li GROUP BY feed, x) SELECT feed, round((sum(pow(v * sqrt(n) / 3, 2)) - count(*)) / sqrt(2 * count(*)), 4) AS chi2_az FROM b GROUP BY feed")
def _(spark, sf):
    b = samples(spark, sf).groupBy("feed", "x").agg((F.avg("d") / 1e6).alias("v"), F.count("*").alias("n")).withColumn("s", F.lit(3.0))
    return rounded(validation.azimuth_chi2(b, ["feed"], "v", "n", "s"), 4, "chi2_az")


@query("band_chi2", f"{SP} SELECT feed, " + ", ".join(f"round((coalesce(sum(power / model) FILTER (freq >= {a} AND freq < {b}), 0) - {b - a}) / sqrt({b - a}), 5) AS {n}" for n, a, b in (("low", 0, 10), ("mid", 10, 40), ("high", 40, 64))) + " FROM sp GROUP BY feed")
def _(spark, sf):
    got = validation.band_chi2(spectra(spark, sf), ["feed"], "freq", "power", "model", {"low": (0, 10), "mid": (10, 40), "high": (40, 64)})
    return rounded(got, 5, "low", "mid", "high")


@query("worst_harmonic", f"{SP} SELECT feed, round(max(power / model), 6) AS spike FROM sp WHERE (abs(freq - round(freq / 7) * 7) <= 1 OR abs(freq - round(freq / 12.5) * 12.5) <= 1) AND freq > 1 GROUP BY feed")
def _(spark, sf):
    return rounded(validation.worst_harmonic(spectra(spark, sf), ["feed"], "freq", "power", "model", [7.0, 12.5], 1.0), 6, "spike")


@query("fourier_outlier", f"{SP}, m AS (SELECT feed, power, avg(power) OVER (PARTITION BY feed ORDER BY freq ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m FROM sp) SELECT feed, round(max(m) / avg(power), 6) AS high, round(min(m) / avg(power), 6) AS low FROM m GROUP BY feed")
def _(spark, sf):
    return rounded(validation.fourier_outlier(spectra(spark, sf), ["feed"], "freq", "power", 5), 6, "high", "low")


@query("static_cuts", f"WITH {EV}, s AS (SELECT user_id, avg(c) AS m, max(c) AS top FROM ev GROUP BY user_id) SELECT user_id, CAST(CASE WHEN m < 4000 OR m > 6000 THEN 2 ELSE 0 END + CASE WHEN top > 30000 THEN 8 ELSE 0 END AS BIGINT) AS status FROM s")
def _(spark, sf):
    s = events(spark, sf).groupBy("user_id").agg(F.avg("c").alias("m"), F.max("c").alias("top"))
    return validation.static_cuts(s, {"m": (1, 4000.0, 6000.0), "top": (3, None, 30000.0)}).select("user_id", F.col("status").cast("long").alias("status"))


@query("weather_cut", f"WITH {EV}, a AS (SELECT feed, avg(CASE WHEN c > 5000 THEN 1.0 ELSE 0 END) AS bad FROM ev GROUP BY feed) SELECT feed, round(bad, 9) AS bad, bad > 0.37 AS reject FROM a")
def _(spark, sf):
    return rounded(validation.weather_cut(events(spark, sf), ["feed"], "c", 5000.0, 0.37), 9, "bad")


@query(
    "reduction_report",
    f"WITH {EV} SELECT feed, count(DISTINCT event_type) AS scans, count(DISTINCT user_id) AS detectors, count(*) AS rows, count(*) FILTER (event_id % 3 = 0) AS accepted, round(sum(c) / 3600, 6) AS hours, round(coalesce(sum(c) FILTER (event_id % 3 = 0), 0) / 3600, 6) AS accepted_hours FROM ev GROUP BY feed",
)
def _(spark, sf):
    e = events(spark, sf).withColumn("status", F.col("event_id") % 3)
    return rounded(validation.report(e, ["feed"], "status", "user_id", "event_type", "c"), 6, "hours", "accepted_hours")


SKY = "s AS (SELECT c_custkey AS k, radians(c_custkey * 37 % 3600 / 10.0) AS lon, radians(c_custkey * 11 % 1600 / 10.0 - 80) AS lat FROM customer)"


def sky(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("k"), F.radians(k * 37 % 3600 / 10.0).alias("lon"), F.radians(k * 11 % 1600 / 10.0 - 80).alias("lat"))


CENTRE, STEP, REF = (1.0, 0.5), (-0.01, 0.01), (50.0, 40.0)
COSC = f"(sin({CENTRE[1]}) * sin(lat) + cos({CENTRE[1]}) * cos(lat) * cos(lon - {CENTRE[0]}))"


@query(
    "sky_to_pixel",
    f"WITH {SKY} SELECT k, CASE WHEN {COSC} > 0.1 THEN round(cos(lat) * sin(lon - {CENTRE[0]}) / {COSC} / {STEP[0]} + {REF[0]}, 5) END AS i, "
    f"CASE WHEN {COSC} > 0.1 THEN round((cos({CENTRE[1]}) * sin(lat) - sin({CENTRE[1]}) * cos(lat) * cos(lon - {CENTRE[0]})) / {COSC} / {STEP[1]} + {REF[1]}, 5) END AS j FROM s",
)
def _(spark, sf):
    s = sky(spark, sf)
    near = angles.dot(angles.unit_vector(F.col("lon"), F.col("lat")), angles.unit_vector(F.lit(CENTRE[0]), F.lit(CENTRE[1]))) > 0.1
    i, j = angles.sky_to_pixel(F.col("lon"), F.col("lat"), CENTRE, STEP, REF)
    return s.select("k", F.when(near, F.round(i, 5)).alias("i"), F.when(near, F.round(j, 5)).alias("j"))


@query("pixel_round_trip", f"WITH {SKY} SELECT k, round(lon, 7) AS lon, round(lat, 7) AS lat FROM s WHERE {COSC} > 0.1")
def _(spark, sf):
    s = sky(spark, sf)
    near = angles.dot(angles.unit_vector(F.col("lon"), F.col("lat")), angles.unit_vector(F.lit(CENTRE[0]), F.lit(CENTRE[1]))) > 0.1
    i, j = angles.sky_to_pixel(F.col("lon"), F.col("lat"), CENTRE, STEP, REF)
    lon, lat = angles.pixel_to_sky(i, j, CENTRE, STEP, REF)
    return s.filter(near).select("k", F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat"))


@query(
    "detector_direction",
    f"WITH {SKY}, o AS (SELECT *, 0.02 * cos(k % 5) - 0.01 * sin(k % 5) AS ax, 0.02 * sin(k % 5) + 0.01 * cos(k % 5) AS up, sqrt(0.0005) AS off FROM s), "
    "u AS (SELECT *, cos(off) AS a, sin(off) / off * ax AS b, sin(off) / off * up AS c FROM o) "
    "SELECT k, round(asin(cos(lat) * c + sin(lat) * a), 8) AS lat, round(cos(lat) * a - sin(lat) * c, 8) AS out, round(b, 8) AS across FROM u",
)
def _(spark, sf):
    s = sky(spark, sf)
    lon, lat = angles.detector_direction(F.col("lon"), F.col("lat"), F.lit(0.02), F.lit(0.01), (F.col("k") % 5).cast("double"))
    u = angles.rotate(angles.unit_vector(lon, lat), "z", -F.col("lon"))  # seen from the boresight's meridian
    return s.select("k", F.round(lat, 8).alias("lat"), F.round(u[0], 8).alias("out"), F.round(u[1], 8).alias("across"))


@query(
    "object_positions",
    f"WITH {EV}, g AS (SELECT user_id, t, max(radians(c % 360)) AS lon, max(radians(c % 160 - 80)) AS lat FROM ev WHERE event_type = 'view' GROUP BY user_id, t), l AS (SELECT event_id, user_id, t FROM ev WHERE event_type = 'click'), "
    "a AS (SELECT l.event_id, l.user_id, l.t, g.t AS t0, g.lon AS lon0, g.lat AS lat0 FROM l ASOF LEFT JOIN g ON l.user_id = g.user_id AND l.t >= g.t), b AS (SELECT a.*, g.t AS t1, g.lon AS lon1, g.lat AS lat1 FROM a ASOF LEFT JOIN g ON a.user_id = g.user_id AND a.t < g.t), "
    "n AS (SELECT *, t - t0 <= 90000 AND (t = t0 OR t1 - t <= 90000) AS near, CASE WHEN t = t0 THEN 0 ELSE (t - t0) / (t1 - t0) END AS f FROM b), "
    "v AS (SELECT *, (1 - f) * cos(lat0) * cos(lon0) + f * coalesce(cos(lat1) * cos(lon1), 0) AS x, (1 - f) * cos(lat0) * sin(lon0) + f * coalesce(cos(lat1) * sin(lon1), 0) AS y, (1 - f) * sin(lat0) + f * coalesce(sin(lat1), 0) AS z FROM n) "
    "SELECT event_id, CASE WHEN near THEN round(x / sqrt(x * x + y * y + z * z), 6) END AS x, CASE WHEN near THEN round(y / sqrt(x * x + y * y + z * z), 6) END AS y, CASE WHEN near THEN round(asin(z / sqrt(x * x + y * y + z * z)), 6) END AS lat FROM v",
)
def _(spark, sf):
    e = events(spark, sf)
    g = e.filter("event_type = 'view'").groupBy("user_id", "t").agg(F.max(F.radians(F.col("c") % 360)).alias("lon"), F.max(F.radians(F.col("c") % 160 - 80)).alias("lat"))
    got = joins.object_positions(e.filter("event_type = 'click'").select("event_id", "user_id", "t"), g, "t", "lon", "lat", 90000.0, ["user_id"])
    u = angles.unit_vector(F.col("lon"), F.col("lat"))
    return got.select("event_id", F.round(u[0], 6).alias("x"), F.round(u[1], 6).alias("y"), F.round("lat", 6).alias("lat"))


@query("vector_algebra", f"WITH {SKY}, v AS (SELECT k, cos(lat) * cos(lon) AS x, cos(lat) * sin(lon) AS y, sin(lat) AS z FROM s) SELECT k, round(0.6 * x + 0.8 * z, 9) AS dot, round(0.8 * y, 9) + 0 AS cx, round(0.6 * z - 0.8 * x, 9) + 0 AS cy, round(-0.6 * y, 9) + 0 AS cz, round(sqrt(pow(0.8 * y, 2) + pow(0.8 * x - 0.6 * z, 2) + pow(0.6 * y, 2)), 9) AS size FROM v")
def _(spark, sf):
    u, w = angles.unit_vector(F.col("lon"), F.col("lat")), [F.lit(0.6), F.lit(0.0), F.lit(0.8)]
    c = angles.cross(u, w)
    return sky(spark, sf).select("k", F.round(angles.dot(u, w), 9).alias("dot"), (F.round(c[0], 9) + 0.0).alias("cx"), (F.round(c[1], 9) + 0.0).alias("cy"), (F.round(c[2], 9) + 0.0).alias("cz"), F.round(angles.norm(c), 9).alias("size"))


ALPHAS = [round(0.88 + 0.03 * i, 2) for i in range(9)]


@query("strip_differences", f"WITH {LI}, {MP}, j AS (SELECT m1.x, m1.y, m1.v AS a, m2.v * 1e6 AS b FROM m1 JOIN m2 USING (x, y)), d AS (SELECT alpha, CAST(floor(x / 3.0 + 0.5) AS BIGINT) AS bin, a - alpha * b AS d FROM j, (SELECT CAST(unnest({ALPHAS}) AS DOUBLE) AS alpha) WHERE abs(y - 12) < 5) SELECT alpha, bin, round(avg(d), 2) AS mean, count(*) AS n FROM d WHERE d <> 0 GROUP BY alpha, bin")
def _(spark, sf):
    m1, m2 = map_values(spark, sf)
    got = mapalgebra.strip_differences(m1, m2.withColumn("v", F.col("v") * 1e6), ["x", "y"], "v", F.col("x"), F.col("y") - 12, ALPHAS, 5, 3.0)
    return rounded(got, 2, "mean")


@query("columns_shifted", f"WITH {LI} SELECT l_orderkey, feed, w AS x, x AS y, CAST(y AS BIGINT) AS d, d AS w FROM li")
def _(spark, sf):
    li = samples(spark, sf).select("l_orderkey", "feed", "x", "y", "d", "w")
    return mapalgebra.columns_shifted(li, ["x", "y", "d", "w"], 1)


@query("scatter_slopes", f"WITH {LI}, {MP}, j AS (SELECT x % 4 AS region, m1.v AS a, m2.v AS b FROM m1 JOIN m2 USING (x, y)), s AS (SELECT p.region, list_sort(list((q.b - p.b) / (q.a - p.a))) AS l FROM j p JOIN j q ON p.region = q.region AND p.a < q.a GROUP BY p.region) SELECT j.region, round(corr(a, b), 6) AS corr, count(*) AS n, any_value(l[len(l) // 2 + 1]) AS slope FROM j JOIN s ON s.region = j.region GROUP BY j.region")
def _(spark, sf):
    m1, m2 = map_values(spark, sf)
    return rounded(fits.scatter_slopes(m1, m2, m1.select("x", "y", (F.col("x") % 4).alias("region")), ["x", "y"], "v", "region"), 6, "corr")


@query("solve_equations", "SELECT n_nationkey AS i, round(n_nationkey % 7 + 0.5, 6) AS x FROM nation")
def _(spark, sf):
    """A = 3 on the diagonal, -1 beside it; b = A x for the x of the SQL."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("i"))
    a = n.select("i", F.explode(F.array(F.col("i") - 1, F.col("i"), F.col("i") + 1)).alias("j")).join(n.select(F.col("i").alias("j")), "j")
    a = a.select("i", "j", F.when(F.col("i") == F.col("j"), 3.0).otherwise(-1.0).alias("v"))
    return rounded(matrices.solve(a, matrices.apply(a, n.select("i", (F.col("i") % 7 + 0.5).alias("x")))), 6, "x")


@query("housekeeping_units", f"WITH {EV} SELECT event_id, CASE feed % 4 WHEN 0 THEN 2 * c + 1 WHEN 1 THEN CASE WHEN c >= 1000 AND c <= 9000 THEN 0.5 * c - 3 END WHEN 2 THEN -c ELSE c END AS c FROM ev")
def _(spark, sf):
    boards = spark.createDataFrame([(0, 2.0, 1.0, None, None), (1, 0.5, -3.0, 1000.0, 9000.0), (2, -1.0, 0.0, None, None)], "board long, scale double, offset double, low double, high double")
    e = events(spark, sf).select("event_id", (F.col("feed") % 4).cast("long").alias("board"), "c")
    return level1.converted(e, boards, "board", "c").select("event_id", "c")


@query("sparse_to_dense", f"WITH {LI}, p AS (SELECT x AS pix, sum(d) AS v FROM li WHERE x % 3 = 0 GROUP BY x) SELECT r.pix, p.v FROM (SELECT range AS pix FROM range(20)) r LEFT JOIN p USING (pix)")
def _(spark, sf):
    p = samples(spark, sf).filter("x % 3 = 0").groupBy(F.col("x").alias("pix")).agg(F.sum("d").alias("v"))
    d = products.dense(p, "pix", "v", 20)
    return d.select("pix", mapalgebra.from_sentinel(F.col("v")).alias("v"))
