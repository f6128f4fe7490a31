"""Queries on maps: binning, levels, splits, algebra, matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.angles import grid_index
from ..operators import binning, mapalgebra, matrices
from ..registry import query, table
from .proxies import CH, LI, MP, channels, map_values, samples

FINAL = "CAST(sum(n) AS BIGINT) AS nhit, sum(s) / sum(w) AS m, 1 / sqrt(sum(w)) AS rms"
SUMS = "s AS (SELECT x, y, feed, count(*) AS n, sum(d * w) AS s, sum(w) AS w FROM li GROUP BY x, y, feed)"


def sums(spark, sf, keys=("x", "y", "feed")) -> DataFrame:
    return binning.accumulate(samples(spark, sf), list(keys), F.col("d"), F.col("w"))


@query("map_binning", f"WITH {LI}, {SUMS} SELECT x, y, feed, {FINAL} FROM s GROUP BY x, y, feed")
def _(spark, sf):
    return binning.finalised(sums(spark, sf))


@query("map_feed_and_coadd", f"WITH {LI}, {SUMS} SELECT x, y, 'feed' AS level, feed, {FINAL} FROM s GROUP BY x, y, feed UNION ALL SELECT x, y, 'coadd', NULL, {FINAL} FROM s GROUP BY x, y")
def _(spark, sf):
    return binning.finalised(binning.at_levels(sums(spark, sf), ["x", "y"], [["feed"], []], ["feed", "coadd"]))


@query(
    "map_scan_field_total",
    f"WITH {LI}, s AS (SELECT x, l_orderkey % 40 AS scan, l_orderkey % 8 AS field, count(*) AS n, sum(d * w) AS s, sum(w) AS w FROM li GROUP BY ALL) "
    f"SELECT x, 'scan' AS level, field, scan, {FINAL} FROM s GROUP BY x, field, scan UNION ALL SELECT x, 'field', field, NULL, {FINAL} FROM s GROUP BY x, field UNION ALL SELECT x, 'total', NULL, NULL, {FINAL} FROM s GROUP BY x",
)
def _(spark, sf):
    d = samples(spark, sf).withColumn("scan", F.col("l_orderkey") % 40).withColumn("field", F.col("l_orderkey") % 8)
    s = binning.accumulate(d, ["x", "field", "scan"], F.col("d"), F.col("w"))
    return binning.finalised(binning.at_levels(s, ["x"], [["field", "scan"], ["field"], []], ["scan", "field", "total"]))


@query(
    "map_split_halves",
    f"WITH {LI}, h AS (SELECT *, 'order' AS split, l_orderkey % 2 AS half FROM li UNION ALL SELECT *, 'line', CASE WHEN feed < 3 THEN 0 WHEN feed > 4 THEN 1 END FROM li) "
    "SELECT split, CAST(half AS INTEGER) AS half, x, y, count(*) AS nhit, sum(d * w) / sum(w) AS m, 1 / sqrt(sum(w)) AS rms FROM h WHERE half IS NOT NULL GROUP BY split, half, x, y",
)
def _(spark, sf):
    h = binning.split_halves(samples(spark, sf), {"order": F.col("l_orderkey") % 2, "line": F.when(F.col("feed") < 3, 0).when(F.col("feed") > 4, 1)})
    return binning.finalised(binning.accumulate(h, ["split", "half", "x", "y"], F.col("d"), F.col("w")))


@query("map_multi_split", f"WITH {LI} SELECT CAST((l_orderkey % 2) * 4 + (feed % 2) + 2 * (x % 2) AS INTEGER) AS part, y, count(*) AS nhit, sum(d * w) / sum(w) AS m, 1 / sqrt(sum(w)) AS rms FROM li GROUP BY ALL")
def _(spark, sf):
    p = binning.multi_split(F.col("l_orderkey") % 2, [F.col("feed") % 2, F.col("x") % 2])
    return binning.finalised(binning.accumulate(samples(spark, sf).withColumn("part", p), ["part", "y"], F.col("d"), F.col("w")))


@query(
    "split_bits",
    f"WITH {LI}, w AS (SELECT *, l_orderkey % 32 AS word FROM li), b AS (SELECT word, unnest([1, 2, 3, 4]) AS i FROM w WHERE word % 2 = 1) "
    "SELECT 's' || i AS split, CAST((word // CAST(pow(2, i) AS BIGINT)) % 2 AS INTEGER) AS half, count(*) AS n FROM b GROUP BY ALL",
)
def _(spark, sf):
    w = samples(spark, sf).select((F.col("l_orderkey") % 32).alias("word"))
    return binning.split_bits(w, "word", ["s1", "s2", "s3", "s4"]).groupBy("split", "half").agg(F.count("*").alias("n"))


@query(
    "map_hits",
    f"WITH {LI}, g AS (SELECT CAST(round((w - 10) / 4) AS BIGINT) AS i FROM li) SELECT i, count(*) AS nhit, i BETWEEN 1 AND 6 AS binned FROM g WHERE i BETWEEN 0 AND 7 GROUP BY i",
)
def _(spark, sf):
    got = samples(spark, sf).select(grid_index(F.col("w"), 10, 4, 8).alias("i"), grid_index(F.col("w"), 10, 4, 8, 1).isNotNull().alias("binned"))
    return got.filter("i IS NOT NULL").groupBy("i", "binned").agg(F.count("*").alias("nhit"))


@query(
    "map_degrade",
    f"WITH {LI}, p AS (SELECT x * 25 + y AS pix, sum(d) AS v FROM li GROUP BY ALL) SELECT pix // 16 AS pix, sum(v) / count(*) AS v, count(*) AS children FROM p GROUP BY ALL",
)
def _(spark, sf):
    p = samples(spark, sf).groupBy((F.col("x") * 25 + F.col("y")).alias("pix")).agg(F.sum("d").alias("v"))
    return binning.degraded(p, "pix", "v", 2)


@query("map_upgrade", f"WITH {LI}, p AS (SELECT x AS pix, sum(d) AS v FROM li GROUP BY ALL), u AS (SELECT unnest(range(pix * 16, pix * 16 + 16)) AS pix, v FROM p) SELECT * FROM u")
def _(spark, sf):
    return binning.upgraded(samples(spark, sf).groupBy(F.col("x").alias("pix")).agg(F.sum("d").alias("v")), "pix", 2)


@query("map_degrade_noise", f"WITH {LI}, p AS (SELECT x * 25 + y AS pix, sum(w) AS v FROM li GROUP BY ALL) SELECT pix // 4 AS pix, sum(v) / count(*) / count(*) AS v FROM p GROUP BY ALL")
def _(spark, sf):
    p = samples(spark, sf).groupBy((F.col("x") * 25 + F.col("y")).alias("pix")).agg(F.sum("w").alias("v"))
    return binning.degraded_noise(p, "pix", "v", 1)


SINGLE = ["scale", "add_offset", "log", "ln", "abs", "sqrt", "inv", "hitcount2rms", "max_scalar", "min_scalar", "missing2mask", "rms2mask", "amp2mask", "hitcount2mask"]
SINGLE_SQL = {
    "scale": "v * 3", "add_offset": "v + 3", "log": "CASE WHEN v > 0 THEN log10(v) END", "ln": "CASE WHEN v > 0 THEN ln(v) ELSE v END", "abs": "abs(v)", "sqrt": "CASE WHEN v > 0 THEN sqrt(v) ELSE v END", "inv": "CASE WHEN v <> 0 THEN 1 / v ELSE v END",
    "hitcount2rms": "CASE WHEN v > 0 THEN 3 / sqrt(v) END", "max_scalar": "CASE WHEN v > 3 THEN v ELSE 3.0 END", "min_scalar": "CASE WHEN v < 3 THEN v ELSE 3.0 END", "missing2mask": "CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END", "rms2mask": "CASE WHEN v IS NULL OR v >= 3 THEN 0.0 ELSE 1.0 END",
    "amp2mask": "CASE WHEN v IS NULL OR abs(v) > 3 THEN 0.0 ELSE 1.0 END", "hitcount2mask": "CASE WHEN v > (SELECT max(v) FROM s) / 9 THEN 1.0 ELSE 0.0 END",
}


@query("map_single_operations", f"WITH {LI}, {MP}, s AS (SELECT x, y, v - 500 AS v FROM m2) SELECT x, y, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {n}" for n, c in SINGLE_SQL.items()) + " FROM s")
def _(spark, sf):
    m = map_values(spark, sf)[1].withColumn("v", F.col("v") - 500)
    m = m.crossJoin(F.broadcast(m.agg(F.max("v").alias("top"))))  # one row
    return m.select("x", "y", *[F.round(mapalgebra.single(n, F.col("v"), 3.0, F.col("top")).cast("double"), 6).alias(n) for n in SINGLE])


PAIR = {"add": "a + b", "subtract": "a - b", "multiply": "a * b", "divide": "a / nullif(b, 0)", "half_sum": "(a + b) / 2", "half_diff": "(a - b) / 2", "max": "greatest(a, b)", "min": "least(a, b)"}


@query("map_pair_operations", f"WITH {LI}, {MP}, j AS (SELECT x, y, m1.v AS a, m2.v AS b FROM m1 JOIN m2 USING (x, y)) SELECT x, y, " + ", ".join(f"{c} AS v_{n}" for n, c in PAIR.items()) + " FROM j")
def _(spark, sf):
    m1, m2 = map_values(spark, sf)
    j = m1.withColumnRenamed("v", "a").join(m2.withColumnRenamed("v", "b"), ["x", "y"])
    return j.select("x", "y", *[mapalgebra.pair(n, F.col("a"), F.col("b")).alias(f"v_{n}") for n in PAIR])


@query("map_splice", f"WITH {LI}, {MP}, a AS (SELECT * FROM m1 WHERE x < 9), b AS (SELECT * FROM m2 WHERE x > 5) SELECT coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, coalesce(a.v, b.v) AS v FROM a FULL JOIN b ON a.x = b.x AND a.y = b.y")
def _(spark, sf):
    m1, m2 = map_values(spark, sf)
    return mapalgebra.combine(m1.filter("x < 9"), m2.filter("x > 5"), ["x", "y"], "v", "splice")


@query("map_weighted_sum", f"WITH {LI}, {MP} SELECT x, y, 2 * m1.v - 3 * m2.v AS v FROM m1 JOIN m2 USING (x, y)")
def _(spark, sf):
    return mapalgebra.weighted_sum(list(map_values(spark, sf)), [2, -3], ["x", "y"], "v")


@query("map_mean_and_deviation", f"WITH {LI}, {MP}, u AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2) SELECT x, y, sum(v) / count(*) AS mean, round(stddev_samp(v), 2) AS std FROM u GROUP BY x, y")
def _(spark, sf):
    got = mapalgebra.mean_and_deviation(list(map_values(spark, sf)), ["x", "y"], "v")
    return got.select("x", "y", "mean", F.round("std", 2).alias("std"))


@query("map_blend", f"WITH {LI}, {MP} SELECT x, y, round(CASE WHEN w.v > 800 THEN m1.v WHEN w.v < 200 THEN 5.0 ELSE (w.v - 200) / 600 * m1.v + (1 - (w.v - 200) / 600) * 5 END, 3) AS v FROM m1 JOIN m2 w USING (x, y)")
def _(spark, sf):
    m1, m2 = map_values(spark, sf)
    j = m1.join(m2.withColumnRenamed("v", "w"), ["x", "y"])
    return j.select("x", "y", F.round(mapalgebra.blended(j, "w", "v", 200, 800, 5.0), 3).alias("v"))


@query("map_statistics", f"WITH {LI}, {MP} SELECT x AS ring, sum(v) / count(*) AS mean, round(stddev_samp(v), 2) AS sigma, count(*) AS n FROM m1 WHERE y % 3 <> 0 GROUP BY x")
def _(spark, sf):
    m = map_values(spark, sf)[0].select(F.col("x").alias("ring"), "v", (F.col("y") % 3 != 0).cast("int").alias("ok"))
    got = mapalgebra.statistics(m, "v", "ok", ["ring"])
    return got.select("ring", "mean", F.round("sigma", 2).alias("sigma"), "n")


@query("map_index", f"WITH {LI}, {MP} SELECT x, y, round(CASE WHEN m1.v * m2.v > 0 THEN ln(m1.v / m2.v) / ln(30.0 / 44.0) END, 6) AS beta FROM m1 JOIN m2 USING (x, y)")
def _(spark, sf):
    m1, m2 = map_values(spark, sf)
    j = m1.withColumnRenamed("v", "a").join(m2.withColumnRenamed("v", "b"), ["x", "y"])
    return j.select("x", "y", F.round(mapalgebra.index_map(F.col("a"), F.col("b"), 30.0, 44.0, convert=False), 6).alias("beta"))


@query(
    "map_smooth",
    f"WITH {LI}, {MP}, j AS (SELECT a.x, a.y, b.v, exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 2) AS g FROM m1 a JOIN m1 b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 4) SELECT x, y, round(sum(g * v) / sum(g), 2) AS v FROM j GROUP BY x, y",
)
def _(spark, sf):
    got = mapalgebra.smoothed(map_values(spark, sf)[0], "x", "y", "v", 2, 1.0)
    return got.select("x", "y", F.round("v", 2).alias("v"))


@query(
    "map_mask_edge",
    f"WITH {LI}, {MP}, k AS (SELECT x, y, CASE WHEN v % 5 = 0 THEN 0 ELSE 1 END AS mask FROM m2) SELECT a.x, a.y, any_value(a.mask) AS mask, CASE WHEN min(b.mask) = max(b.mask) THEN 1 ELSE 0 END AS border "
    "FROM k a JOIN k b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 1 GROUP BY a.x, a.y",
)
def _(spark, sf):
    k = map_values(spark, sf)[1].select("x", "y", F.when(F.col("v") % 5 == 0, 0).otherwise(1).alias("mask"))
    return mapalgebra.mask_edge(k, "x", "y", "mask", 1)


@query(
    "map_fill_missing",
    f"WITH {LI}, {MP}, k AS (SELECT x, y, CASE WHEN (x + y) % 4 <> 0 THEN v END AS v FROM m1), n AS (SELECT a.x, a.y, CAST(ceil(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS INTEGER) AS ring, b.v FROM k a JOIN k b ON a.v IS NULL AND b.v IS NOT NULL AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 4), "
    "f AS (SELECT x, y, list_sort(list(v) FILTER (WHERE ring <= 1)) AS l1, list_sort(list(v)) AS l2 FROM n GROUP BY x, y) "
    "SELECT k.x, k.y, coalesce(k.v, CASE WHEN len(l1) > 4 THEN l1[len(l1) // 2 + 1] WHEN len(l2) > 4 THEN l2[len(l2) // 2 + 1] END) AS v FROM k LEFT JOIN f USING (x, y)",
)
def _(spark, sf):
    k = map_values(spark, sf)[0].select("x", "y", F.when((F.col("x") + F.col("y")) % 4 != 0, F.col("v")).alias("v"))
    return mapalgebra.filled(k, "x", "y", "v", 2)


@query("map_row_index", f"WITH {LI}, {MP} SELECT x AS comp, y AS pix, CAST(row_number() OVER (PARTITION BY x ORDER BY y) AS INTEGER) AS index FROM m1 WHERE v % 3 <> 0")
def _(spark, sf):
    m = map_values(spark, sf)[0].select(F.col("x").alias("comp"), F.col("y").alias("pix"), F.when(F.col("v") % 3 != 0, 1).otherwise(0).alias("mask"))
    return mapalgebra.row_index(m, "comp", "pix", "mask")


@query("map_maximum", f"WITH {LI}, {MP} SELECT x, arg_max(y, v * 1000 - y) AS y, max(v) AS v FROM m2 GROUP BY x")
def _(spark, sf):
    m = map_values(spark, sf)[1]
    return m.groupBy("x").agg(F.min_by("y", F.struct(-F.col("v"), F.col("y"))).alias("y"), F.max("v").alias("v"))


MAT = f"{LI}, a AS (SELECT x AS i, y % 20 AS j, sum(w) AS v FROM li GROUP BY ALL), b AS (SELECT y % 20 AS i, x AS j, count(*) * 1.0 AS v FROM li GROUP BY ALL)"


def two_matrices(spark, sf):
    li = samples(spark, sf)
    y = F.col("y") % 20
    return li.groupBy(F.col("x").alias("i"), y.alias("j")).agg(F.sum("w").alias("v")), li.groupBy(y.alias("i"), F.col("x").alias("j")).agg(F.count("*").cast("double").alias("v"))


@query("matrix_multiply", f"WITH {MAT} SELECT a.i, b.j, CAST(sum(a.v * b.v) AS DOUBLE) AS v FROM a JOIN b ON a.j = b.i GROUP BY a.i, b.j")
def _(spark, sf):
    return matrices.multiply(*two_matrices(spark, sf))


@query("matrix_apply", f"WITH {MAT} SELECT i, CAST(sum(v * (j + 1)) AS DOUBLE) AS x FROM a GROUP BY i")
def _(spark, sf):
    a, _ = two_matrices(spark, sf)
    return matrices.apply(a, spark.range(20).select(F.col("id").alias("i"), (F.col("id") + 1.0).alias("x")))


@query("matrix_sum", f"WITH {MAT}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT i, j, CAST(sum(v) AS DOUBLE) AS v FROM u GROUP BY i, j")
def _(spark, sf):
    return matrices.total(list(two_matrices(spark, sf)))


@query("matrix_divide", f"WITH {MAT} SELECT i, j, CAST(a.v / b.v AS DOUBLE) AS v FROM a JOIN b USING (i, j)")
def _(spark, sf):
    return matrices.elementwise(*two_matrices(spark, sf), "divide")


@query("matrix_correlation", f"WITH {MAT} SELECT a.i, a.j, round(a.v / sqrt(p.v * q.v), 9) AS v FROM a JOIN a p ON p.i = a.i AND p.j = a.i JOIN a q ON q.i = a.j AND q.j = a.j")
def _(spark, sf):
    return matrices.correlation(two_matrices(spark, sf)[0]).select("i", "j", F.round("v", 9).alias("v"))


@query("matrix_mask", f"WITH {MAT} SELECT * FROM a WHERE i % 3 = 0 AND j % 3 = 0")
def _(spark, sf):
    return matrices.masked(two_matrices(spark, sf)[0], spark.range(0, 20, 3).select(F.col("id").alias("i")))


@query("matrix_rms", f"WITH {MAT} SELECT i, sqrt(v) AS rms FROM a WHERE i = j")
def _(spark, sf):
    return matrices.rms(two_matrices(spark, sf)[0])


@query("matrix_block_diagonal", f"WITH {MAT} SELECT i, j, CAST(v AS DOUBLE) AS v FROM a UNION ALL SELECT i + 20, j + 20, CAST(v AS DOUBLE) FROM b")
def _(spark, sf):
    return matrices.block_diagonal(list(two_matrices(spark, sf)), [20, 20])


@query("matrix_compare", f"WITH {MAT} SELECT round(sqrt(sum(pow(a.v - b.v, 2)) / count(*)), 6) AS rmsd, round(corr(a.v, b.v), 6) AS corr, count(*) AS n FROM a JOIN b USING (i, j)")
def _(spark, sf):
    return matrices.compare(*two_matrices(spark, sf)).select(F.round("rmsd", 6).alias("rmsd"), F.round("corr", 6).alias("corr"), "n")


@query("matrix_up_add", f"WITH {MAT} SELECT a.i, a.j, CAST(a.v + coalesce(b.v, 0) AS DOUBLE) AS v FROM a LEFT JOIN b ON b.i = a.i // 4 AND b.j = a.j // 4")
def _(spark, sf):
    return matrices.up_add(*two_matrices(spark, sf), 4)


def correlations(tod):
    c = matrices.channel_correlation(tod, ["vec_id"], "freq", "v")
    return c.select("i", "j", F.round("v", 6).alias("v"), "n")


def correlation_blocks(tod):
    got = matrices.block_statistics(matrices.channel_correlation(tod, ["vec_id"], "freq", "v"), 4, 500)
    return got.select("bi", "bj", "n", F.round("chi2", 4).alias("chi2"), F.round("mean", 4).alias("mean"))


def correlation_extremes(tod):
    got = matrices.channel_extremes(matrices.channel_correlation(tod, ["vec_id"], "freq", "v"))
    return got.select("i", *[F.round(k, 5).alias(k) for k in ("mean", "largest", "mean_size")])


@query("channel_correlation", f"WITH {CH} SELECT a.freq AS i, b.freq AS j, round(corr(a.v, b.v), 6) AS v, count(*) AS n FROM chn a JOIN chn b USING (vec_id) WHERE a.freq < b.freq GROUP BY ALL")
def _(spark, sf):
    return correlations(channels(spark, sf))


@query(
    "correlation_blocks",
    f"WITH {CH}, c AS (SELECT a.freq AS i, b.freq AS j, corr(a.v, b.v) AS v FROM chn a JOIN chn b USING (vec_id) WHERE a.freq < b.freq GROUP BY ALL) "
    "SELECT CAST(i // 4 AS BIGINT) AS bi, CAST(j // 4 AS BIGINT) AS bj, count(*) AS n, round((sum(v * v) * 500 - count(*)) / sqrt(2 * count(*)), 4) AS chi2, round(sum(v) * sqrt(500) / sqrt(count(*)), 4) AS mean FROM c GROUP BY ALL",
)
def _(spark, sf):
    return correlation_blocks(channels(spark, sf))


@query(
    "correlation_extremes",
    f"WITH {CH}, c AS (SELECT a.freq AS i, corr(a.v, b.v) AS v FROM chn a JOIN chn b USING (vec_id) WHERE a.freq <> b.freq GROUP BY a.freq, b.freq) "
    "SELECT i, round(avg(v), 5) AS mean, round(max(abs(v)), 5) AS largest, round(avg(abs(v)), 5) AS mean_size FROM c WHERE v <> 0 GROUP BY i",
)
def _(spark, sf):
    return correlation_extremes(channels(spark, sf))


@query(
    "feed_inverse_variance",
    f"WITH {LI}, f AS (SELECT x, feed, sum(d * w) / sum(w) AS m, 1 / sqrt(sum(w)) AS r FROM li GROUP BY x, feed) SELECT x, round(sum(m / (r * r)) / sum(1 / (r * r)), 4) AS m, round(1 / sqrt(sum(1 / (r * r))), 9) AS rms FROM f GROUP BY x",
)
def _(spark, sf):
    from ..functions.stats import inverse_variance

    f = binning.finalised(sums(spark, sf, ("x", "feed")))
    m, r = inverse_variance(F.col("m"), F.col("rms"))
    return f.groupBy("x").agg(F.round(m, 4).alias("m"), F.round(r, 9).alias("rms"))


@query("pixel_polarisation", f"WITH {LI}, {MP} SELECT x, y, round(sqrt(m1.v * m1.v + m2.v * m2.v), 3) AS p FROM m1 JOIN m2 USING (x, y)")
def _(spark, sf):
    m1, m2 = map_values(spark, sf)
    j = m1.withColumnRenamed("v", "q").join(m2.withColumnRenamed("v", "u"), ["x", "y"])
    return j.select("x", "y", F.round(mapalgebra.polarised_intensity(F.col("q"), F.col("u")), 3).alias("p"))


@query("unique_values", "SELECT DISTINCT l_partkey % 100 AS v FROM lineitem INTERSECT SELECT l_suppkey FROM lineitem")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_partkey") % 100).alias("v")).intersect(li.select(F.col("l_suppkey").alias("v")))


@query("rejected_orders", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, sf):
    bad = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(bad, "o_orderkey", "left_anti")
