import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmap.functions import angles, stats, text
from strandmap.operators import binning, destripe, fits, joins, kernels, mapalgebra, matrices, splits, timeseries


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).head()


def test_rounding_and_grid(spark):
    r = one(spark, angles.nearest_int(F.lit(2.5)), angles.half_even(F.lit(2.5)), angles.grid_index(F.lit(0.0), 0.0, 1.0, 5), angles.grid_index(F.lit(0.0), 0.0, 1.0, 5, 1), angles.grid_index(F.lit(-0.6), 0.0, 1.0, 5))
    assert tuple(r) == (3, 2, 0, None, None)


def test_rotations(spark):
    lon, lat = F.lit(0.7), F.lit(0.3)
    u = angles.unit_vector(lon, lat)
    turned = angles.euler_zyz_inverse(angles.euler_zyz(u, F.lit(1.0), F.lit(0.5), F.lit(0.2)), F.lit(1.0), F.lit(0.5), F.lit(0.2))
    r = one(spark, *angles.lon_lat(turned), angles.distance(lon, lat, F.lit(0.7), F.lit(0.3)))
    assert r[0] == pytest.approx(0.7) and r[1] == pytest.approx(0.3) and r[2] == 0
    ra, dec = angles.horizontal_to_equatorial(F.lit(0.0), F.lit(math.pi / 2), F.lit(1.0), 0.65)
    assert tuple(one(spark, ra, dec)) == pytest.approx((1.0, 0.65))


def test_times(spark):
    t = F.timestamp_seconds(F.lit(1704067200))
    r = one(spark, angles.mjd(t), F.unix_seconds(angles.from_mjd(angles.mjd(t))))
    assert tuple(r) == (60310.0, 1704067200)


def test_text(spark):
    c = F.lit("a (b c) 'd e' f")
    r = one(spark, text.grouped_tokens(c), text.nth_token(F.lit("x  y z"), 2), text.nth_token(F.lit("x"), 2), text.to_int(F.lit(" 12 ")), text.to_int(F.lit("1x")), text.bits_of(F.lit(37), 8), text.scan_mode(F.lit(32 + 512)))
    assert tuple(r) == (["a", "(b c)", "'d e'", "f"], "y", None, 12, None, [0, 2, 5], "ces")


def test_order_stats_by_definition(spark):
    x = [5.0, 1.0, 4.0, 4.0, float("nan"), None, 9.0, 2.0]
    df = spark.createDataFrame([(1, v) for v in x], "k int, v double")
    r = stats.order_stats(df, ["k"], "v", {"med": stats.median_rank(), "q": stats.quantile_rank(0.9)}).head()
    s = sorted(v for v in x if v is not None and v == v)
    assert (r["n"], r["med"], r["q"]) == (6, s[3], s[5])


def test_masked_moments_of_nothing(spark):
    df = spark.createDataFrame([(1, 2.0, 0)], "k int, v double, m int")
    assert tuple(stats.masked_moments(df, ["k"], "v", "m", 3.0).head()) == (1, 0.0, 1e20)


def test_asof_across_spans(spark):
    left = spark.createDataFrame([(float(t),) for t in (-1, 0, 5, 25, 99)], "t double")
    right = spark.createDataFrame([(0.0, "a"), (4.0, "b"), (30.0, "c")], "t double, v string")
    for span in (None, F.floor(F.col("_at") / 10)):
        got = {r["t"]: r["v"] for r in joins.asof(left, right, "t", ["v"], span=span).collect()}
        assert got == {-1: None, 0: "a", 5: "b", 25: "b", 99: "c"}
        near = {r["t"]: r["v"] for r in joins.asof(left, right, "t", ["v"], direction="nearest", span=span).collect()}
        assert near == {-1: "a", 0: "a", 5: "b", 25: "c", 99: "c"}


def test_asof_ties_and_long_groups(spark):
    left = spark.createDataFrame([(5.0, 1), (6.0, 2), (8.0, 3)], "t double, k int")
    right = spark.createDataFrame([(5.0, 10), (7.0, 20)], "t double, c int")
    pick = lambda way: {r["t"]: r["c"] for r in joins.asof(left, right, "t", ["c"], direction=way).collect()}
    assert pick("backward") == {5.0: 10, 6.0: 10, 8.0: 20}
    assert pick("forward") == {5.0: 10, 6.0: 20, 8.0: None}
    assert pick("nearest") == {5.0: 10, 6.0: 20, 8.0: 20}
    many = spark.range(60_000).select(F.lit(1).alias("k"), (F.col("id") + 100.0).alias("t"))
    few = spark.range(10).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("t"), F.col("id").alias("c"))
    for way in ("forward", "nearest"):  # one key, all right rows before all left rows
        began = time.time()
        assert joins.asof(many, few, "t", ["c"], ["k"], way).filter("c IS NULL" if way == "forward" else "c = 9").count() == 60_000
        assert time.time() - began < 60


def test_equations_are_solved(spark, tmp_path):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(12, 12))
    m, b = m @ m.T + 3 * np.eye(12), rng.normal(size=12)
    a = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(12) for j in range(12)], "i long, j long, v double")
    got = {r["i"]: r["x"] for r in matrices.solve(a, spark.createDataFrame(list(enumerate(b.tolist())), "i long, x double")).collect()}
    assert np.allclose([got[i] for i in range(12)], np.linalg.solve(m, b), atol=1e-8)
    with pytest.raises(ValueError):
        matrices.solve(a.withColumn("v", -F.col("v")), spark.createDataFrame([(0, 1.0)], "i long, x double"))
    assert matrices.solve(a.limit(0), spark.createDataFrame([], "i long, x double")).count() == 0


def test_correlation_with_missing_samples(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 5)) + 1e6
    x[:, 1] += x[:, 0]
    x[rng.random(x.shape) < 0.2] = np.nan
    rows = [(int(t), int(c) * 3, float(x[t, c])) for t, c in zip(*np.nonzero(~np.isnan(x)), strict=True)]
    got = matrices.channel_correlation(spark.createDataFrame(rows, "t long, c int, v double").repartition(4), ["t"], "c", "v").toPandas()
    assert len(got) == 10
    for r in got.itertuples():
        both = ~np.isnan(x[:, r.i // 3]) & ~np.isnan(x[:, r.j // 3])
        assert r.n == both.sum() and abs(r.v - np.corrcoef(x[both, r.i // 3], x[both, r.j // 3])[0, 1]) < 1e-9
    assert matrices.channel_correlation(spark.createDataFrame([], "t long, c int, v double"), ["t"], "c", "v").count() == 0


def test_spikes_and_kinds(spark):
    x = np.zeros(100)
    x[50] = 20
    y = np.zeros(100)
    y[60:] = 20
    rows = [("spike", i, float(v)) for i, v in enumerate(x)] + [("jump", i, float(v)) for i, v in enumerate(y)]
    got = timeseries.spikes(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], "t", "v").collect()
    assert sorted((r["k"], r["t"], r["kind"]) for r in got) == [("jump", 60, "jump"), ("spike", 50, "spike")]


def test_best_lag(spark):
    r = np.random.default_rng(1).normal(size=300).cumsum()
    a = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(r)], "k int, i int, v double")
    b = a.withColumn("i", F.col("i") + 7)
    assert timeseries.best_lag(a, b, ["k"], "i", "v", 20).head()["lag"] == 7


def test_decimation_parity(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(6)], "k int, i int, v double")
    assert [r["v"] for r in timeseries.decimated(df, ["k"], "i", 3, "v").orderBy("i").collect()] == [1, 4]
    assert [r["v"] for r in timeseries.decimated(df, ["k"], "i", 3, "v", parity=True).orderBy("i").collect()] == [3, 12]


def test_knife_grammar(spark):
    assert splits.parse("az(3)").parts == (3,)
    assert splits.parse("mjd[1:2+3:4,5:6]").parts == (((1, 2), (3, 4)), ((5, 6),))
    assert splits.parse("el{0:2:4}").parts == (0, 2, 4) and splits.parse("x<1,2>").parts == (1, 2)
    with pytest.raises(ValueError):
        splits.parse("nothing")
    df = spark.range(12).select(F.col("id").alias("az"), F.lit(1.0).alias("w"))
    got = splits.assign(df, splits.parse("az(3)"), [], "w", "g").groupBy("g").count().orderBy("g").collect()
    assert [tuple(r) for r in got] == [(1, 4), (2, 4), (3, 4)]


def test_monopole_and_dipole_removed(spark):
    r = np.random.default_rng(0).normal(size=(200, 3))
    r /= np.linalg.norm(r, axis=1)[:, None]
    rows = [(float(a), float(b), float(c), float(3 + a - 2 * b + 0.5 * c), 1.0) for a, b, c in r]
    m = spark.createDataFrame(rows, "x double, y double, z double, v double, mask double")
    assert mapalgebra.remove_monopole_dipole(m, ["x", "y", "z"], "v", "mask").agg(F.max(F.abs("v"))).head()[0] < 1e-9


def test_best_angle(spark):
    m = spark.createDataFrame([(math.cos(0.8) * a, math.sin(0.8) * a) for a in (1.0, 2.0, -3.0)], "q double, u double")
    assert mapalgebra.best_angle(m, "q", "u", 10001).head()["angle"] % (math.pi / 2) == pytest.approx(0.4, abs=1e-3)


def test_sentinel(spark):
    r = one(spark, mapalgebra.from_sentinel(F.lit(-1.6375e30)), mapalgebra.from_sentinel(F.lit(2.0)), mapalgebra.to_sentinel(F.lit(None).cast("double")))
    assert tuple(r) == (None, 2.0, -1.6375e30)


def test_polynomial_fit(spark):
    rows = [(g, float(x), 1.0 + g * x - 0.5 * x * x) for g in (1, 2) for x in range(6)]
    got = {r["g"]: r["fit"] for r in fits.polynomial(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], "x", "y", 2).collect()}
    assert got[1] == pytest.approx([1, 1, -0.5]) and got[2] == pytest.approx([1, 2, -0.5])


def test_kernels_in_groups(spark):
    r = np.random.default_rng(2)
    common = r.normal(size=100)
    rows = [(f, i, c, float(common[i] * (c + 1) + 0.01 * r.normal())) for f in (1, 2) for i in range(100) for c in range(6)]
    df = spark.createDataFrame(rows, "feed int, i int, freq int, v double")
    out = kernels.per_feed(df, ["feed"], "i", "freq", "v", lambda m: kernels.without_components(m, 1))
    assert out.count() == 1200 and out.agg(F.stddev("v")).head()[0] < 0.02
    fit = kernels.noise_fits(df.filter("freq = 0"), ["feed"], "i", "v", 1.0)
    assert fit.count() == 2
    assert kernels.spectra(df.filter("freq = 0"), ["feed"], "i", "v", 1.0).count() == 2 * 51


def test_destriper_finds_offsets(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    r = np.random.default_rng(3)
    sky, off = r.normal(size=25), r.normal(size=20) * 10
    rows = [(int(p), b, float(sky[p] + off[b])) for b in range(20) for p in r.integers(0, 25, 30)]
    tod = spark.createDataFrame(rows, "pix int, base int, v double").withColumn("w", F.lit(2.0))
    base, m = destripe.destripe(tod, ["pix"], ["base"], "v", "w", 60, 1e-9)
    a = np.array([x["a"] for x in base.orderBy("base").collect()])
    assert a - a.mean() == pytest.approx(off - off.mean(), abs=1e-4)
    v = {x["pix"]: x["m"] for x in m.collect()}
    got, want = np.array([v[p] for p in sorted(v)]), np.array([sky[p] for p in sorted(v)])
    assert got - got.mean() == pytest.approx(want - want.mean(), abs=1e-4)


def test_binned_empty_bins(spark):
    df = spark.createDataFrame([(0.5, 2.0), (2.5, 4.0)], "x double, v double")
    assert [tuple(r) for r in binning.binned(df, "x", [0, 1, 2, 3], ["v"]).orderBy("bin").collect()] == [(0, 1, 2.0), (1, 0, 0.0), (2, 1, 4.0)]
