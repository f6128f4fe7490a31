import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmap.operators import harmonics, kernels as k, seasons
from strandmap.sources import records


def test_gaps():
    x = k.one_over_f(800, 10.0, 1.0, 0.5, -1.8, 4)
    ok = np.ones(800, bool)
    ok[300:340] = False
    cov = k.autocovariance(800, 10.0, 1.0, 0.5, -1.8)
    y = k.constrained_realisation(np.where(ok, x, 0), ok, cov)
    assert (y[ok] == x[ok]).all() and np.std(y[~ok] - x[~ok]) < np.std(x)
    draw = k.constrained_realisation(np.where(ok, x, 0), ok, cov, 1)
    assert np.std(np.diff(draw[~ok])) == pytest.approx(np.std(np.diff(x)), rel=0.5)
    p, _ = k.fit_noise_with_gaps(x, ok, 10.0, 4, 1)
    assert p[0] == pytest.approx(1.0, rel=0.2)


def test_sky_kernels():
    c = np.zeros(3)
    c[0] = 4 * np.pi
    assert k.angular_correlation(c, np.array([0.3, 1.0])) == pytest.approx([1, 1])
    assert k.wigner_square(1, 1, 0) == pytest.approx(1 / 3) and k.wigner_square(1, 1, 1) == 0 and k.wigner_square(2, 1, 1) == pytest.approx(2 / 15)
    w = np.zeros(9)
    w[0] = 4 * np.pi  # the spectrum of a mask of ones
    assert k.sky_coupling(w, 4) == pytest.approx(np.eye(5))


def test_likeliest_powers():
    r = np.random.default_rng(0)
    parts = [np.diag([1.0] * 300 + [0.0] * 300), np.diag([0.0] * 300 + [1.0] * 300)]
    data = r.normal(size=600) * np.sqrt([5.0] * 300 + [3.0] * 300)
    p, s = k.likeliest_powers(data, np.eye(600), parts, np.ones(2))
    assert p == pytest.approx([np.mean(data[:300] ** 2) - 1, np.mean(data[300:] ** 2) - 1], rel=1e-4) and (s > 0).all()


def test_small_kernels():
    m = np.random.default_rng(1).normal(size=(8, 9))
    got = k.top_hat(m, 1, 2)
    pad = np.pad(m, ((1, 1), (2, 2)))
    assert got[3, 4] == pytest.approx(pad[3:6, 4:9].mean()) and got[0, 0] == pytest.approx(pad[0:3, 0:5].mean())
    t = np.arange(500) / 50
    assert k.is_lissajous(t, np.sin(2.1 * t), np.cos(3.3 * t + 1)) and not k.is_lissajous(t, t, np.cos(3 * t)) and not k.is_lissajous(t, np.sin(2 * t), np.zeros(500))
    x, y = np.meshgrid(np.linspace(-1, 3, 20), np.linspace(0, 4, 20))
    a, b, cov = k.contour_ellipse(x.ravel(), y.ravel(), (((x - 1) / 0.5) ** 2 + ((y - 2) / 0.2) ** 2).ravel())
    assert (a, b) == pytest.approx((1, 2)) and cov == pytest.approx(np.diag([0.25, 0.04]), abs=1e-6)


def test_pixel_covariance(spark):
    pix = [0, 1, 1, 2, 0]
    s = spark.createDataFrame([(1, i, p) for i, p in enumerate(pix)], "scan int, n int, p int")
    kern = [2.0, 0.5]
    want = np.zeros((3, 3))
    for a, p in enumerate(pix):
        for b, q in enumerate(pix):
            if abs(a - b) < 2:
                want[p, q] += kern[abs(a - b)]
    got = {(r["i"], r["j"]): r["v"] for r in seasons.pixel_covariance(s, ["scan"], "n", "p", kern).collect()}
    assert all(got.get((i, j), 0) == want[i, j] for i in range(3) for j in range(3))


def test_modes_and_moments(spark):
    r = np.random.default_rng(2)
    a = r.normal(size=256)
    rows = [(1, d, i, float(v)) for d, x in ((1, a), (2, a * 2), (3, r.normal(size=256))) for i, v in enumerate(x)]
    modes = seasons.fourier(spark.createDataFrame(rows, "scan int, det int, i int, v double"), ["scan", "det"], "i", "v", 10.0)
    c = {(x["d1"], x["d2"], x["bin"]): x["corr"] for x in seasons.mode_correlation(modes, ["scan"], "det", 0.01, 1).collect()}
    assert c[1, 2, 8] == pytest.approx(1) and abs(c[1, 3, 8]) < 0.4
    m = seasons.ratio_moments(spark.createDataFrame([(1, 1.0, 1.0), (1, 3.0, 3.0)], "k int, c double, w double"), ["k"], "c", "w").head()
    assert (m["mean"], m["dev"], m["sigma"]) == pytest.approx((2.5, math.sqrt(0.75), 0.5))
    g = spark.createDataFrame([(1, 2, 0.5, 2.0, 3.0, 1.0, 2.0), (1, 2, 0.5, None, 3.0, 1.0, 2.0)], "a int, b int, icorr double, gain1 double, gain2 double, sigma1 double, sigma2 double")
    assert tuple(seasons.gain_sums(g, ["a", "b"]).head())[2:] == (1.5, 1)
    d = spark.createDataFrame([(1, 0.5, 2.0, 2.0), (1, 1.0, 1.0, 1.0)], "k int, corr double, noise1 double, noise2 double")
    assert tuple(seasons.detector_correlation(d, ["k"]).head()) == (1, 1.5, 2.5, 0.75, 2)


def test_models(spark):
    data = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i int, value double")
    curves = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 1.5), ("b", 0, 0.0), ("b", 1, 2.0)], "curve string, i int, model double")
    w = spark.createDataFrame([(0, 0, 2.0), (1, 1, 4.0), (0, 1, 0.5), (1, 0, 0.5)], "i int, j int, w double")
    assert [tuple(r) for r in seasons.best_curve(data, curves, w).collect()] == [("a", 1.0), ("b", 2.0)]
    t = spark.createDataFrame([(i, j, float(i + j)) for i in range(4) for j in range(4)], "i int, j int, v double")
    left, amp = seasons.template_free(t.withColumn("v", 3 * F.col("v")), [t])
    assert amp == pytest.approx([3]) and left.agg(F.max(F.abs("v"))).head()[0] < 1e-9


def test_sky_regions(spark):
    m = spark.createDataFrame([(i, 0.1 * i, 0.0, v) for i, v in enumerate([1.0, 9.0, 8.0, 2.0, 0.1, 7.0, 3.0])], "pix int, lon double, lat double, v double")
    got = [r["region"] for r in seasons.seed_regions(m, "pix", "v", 1.0, 0.25, 5).orderBy("pix").collect()]
    assert got[:3] == [2, 2, 2] and got[4:] == [1, 3, 3]  # the fourth lies halfway
    near, block = seasons.mini_maps(m, spark.createDataFrame([(0.1, 0.0)], "slon double, slat double"), spark.createDataFrame([(0, 1, 5.0), (0, 6, 5.0)], "i int, j int, v double"), 0.15, 0.1)
    assert near.count() == 3 and [tuple(r)[2:] for r in block.collect()] == [(0, 1, 5.0)]
    a = spark.range(1).select(seasons.transport_angle(F.lit(0.0), F.lit(0.0), F.lit(0.5), F.lit(0.0)).alias("a")).head()[0]
    assert a == pytest.approx(0)


def test_sweeps(spark):
    az = [0, 1, 2, 3, 2, 1, 0]
    df = spark.createDataFrame([(1, i, float(a), 2.0 * a + 5) for i, a in enumerate(az)], "k int, i int, az double, v double")
    out = seasons.sweep_slopes_removed(df, ["k"], "i", "az", "v").orderBy("i").collect()
    assert [r["sweep"] for r in out] == [1, 1, 1, 1, 2, 2, 2]
    assert {round(r["v"], 9) for r in out if r["sweep"] == 1} == {8.0} and {round(r["v"], 9) for r in out if r["sweep"] == 2} == {7.0}
    w = seasons.weather_template(df, ["k"], "i", "v", 1.0, 0.2)
    assert w.count() == 7


def test_feed_pairs_and_realisations(spark):
    r = np.random.default_rng(3)
    cube = r.normal(size=(4, 4, 4))
    rows = [(f, x, y, z, float(s * cube[x, y, z])) for f, s in ((1, 1), (2, 2), (3, -1)) for x in range(4) for y in range(4) for z in range(4)]
    got = seasons.feed_pair_spectra(spark.createDataFrame(rows, "feed int, x int, y int, z int, v double"), "feed", [0.5, 6.0], (1.0, 1.0, 1.0)).collect()
    p = {(x["i"], x["j"]): x["power"] for x in got}
    assert p[1, 2] == pytest.approx(-2 * p[1, 3]) and p[2, 3] == pytest.approx(2 * p[1, 3])
    alm = harmonics.random_coefficients(spark, np.array([0, 0, 4.0] + [0] * 40 + [2.0]), 5)
    c = {r["l"]: r["c"] for r in harmonics.spectrum(alm).collect()}
    assert c[1] == 0 and c[43] == pytest.approx(2.0, rel=0.7) and c[2] > 0


def test_record_source(spark, tmp_path):
    rows = np.zeros(1000, [("t", "<f8"), ("n", "<i4"), ("az", "<f4")])
    rows["t"], rows["n"], rows["az"] = np.arange(1000) / 10, np.arange(1000), 0.5
    for k_ in (1, 2):
        (tmp_path / f"f{k_}.bin").write_bytes(b"HEAD" + rows.tobytes())
    df = records.read(spark, str(tmp_path / "*.bin"), "t f8, n i4, az f4", 4)
    assert df.dtypes == [("t", "double"), ("n", "int"), ("az", "float")]
    assert tuple(df.agg(F.count("*"), F.sum("n"), F.max("t")).head()) == (2000, 999000, 99.9)
    with pytest.raises(ValueError):
        records.parse_fields("a x9")
