import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmap import commands
from strandmap.operators import grids, kernels, pcg, validation
from strandmap.sources import level1


def test_commands():
    assert commands.find("map.smooth")
    with pytest.raises(KeyError, match="matrix"):
        commands.find("map.nothing")


def test_validation(spark):
    r = np.random.default_rng(0)
    rows = [(d, i, float(r.normal() * (3 if d == 2 else 1))) for d in (1, 2) for i in range(4000)]
    df = spark.createDataFrame(rows, "det int, i int, v double").withColumn("s", F.lit(1.0))
    got = {x["det"]: x for x in validation.stream_statistics(df, ["det"], "i", "v", "s", 1).collect()}
    assert abs(got[1]["chi2"]) < 5 and got[2]["chi2"] > 100 and got[2]["absmax"] > got[1]["absmax"]
    spec = kernels.spectra(df.filter("det = 1"), ["det"], "i", "v", 10.0).withColumn("model", F.lit(1.0)).cache()
    b = validation.band_chi2(spec, ["det"], "freq", "power", "model", {"low": (0.01, 1.0), "all": (0.01, 5.0)}).head()
    assert abs(b["low"]) < 5 and abs(b["all"]) < 5
    assert validation.fourier_outlier(spec, ["det"], "freq", "power").head()["high"] < 2
    assert validation.worst_harmonic(spec, ["det"], "freq", "power", "model", [1.2], 0.05).head()["spike"] > 1
    line = df.filter("det = 1").withColumn("tp", F.col("i") * 0.01).withColumn("v", F.col("v") + 2 * F.col("tp")).withColumn("sec", F.floor(F.col("i") / 10))
    assert validation.type_b(line, ["det"], "sec", "v", "tp", "s", 10.0).head()["type_b"] == pytest.approx(1, abs=0.3)


def test_cuts(spark):
    rows = [(1, float(v), 1.0) for v in [*range(20), 500]] + [(2, float(v) * 100, float("nan")) for v in range(20)]
    df = spark.createDataFrame(rows, "det int, a double, b double")
    df = validation.static_cuts(df, {"a": (0, None, 1500.0), "b": (1, 0.0, None)})
    df = validation.adaptive_cuts(df, ["det"], {"a": (2, 4.0)}).cache()
    assert [r["a"] for r in df.filter(F.getbit("status", F.lit(2)) == 1).collect()] == [500.0]
    s = {r["bit"]: (r["cut_rows"], r["left_rows"]) for r in validation.season_summary(df.withColumn("t", F.lit(1)), ["t"], "status", {0: "a", 1: "b", 2: "adaptive"}).collect()}
    assert s == {0: (4, 37), 1: (20, 21), 2: (1, 20)}
    k = spark.createDataFrame([(n, c, int(g)) for n, f in (("x", lambda c: c % 2), ("y", lambda c: c % 2), ("z", lambda c: c // 2 % 2)) for c in range(8) for g in [f(c) + 1]], "knife string, cid int, group int")
    v = {(r["i"], r["j"]): r["v"] for r in validation.knife_correlation(k, ["cid"]).collect()}
    assert v["x", "y"] == pytest.approx(1) and v["x", "z"] == pytest.approx(0, abs=1e-12)
    c = spark.createDataFrame([("a", 0.0, 1.0), ("a", 5.0, 1.0), ("b", 1.0, 1.0), ("b", 1.0, 9.0), ("c", 0.0, 0.0), ("d", 0.0, 1.0), ("d", 4.0, 7.0)], "k string, az double, el double")
    assert {r["k"]: r["mode"] for r in validation.scan_kind(c, ["k"], "az", "el", 0.1).collect()} == {"a": "ces", "b": "cas", "c": "stationary", "d": "raster"}


def test_fits(spark):
    r = np.random.default_rng(1)
    x, y = r.uniform(0, 10, 200), r.uniform(0, 10, 200)
    v = 5 * np.exp(-((x - 4) ** 2 + (y - 6) ** 2) / (2 * 1.5**2)) + 1
    df = spark.createDataFrame([(1, float(a), float(b), float(c), 1.0) for a, b, c in zip(x, y, v, strict=True)], "k int, x double, y double, v double, w double")
    g = grids.fit_gaussians(df, ["k"], "x", "y", "v", "w").head()
    assert (g["amplitude"], g["x0"], g["y0"], g["width"], g["offset"]) == pytest.approx((5, 4, 6, 1.5, 1), rel=1e-4)
    pts = spark.createDataFrame([(float(a), float(1.7 * a + 0.3 + 0.01 * r.normal())) for a in x], "x double, y double").withColumn("sx", F.lit(0.001)).withColumn("sy", F.lit(0.01)).withColumn("k", F.lit(1))
    slope, offset, _ = grids.zoomed_line(pts, "x", "y", "sx", "sy", (0.0, 3.0), (-1.0, 1.0))
    assert slope == pytest.approx(1.7, abs=0.02) and offset == pytest.approx(0.3, abs=0.05)
    assert grids.orthogonal_slope(pts, ["k"], "x", "y").head()["slope"] == pytest.approx(1.7, abs=0.01)
    t = grids.fit_template(pts.withColumn("y", 2 * F.col("x")), ["k"], "y", "x", "sy").head()
    assert t["amplitude"] == pytest.approx(2)


def test_level1(spark):
    nan = float("nan")
    rows = [(1, c, i, nan if i >= 8 or (c == 2 and i % 2) else 1.0 * i) for c in (1, 2) for i in range(10)]
    got = level1.tidied(spark.createDataFrame(rows, "scan int, c int, i int, v double"), ["scan", "c"], ["scan"], "i", "v").collect()
    assert {r["i"] for r in got} == set(range(8)) and {r["v"] for r in got if r["c"] == 2} == {0.0}
    tsys = spark.createDataFrame([(1, 2.0), (2, 99.0), (3, nan)], "c int, tsys double")
    out = level1.calibrated(spark.createDataFrame([(c, 3.0) for c in (1, 2, 3)], "c int, v double"), tsys, ["c"], "v", 50.0).collect()
    assert {r["c"]: (r["v"], r["reason"]) for r in out} == {1: (6.0, 0), 2: (None, 60), 3: (None, 70)}
    load = spark.createDataFrame([(1, 4.0, 1.0, 300.0)], "c int, hot double, cold double, t double")
    assert level1.system_temperature(load, ["c"], "hot", "cold", "t", 3.0).head()["tsys"] == pytest.approx(99.0)
    assert level1.sample_rate(spark.createDataFrame([(1, 0.1 * i) for i in range(11)], "s int, t double"), ["s"], "t").head()["rate"] == pytest.approx(10)


def test_likelihood_map(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    r = np.random.default_rng(2)
    sky = r.normal(size=12)
    rows = []
    for s in range(3):
        noise = kernels.one_over_f(256, 10.0, 0.05, 0.5, -1.5, s)
        pix = r.integers(0, 12, 256)
        rows += [(s, i, int(pix[i]), float(sky[pix[i]] + noise[i])) for i in range(256)]
    tod = spark.createDataFrame(rows, "scan int, i int, pix int, v double").withColumn("sigma0", F.lit(0.05)).withColumn("fknee", F.lit(0.5)).withColumn("alpha", F.lit(-1.5))
    m = {x["pix"]: x["m"] for x in pcg.make_map(tod, ["scan"], "i", ["pix"], "v", 10.0, 12, 1e-4).collect()}
    got = np.array([m[p] for p in range(12)])
    assert got - got.mean() == pytest.approx(sky - sky.mean(), abs=0.04)
