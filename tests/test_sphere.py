import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmap.functions import pixels
from strandmap.operators import harmonics, painting


def sphere(spark, nside):
    p = spark.range(pixels.count(nside)).withColumnRenamed("id", "pix")
    theta, phi = pixels.nested_angles(nside, F.col("pix"))
    return p.withColumn("theta", theta).withColumn("phi", phi)


@pytest.mark.parametrize("nside", [1, 2, 8])
def test_pixels_round_trip(spark, nside):
    p = sphere(spark, nside).withColumn("again", pixels.to_nested(nside, F.col("theta"), F.col("phi"))).withColumn("ring", pixels.nested_to_ring(nside, F.col("pix")))
    rows = p.collect()
    assert all(r["pix"] == r["again"] for r in rows)
    by_ring = sorted(rows, key=lambda r: r["ring"])
    assert [r["ring"] for r in by_ring] == list(range(12 * nside**2))
    order = [(round(r["theta"], 9), r["phi"]) for r in by_ring]
    assert order == sorted(order)
    z = np.cos([r["theta"] for r in rows])
    assert z.mean() == pytest.approx(0, abs=1e-12) and (z * z).mean() == pytest.approx(1 / 3, abs=0.03 if nside > 1 else 0.2)


def test_pixels_of_random_points(spark):
    r = np.random.default_rng(0)
    pts = [(float(np.arccos(z)), float(f)) for z, f in zip(r.uniform(-1, 1, 3000), r.uniform(0, 2 * np.pi, 3000), strict=True)]
    df = spark.createDataFrame(pts, "theta double, phi double")
    fine, coarse = pixels.to_nested(16, F.col("theta"), F.col("phi")), pixels.to_nested(4, F.col("theta"), F.col("phi"))
    df = df.withColumn("f", fine).withColumn("c", coarse)
    assert df.filter(pixels.parent(F.col("f"), 2) != F.col("c")).count() == 0
    t, p = pixels.nested_angles(16, F.col("f"))
    near = df.withColumn("t", t).withColumn("p", p).collect()
    d = [math.acos(min(1, math.cos(x["theta"]) * math.cos(x["t"]) + math.sin(x["theta"]) * math.sin(x["t"]) * math.cos(x["phi"] - x["p"]))) for x in near]
    assert max(d) < 0.09


def test_harmonics(spark):
    nside = 8
    area = 4 * math.pi / pixels.count(nside)
    m = sphere(spark, nside).withColumn("v", 2 + 3 * F.cos("theta") + F.sin("theta") * F.cos("phi")).cache()
    alm = harmonics.refined(m, "theta", "phi", "v", area, 6).cache()
    a = {(r["l"], r["m"]): complex(r["re"], r["im"]) for r in alm.collect()}
    assert a[0, 0] == pytest.approx(2 * math.sqrt(4 * math.pi), rel=1e-6)
    assert a[1, 0] == pytest.approx(3 * math.sqrt(4 * math.pi / 3), rel=1e-2)
    assert a[1, 1] == pytest.approx(-math.sqrt(2 * math.pi / 3), rel=1e-2)
    back = harmonics.synthesise(m, "theta", "phi", alm, "w")
    assert back.agg(F.max(F.abs(F.col("v") - F.col("w")))).head()[0] < 2e-3
    dipole = harmonics.synthesise(m, "theta", "phi", harmonics.degree_range(alm, 1, 1), "w")
    assert dipole.agg(F.max(F.abs(F.col("v") - 2 - F.col("w")))).head()[0] < 0.01
    c = {r["l"]: r["c"] for r in harmonics.spectrum(alm).collect()}
    s = {r["l"]: r["c"] for r in harmonics.spectrum(harmonics.windowed(alm, harmonics.beam(1.0, 6))).collect()}
    assert s[1] / c[1] == pytest.approx(harmonics.beam(1.0, 6)[1] ** 2)
    j = {(r["l"], r["m"]): r["re"] for r in harmonics.merged(alm, alm, 1, 4).collect()}
    assert j[1, 0] == pytest.approx(a[1, 0].real) and j[2, 0] == pytest.approx(a[2, 0].real)
    t = harmonics.smooth_transfer(spark.range(200).select(F.col("id").cast("int").alias("l"), F.lit(0.5).alias("ratio")))
    got = {r["l"]: r["ratio"] for r in t.collect()}
    assert got[0] == got[1] == 1 and got[100] == pytest.approx(0.5) and got[150] == pytest.approx(0.5)


def test_painting(spark):
    m = sphere(spark, 8).withColumn("lon", F.col("phi")).withColumn("lat", math.pi / 2 - F.col("theta")).withColumn("v", F.lit(0.0)).cache()
    n = m.count()
    inside = m.filter(painting.disc(F.col("lon"), F.col("lat"), 1.0, 0.2, 0.5)).count()
    assert inside / n == pytest.approx((1 - math.cos(0.5)) / 2, rel=0.15)
    assert painting.paint(m, "v", painting.strip(F.col("lat"), -0.2, 0.2), 3, "add").agg(F.max("v"), F.min("v")).head() == (3, 0)
    assert m.filter(painting.box(F.col("lon"), F.col("lat"), 1.0, 0.0, 1.0, 1.0)).count() / n == pytest.approx(1 / (4 * math.pi), rel=0.2)
    s = spark.createDataFrame([(1.0, 0.1, 5.0), (4.0, -0.5, 2.0)], "slon double, slat double, flux double")
    total = painting.source_map(m, s, "pix", 0.4, 0.3).agg(F.sum("v")).head()[0]
    assert total == pytest.approx(7.0)
    c = s.select("slon", "slat", F.lit(0.2).alias("r500"), F.lit(1.0).alias("amplitude"))
    assert painting.add_clusters(m, c, "pix", 0.6, 0.3, (1.0, 1.0, 0.3, 1.05, 5.5)).filter("v <= 0").count() == 0
    q = painting.calmest_patch(m.withColumn("v", F.col("lon") * (F.col("lat") + 2)).withColumn("ok", F.lit(1.0)), s.select("slon", "slat"), "v", "ok", 0.4, 0.3).collect()
    assert [r["slon"] for r in q] == [4.0, 1.0] or q[0]["rms"] <= q[1]["rms"]
    a = painting.angle_moments(m.select("pix", F.lit(0.3).alias("psi")), "pix", "psi", 2).filter("s = 2").head()
    assert a["cos"] == pytest.approx(math.cos(0.6))
    masked = painting.sun_mask(m.withColumn("v", F.when(F.col("pix") == 0, 100.0).otherwise(0.0)), "pix", "v", 1, 40.0)
    assert sorted(r["pix"] for r in masked.collect()) == [0, 1, 2, 3]
