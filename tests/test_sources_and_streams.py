import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandmap.plans import reduction
from strandmap.sources import catalogs, params, products
from strandmap.streaming import live


def put(tmp_path, name, content):
    p = tmp_path / name
    p.write_text(content)
    return str(p)


def test_parameters(spark, tmp_path):
    t = params.read(spark, put(tmp_path, "p.txt", "# head\nNSIDE = 256\nNAME = 'a b' # why\nRATE = 1.5d2\nflag = .true.\nNSIDE = 1\n"))
    p = params.Parameters(t, {"extra": 3}, ["--NAME=c"])
    assert (p.integer("nside"), p.text("name"), p.number("rate"), p.flag("FLAG"), p.integer("extra"), p.integer("none", 7)) == (256, "c", 150.0, True, 3, 7)
    with pytest.raises(KeyError):
        p.text("missing")


RUNS = "1\nfield2 2\n101 55000.0 55000.2 3 /l1/a.h5\n1 55000.00 55000.05 8192 10 50 0\n2 55000.05 55000.15 32 11 51 1\n3 55000.15 55000.2 8192 12 52 2\n102 55001.0 55001.1 1 /l1/b.h5\n1 55001.0 55001.1 512 13 53 3\n"


def test_run_list_round_trip(spark, tmp_path):
    runs = catalogs.run_list(spark, put(tmp_path, "r.txt", RUNS))
    assert [(r["object"], r["scan_id"], r["sub_id"], r["mode"], r["file"]) for r in runs.orderBy("scan_id", "sub_id").collect()] == [
        ("field2", 101, 1, "tsys", "/l1/a.h5"), ("field2", 101, 2, "ces", "/l1/a.h5"), ("field2", 101, 3, "tsys", "/l1/a.h5"), ("field2", 102, 1, "raster", "/l1/b.h5"),
    ]
    assert [r["sub_id"] for r in catalogs.science_subscans(runs).collect()] == [2]
    catalogs.write_run_list(runs, str(tmp_path / "out"))
    again = catalogs.run_list(spark, str(tmp_path / "out/object=field2"))
    assert sorted(map(tuple, again.drop("file").collect())) == sorted(map(tuple, runs.drop("file").collect()))


def test_small_catalogs(spark, tmp_path):
    d = catalogs.detectors(spark, put(tmp_path, "d.txt", "# id ...\n1 1 1 0.1 0.2 0.3 4.5 30 1\n2 1 2 0.1 0.2 0.3 4.5 30 0\n"))
    assert [r["id"] for r in catalogs.alive(d).collect()] == [1]
    p = catalogs.patches(spark, put(tmp_path, "c.txt", "co2 10 20 1 2 0.1 3 cmb\nmoon x x 1 2 0.1 5 planet\n"))
    assert {r["name"]: r["fixed"] for r in p.collect()} == {"co2": True, "moon": False}
    m = catalogs.frequency_rules(spark, put(tmp_path, "m.txt", "1024\n5 1 2\n0 3 0\n"))
    assert sorted(map(tuple, m.collect())) == [(0, 3, 0), (5, 1, 2)]
    s = catalogs.split_definitions(spark, put(tmp_path, "s.txt", "accept 0\nelev 2\ntime 3\n"))
    assert sorted(map(tuple, s.collect())) == [(1, "accept", 0), (2, "elev", 2), (3, "time", 3)]
    a = catalogs.rejected_channels(spark, put(tmp_path, "a.txt", "2\n101 1\n1 2\n1 2\n5 6\n2 0\n102 1\n3 1\n4 1\n9\n"))
    assert sorted(map(tuple, a.collect())) == [(101, 1, 1, 5), (101, 1, 1, 6), (102, 3, 4, 9)]
    ch = spark.createDataFrame([(101, 1, 1, 5), (101, 1, 1, 7)], "scan int, det int, sb int, freq int")
    assert [r["freq"] for r in catalogs.accepted(ch, a).collect()] == [7]


def test_products(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 1.5), (2, 1, 2.5)], "scan_id int, i int, value double")
    products.write_streams(df, str(tmp_path / "s"))
    plan = products.read_streams(spark, str(tmp_path / "s")).filter("scan_id = 1").select("i")
    assert [tuple(r) for r in plan.collect()] == [(0,)]
    assert products.concatenated([df, df.drop("i")]).filter("i IS NULL").count() == 2
    products.write_map({"coadd": df, "feed": df.limit(1)}, str(tmp_path / "m"))
    assert products.read_map(spark, str(tmp_path / "m"), "coadd").count() == 2
    sparse = spark.createDataFrame([(1, 4.0)], "pix long, v double")
    assert products.sparse(products.dense(sparse, "pix", "v", 3), "pix", "v").collect()[0]["v"] == 4.0
    assert catalogs.time_ranges(spark, str(tmp_path / "s"), "i").count() == 2
    assert catalogs.new_files(spark, str(tmp_path / "s")).filter("path LIKE '%.parquet'").count() >= 2


def replay(spark, tmp_path, rows, schema):
    for part in np.array_split(np.arange(len(rows)), 3):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(stream, name, mode, spark, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_match_batches(spark, tmp_path):
    t0 = pd.Timestamp("2024-01-01")
    x = np.zeros(90)
    x[40] = 30
    rows = [("a", (t0 + pd.Timedelta(seconds=int(i + (600 if i >= 60 else 0)))).to_pydatetime(), float(x[i])) for i in range(90)]
    s = replay(spark, tmp_path, rows, "k string, ts timestamp, v double")
    dec = run(live.decimated(s, ["k"], "ts", "v", "10 seconds", "1 minute"), "dec", "append", spark, tmp_path).orderBy("start").collect()
    assert dec and all(r["n"] == 10 for r in dec) and max(r["v"] for r in dec) == 3.0
    ses = run(live.sessions(s, ["k"], "ts", "60 seconds", "1 minute"), "ses", "append", spark, tmp_path).collect()
    assert [r["n"] for r in ses] == [60]  # the later session is still open
    hits = run(live.spikes(s, "k", "ts", "v"), "hits", "update", spark, tmp_path).collect()
    assert [(r["k"], r["ts"]) for r in hits] == [("a", rows[40][1])]
    m = run(live.live_map(s.withColumn("w", F.lit(2.0)), ["k"], "v", "w"), "lm", "complete", spark, tmp_path).head()
    assert (m["nhit"], m["wsum"], m["div"]) == (90, 60.0, 180.0)


def test_reduction_plan(spark):
    r = np.random.default_rng(0)
    n = 200
    gain = 1 + 0.05 * np.sin(np.arange(n) / 60)
    rows = [(1, f, 1, c, i, float(100 * gain[i] * (1 + 1e-3 * r.normal()))) for f in (1, 2) for c in range(8) for i in range(n)]
    raw = spark.createDataFrame(rows, "scan_id long, feed int, sb int, freq int, i long, value double")
    raw = raw.withColumn("value", F.when((F.col("freq") == 3) & (F.col("feed") == 1) & (F.col("i").between(5, 7)), float("nan")).when((F.col("freq") == 0) & (F.col("i") == 9), float("nan")).otherwise(F.col("value")))
    l2 = reduction.level2(raw, 50.0, 0.5, 4, 0, 0, 1, 4).cache()
    assert l2.count() == 2 * 2 * n
    assert l2.agg(F.stddev("value")).head()[0] < 1.5e-3 and abs(l2.agg(F.avg("value")).head()[0]) < 1e-4
    pointing = spark.range(n).select(F.lit(1).cast("long").alias("scan_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("feed"), F.col("id").alias("i"), (F.col("id") % 10 * 0.1).alias("ra"), (F.floor(F.col("id") / 20) * 0.1).alias("dec"))
    maps = reduction.make_maps(l2, pointing, (0.0, 0.0, 0.1, 0.1, 10, 10), {"feed": F.col("feed") - 1})
    hits = {x["level"]: x["n"] for x in maps["levels"].groupBy("level").agg(F.sum("nhit").alias("n")).collect()}
    assert hits["feed"] == hits["coadd"] == 2 * 2 * 8 * 8 * 2
    assert maps["splits"].select("half").distinct().count() == 2


def test_spectra(spark):
    rows = [("a", x, y, z, float((x + 2 * y + z) % 5)) for x in range(6) for y in range(6) for z in range(6)]
    df = spark.createDataFrame(rows, "m string, x int, y int, z int, v double")
    s = reduction.cube_spectra(df, ["m"], [0.5, 2.0, 4.0], (1.0, 1.0, 1.0))
    assert s.count() == 2
    t = reduction.transfer_function(s, s.withColumn("power", F.lit(0.0)), s, ["m", "bin"]).collect()
    assert all(r["transfer"] == pytest.approx(1.0) for r in t)
    pairs = spark.createDataFrame([(1, 2, 0, 4.0, 1.0, 0.1), (1, 1, 0, 9.0, 1.0, 0.1), (2, 1, 0, 8.0, 2.0, 9.0), (2, 3, 0, 6.0, 1.0, -1.0)], "a int, b int, k int, p double, s double, c double")
    assert reduction.mean_cross_spectrum(pairs, "k", "p", "s", "c", "a", "b").head()["p"] == 5.0
