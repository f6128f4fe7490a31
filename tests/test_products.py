import struct
import sys
import types
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmap.functions import angles
from strandmap.operators import kernels, matrices, timeseries
from strandmap.sources import hdf, images, records


def test_images_by_slices(spark, tmp_path):
    a = np.arange(60.0).reshape(3, 4, 5)  # the file's axes are 5, 4, 3
    a[1, 2, 3] = np.nan
    path = str(tmp_path / "a.fits")
    images.write_image(a, path)
    got = images.read_image(spark, path).collect()
    assert len(got) == 60 and all(r["value"] == a[r["i3"] - 1, r["i2"] - 1, r["i1"] - 1] or (r["i1"], r["i2"], r["i3"]) == (4, 3, 2) for r in got)
    some = images.read_image(spark, path, "::2,2:3,3").collect()
    assert sorted((r["i1"], r["i2"], r["i3"]) for r in some) == [(i, j, 3) for i in (1, 3, 5) for j in (2, 3)]
    for wrong in ("0:3", "1:6", ":,:,:,:"):
        with pytest.raises(ValueError):
            images.ranges(wrong, [5, 4, 3])
    assert [len(r) for r in images.ranges("3:2", [5, 4])] == [0, 4]


def test_scaled_whole_numbers(spark, tmp_path):
    cards = ["SIMPLE  =                    T", "BITPIX  =                   16 / kind", "NAXIS   =                    1", "NAXIS1  =                    3", "BSCALE  =                  0.5", "BZERO   =                 10.0", "END"]
    (tmp_path / "b.fits").write_bytes("".join(c.ljust(80) for c in cards).encode().ljust(2880) + struct.pack(">3h", -2, 0, 4).ljust(2880, b"\0"))
    assert [(r["i1"], r["value"]) for r in images.read_image(spark, f"file://{tmp_path}/b.fits").orderBy("i1").collect()] == [(1, 9.0), (2, 10.0), (3, 12.0)]


def test_maps_as_png(spark):
    m = spark.createDataFrame([(0, 0, 0.0), (1, 0, 1.0), (1, 1, 2.0)], "x int, y int, v double")
    g = images.grid(m, "x", "y", "v", 2, 2)
    data = images.png(g)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (2, 2)
    n = struct.unpack(">I", data[33:37])[0]
    assert zlib.decompress(data[41 : 41 + n]) == bytes([0, 0, 0, 255, 255, 0, 0, 255, 128, 255])  # the top row first; grey and alpha
    with pytest.raises(ValueError):
        images.grid(m, "x", "y", "v", 1, 2)
    with pytest.raises(ValueError):
        images.grid(m.union(m), "x", "y", "v", 2, 2)
    assert images.png(np.full((1, 1), np.nan))


def test_records_of_a_folder_and_a_pattern(spark, tmp_path):
    for k in range(3):
        np.arange(k, k + 2).astype("<i4").tofile(tmp_path / f"r{k}.bin")
    assert sorted(r["n"] for r in records.read(spark, str(tmp_path), "n i4").collect()) == [0, 1, 1, 2, 2, 3]
    assert sorted(r["n"] for r in records.read(spark, f"{tmp_path}/r[12].bin", "n i4").collect()) == [1, 2, 2, 3]
    assert records.read(spark, f"{tmp_path}/none*", "n i4").count() == 0


class Store(dict):
    """A file of datasets, as the library shows it."""

    files: dict = {}

    def __new__(cls, path, mode):
        return cls.files.setdefault(path, super().__new__(cls))

    def __init__(self, path, mode):
        pass

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


def test_hyperslabs(monkeypatch):
    with pytest.raises(ModuleNotFoundError, match="h5py"):
        monkeypatch.setitem(sys.modules, "h5py", None)
        hdf.shape("f", "tod")
    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=Store))
    a = np.arange(24).reshape(4, 3, 2)
    hdf.write("f", "tod", a)
    hdf.write("f", "one", np.array(5.0))
    assert hdf.shape("f", "tod") == (4, 3, 2) and hdf.shape("f", "none") is None
    monkeypatch.setattr(hdf, "VALUES", 6)

    def values(options):
        source = hdf.SlabSource({"path": "f", **options})
        reader = source.reader(None)
        return source.schema(), [tuple(c[k].as_py() for c in b.columns) for p in reader.partitions() for b in reader.read(p) for k in range(b.num_rows)]

    assert values({"dataset": "tod"}) == ("i0 long, i1 long, i2 long, value double", [(i, j, k, a[i, j, k]) for i in range(4) for j in range(3) for k in range(2)])
    assert values({"dataset": "tod", "start": "1,0,1", "count": "2,2,1"})[1] == [(i, j, 1, a[i, j, 1]) for i in (1, 2) for j in (0, 1)]
    assert values({"dataset": "one"}) == ("value double", [(5.0,)])
    for wrong in ({"dataset": "none"}, {"dataset": "tod", "start": "3,0,0", "count": "2,1,1"}, {"dataset": "tod", "start": "0"}):
        with pytest.raises(ValueError):
            values(wrong)


def test_products_by_blocks(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(7, 9)) * (rng.random((7, 9)) < 0.4), rng.normal(size=(9, 5)) * (rng.random((9, 5)) < 0.4)
    rows = lambda m, o: spark.createDataFrame([(i - o, j - o, float(m[i, j])) for i, j in np.argwhere(m).tolist()], "i int, j int, v double")
    got = matrices.multiply(rows(a, 3), rows(b, 3), 4)  # blocks end within the matrices; places from -3
    held = (a != 0).astype(int) @ (b != 0).astype(int)
    assert got.schema["i"].dataType.simpleString() == "int"
    assert {(r["i"] + 3, r["j"] + 3) for r in got.collect()} == set(map(tuple, np.argwhere(held).tolist()))
    assert all(abs(r["v"] - (a @ b)[r["i"] + 3, r["j"] + 3]) < 1e-12 for r in got.collect())
    assert matrices.multiply(rows(a, 0).filter("false"), rows(b, 0)).count() == 0


def test_spikes_fold_over_batches_and_channels(spark):
    rng = np.random.default_rng(2)
    rows = [(k, t, None if t == 40 else float(rng.normal() * 3)) for k in ("a", None, "b") for t in range(200)]
    df = spark.createDataFrame(rows, "k string, t int, v double")

    def brute(x, keep=0.7, limit=5.0, rest=10):
        s, last, wait, out = 0.0, None, 0, []
        for t, v in enumerate(x):
            if last is None or wait > 0:
                s = 0.0
            else:
                s = None if v is None or s is None else keep * s + v - last
            last, wait = v, max(0, wait - 1)
            if s is not None and abs(s) > limit:
                out.append(t)
                s, wait = 0.0, rest
        return out

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        got = timeseries.spikes(df, ["k"], "t", "v").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for k in ("a", None, "b"):
        assert sorted(r["t"] for r in got if r["k"] == k) == brute([v for q, _, v in rows if q == k])
    assert timeseries.spikes(df.filter("false"), ["k"], "t", "v").count() == 0


def test_a_gap_costs_one_entry(spark):
    rows = [(1, t, c, None if (t, c) == (3, 0) or c == 2 else float(t + 10 * c)) for t in range(6) for c in range(3)]
    df = spark.createDataFrame(rows, "feed int, t int, c int, v double")
    seen = kernels.per_feed(df, ["feed"], "t", "c", "v", lambda m: m + m[:, :1]).collect()  # the gap is seen as 3
    assert sorted((r["t"], r["c"], r["v"]) for r in seen) == sorted((t, c, 2.0 * t + 10 * c) for t in range(6) for c in range(2) if (t, c) != (3, 0))


def test_mounts_tilt_and_collimation(spark):
    one = spark.range(1)
    at = lambda az, el, dk, **m: one.select(*angles.mounted(F.lit(az), F.lit(el), F.lit(dk), **m)).head()
    assert np.allclose(at(1.0, 0.5, 0.2), (1.0, 0.5))
    low, high = at(0.0, 0.5, 0.0, tilt=0.01), at(np.pi, 0.5, 0.0, tilt=0.01)
    assert np.isclose(low[1], 0.49) and np.isclose(high[1], 0.51)  # about the axis at right angles to the tilt
    assert np.isclose(at(0.4, 0.5, 0.0, col=0.01, col_at=0.0)[1], 0.49) or np.isclose(at(0.4, 0.5, 0.0, col=0.01, col_at=0.0)[1], 0.51)
    first, turned = at(0.4, 0.5, 0.0, col=0.01), at(0.4, 0.5, np.pi, col=0.01)
    assert np.isclose(first[1] + turned[1], 1.0)  # half a turn of the deck takes it to the other side
    side = at(0.4, 0.5, 0.0, el_tilt=0.01)
    assert abs(side[1] - 0.5) < 1e-4 and 0.004 < abs(side[0] - 0.4) < 0.02
    with pytest.raises(ValueError):
        at(0.0, 0.0, 0.0, sag=1.0)
