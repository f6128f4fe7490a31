"""Queries whose results or work went wrong on odd inputs or larger tables, against their SQL on small ones."""

import time

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandmap import plans, registry  # noqa: F401
from strandmap.sources import catalogs

from .test_queries import rows


def joined(spark, run) -> int:
    """Rows that the largest join put out while run() went on."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    known = {e.executionId() for e in each(store.executionsList())}
    run()
    bus.waitUntilEmpty()
    most = 0
    for e in each(store.executionsList()):
        if e.executionId() not in known:
            values = store.executionMetrics(e.executionId())
            for node in each(store.planGraph(e.executionId()).allNodes()):
                for m in each(node.metrics()) if "Join" in node.name() else ():
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def each(seq):
    return [seq.apply(i) for i in range(seq.size())]


@pytest.fixture
def same(spark, tmp_path):
    """Asserts that a query over the tables gives the rows of its SQL."""

    def check(name, **tables):
        con = duckdb.connect()
        for t, cols in tables.items():
            pq.write_table(cols if isinstance(cols, pa.Table) else pa.table(cols), tmp_path / f"{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        got, want = registry.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
        return got

    return check


def test_scan_modes_of_high_keys(same):
    got = same("scan_modes", orders={"o_orderkey": [0, 16, 8192, 32768, 32768 + 8192, 65536, 2**33 + 32]})
    assert got["mode"].isna().sum() == 3


def test_channel_values_are_rounded_as_floats(same):
    e = pa.array([[0.0] * 3 + [x] for x in (0.0035, 0.0125, 0.0375, -0.0035, 0.1)], pa.list_(pa.float32()))
    near = pa.array([[0.0] * 3 + [float(np.float32(k + 0.5) / np.float32(1000))] for k in range(400)], pa.list_(pa.float32()))
    same("calibrate", embeddings={"vec_id": list(range(405)), "embedding": pa.concat_arrays([e, near]), "label": [0] * 5 + list(range(1, 401))})


def stream(n, seed, days, step):
    """Events and ranges of half as many orders within some days, at multiples of ``step`` microseconds; some of either bear nulls."""
    r = np.random.default_rng(seed)
    us = int(days * 86400e6)
    t = pd.Timestamp("2024-01-01") + pd.to_timedelta(r.integers(0, us, n) // step * step, "us")
    o = pd.Timestamp("2019-12-10") + pd.to_timedelta(r.integers(0, us, n // 2) // step * step, "us")  # a whole number of months of 30 days
    ids = np.arange(n // 2) * 3
    ids[-5:] = ids[:5]  # keys that come twice
    events = pd.DataFrame({"event_id": r.permutation(n), "ts": t, "user_id": 1, "event_type": "view", "value": np.round(r.uniform(0, 400, n), 2)})
    orders = pd.DataFrame({"o_orderkey": ids, "o_orderdate": o})
    events.loc[::50, "ts"], events.loc[::7, "value"], orders.loc[::40, "o_orderdate"] = pd.NaT, None, pd.NaT
    return {k: pa.Table.from_pandas(v.astype({c: "datetime64[us]" for c in v if v[c].dtype.kind == "M"}), preserve_index=False) for k, v in (("events", events), ("orders", orders))}


RANGES = ["interval_join", "excise_ranges", "housekeeping_slice", "overlapping_ranges"]


@pytest.mark.parametrize("name", RANGES)
def test_ranges_with_ties(same, name):
    assert len(same(name, **stream(1500, 1, 3, 60_000_000)))


@pytest.mark.parametrize("name", RANGES)
def test_ranges_of_a_dense_stream_are_not_paired(spark, same, name):
    tables = stream(6000, 2, 0.1, 1)
    assert joined(spark, lambda: same(name, **tables)) < 100_000  # of 3.2 million pairs


def test_overlaps_of_ranges_that_run_backwards(same):
    tables = stream(400, 3, 0.2, 60_000_000)
    o = tables["orders"].to_pandas().assign(o_orderkey=lambda d: -d.o_orderkey.where(d.index % 2 == 0, -d.o_orderkey))  # a negative key may end before its start
    assert len(same("overlapping_ranges", orders=pa.Table.from_pandas(o.astype({"o_orderdate": "datetime64[us]"}), preserve_index=False)))


def test_long_run_lists_are_walked_once(spark, tmp_path):
    """The time a line takes doesn't grow with the list; each scan has a number of sub-scans of its own."""
    n = 20_000
    scans = "".join(f"{k} {k}.0 {k}.5 {k % 3} /a.h5\n" + "".join(f"{s} {k}.{s} {k}.{s + 1} 32 10.0 50.0 0.0\n" for s in range(k % 3)) for k in range(n))
    (tmp_path / "runs.txt").write_text(f"2\nfirst {n}\n{scans}\nsecond 1\r\n7 1.0 2.0 1 /b.h5\r\n1 1.0 2.0 16 1 2 3\n")
    began = time.time()
    got = catalogs.run_list(spark, str(tmp_path / "runs.txt")).toPandas()
    assert time.time() - began < 20
    assert list(zip(got.object, got.scan_id, got.sub_id, got["mode"], strict=True)) == [("first", k, s, "ces") for k in range(n) for s in range(k % 3)] + [("second", 7, 1, "circ")]


def test_run_lists_are_written_in_order(spark, tmp_path):
    rows = [("a" if k % 3 else "b", k, k + 0.0, k + 1.0, "/a.h5", s, k + s / 8, k + s / 8 + 0.1, 32, 1.0, 2.0, 0.0) for k in range(300) for s in range(4)]
    names = "object string, scan_id long, scan_start double, scan_end double, file string, sub_id int, start double, end double, feature int, az double, el double, dk double"
    path = str(tmp_path / "out")
    catalogs.write_run_list(spark.createDataFrame(rows[::-1], names).repartition(7), path)
    for name in "ab":
        got = catalogs.run_list(spark, f"{path}/object={name}").select(*[c.split()[0] for c in names.split(", ")])
        assert [tuple(r) for r in got.collect()] == [r for r in rows if r[0] == name]
