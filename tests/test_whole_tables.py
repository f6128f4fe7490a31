"""Queries that take in whole tables, against brute force on the smallest ones."""

import numpy as np
import pandas as pd

from strandmap import plans, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


def read(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def run(spark, name):
    return registry.QUERIES[name](spark, SF).toPandas()


def seconds(s):
    return s.astype("datetime64[us]").astype("int64").to_numpy() / 1e6


def all_ranges():
    o = read("orders")
    a = seconds(o.o_orderdate) % 2592000 + 1704067200
    k = o.o_orderkey.to_numpy()
    return k, a, a + 600 * (1 + k % 5)


def all_events():
    e = read("events")
    return e.assign(t=seconds(e.ts), c=np.floor(e.value.to_numpy() * 100 + 0.5)).sort_values("t", kind="stable")


def test_all_ranges_meet_all_events(spark):
    e = all_events()
    t, c, who = e.t.to_numpy(), e.c.to_numpy(), e.event_id.to_numpy()
    sums, ends = {}, {}
    for k, a, b in zip(*all_ranges(), strict=True):
        at = (t >= a) & (t < b)
        if at.any():
            sums[k] = (at.sum(), c[at].sum())
        at &= t > a
        if at.any():
            ends[k] = (who[at].min(), who[at].max())
    assert {r.range_id: (r.n, r.c) for r in run(spark, "interval_join").itertuples()} == sums
    assert {r.range_id: (r.first, r.last) for r in run(spark, "excise_ranges").itertuples()} == ends
    assert any(k % 10 for k in sums) and any(k % 10 for k in ends)


def test_all_ranges_overlap(spark):
    k, a, b = all_ranges()
    p, r = np.nonzero((b[None] > a[:, None]) & (a[None] <= b[:, None]) & (k[None] != k[:, None]))
    want = pd.DataFrame({"p": k[p], "r": k[r]}).groupby("p").r.agg(["count", "min", "max"])
    got = run(spark, "overlapping_ranges").set_index("p").loc[want.index]
    assert len(want) == registry.QUERIES["overlapping_ranges"](spark, SF).count()
    assert (got[["n", "first", "last"]].to_numpy() == want.to_numpy()).all()


def test_all_rules_mask(spark):
    li, p = read("lineitem"), read("part")
    channels = set(zip(li.l_suppkey % 12 + 1, li.l_linenumber, li.l_partkey % 5 + 1, strict=True))
    rules = set(zip(p.p_size % 13, p.p_partkey % 8, p.p_partkey % 6, strict=True)) - {(0, 0, 0)}
    want = {c for c in channels if any(all(x in (0, y) for x, y in zip(r, c, strict=True)) for r in rules)}
    got = run(spark, "wildcard_mask")
    assert set(got.itertuples(index=False, name=None)) == want and len(got) == len(want)


def test_all_events_tell_the_scan_kind(spark):
    e = all_events()
    e = e.assign(az=np.fmod(e.c, 7), el=e.event_id % 3)
    g = e.groupby("user_id")[["az", "el"]].agg(lambda x: x.max() - x.min())
    want = {u: "stationary" if r.az < 2 and r.el < 2 else "ces" if r.el < 2 else "cas" if r.az < 2 else "raster" for u, r in g.iterrows()}
    got = run(spark, "scan_kinds")
    assert dict(zip(got.user_id, got["mode"], strict=True)) == want


def test_all_channels_are_correlated(spark):
    x = np.stack(read("embeddings").embedding).astype(np.float64) * 1000
    x = np.sign(x) * np.floor(np.abs(x) + 0.5)
    n, k = x.shape
    want = np.corrcoef(x.T)
    off = ~np.eye(k, dtype=bool)
    got = run(spark, "channel_correlation")
    assert len(got) == k * (k - 1) // 2 and (got.n == n).all()
    assert np.allclose(got.v, want[got.i, got.j], atol=1e-6)
    got = run(spark, "correlation_blocks")
    assert set(zip(got.bi, got.bj, strict=True)) == {(i // 4, j // 4) for i in range(k) for j in range(i + 1, k)}
    for r in got.itertuples():
        v = [want[i, j] for i in range(k) for j in range(i + 1, k) if (i // 4, j // 4) == (r.bi, r.bj)]
        assert r.n == len(v) and abs(r.mean - sum(v) * (500 / len(v)) ** 0.5) < 1e-3
        assert abs(r.chi2 - (500 * np.square(v).sum() - len(v)) / (2 * len(v)) ** 0.5) < 1e-3
    got = run(spark, "correlation_extremes").set_index("i").sort_index()
    v = np.where(off, want, 0)
    assert list(got.index) == list(range(k))
    assert np.allclose(got["mean"], v.sum(1) / (k - 1), atol=2e-5) and np.allclose(got.largest, np.abs(v).max(1), atol=2e-5)
    assert np.allclose(got.mean_size, np.abs(v).sum(1) / (k - 1), atol=2e-5)
