import numpy as np
import pytest

from strandmap.operators import kernels as k


def rng(seed=0):
    return np.random.default_rng(seed)


def test_power_spectrum_has_the_variance():
    x = rng().normal(size=4096)
    f, p = k.power_spectrum(x, 50.0)
    assert f[-1] == 25.0
    assert (p[0] + 2 * p[1:-1].sum() + p[-1]) / len(x) == pytest.approx((x**2).mean())


def test_good_length():
    assert [k.good_length(n) for n in (1, 7, 11, 13, 97, 211)] == [1, 7, 12, 14, 98, 216]


def test_filters_of_known_signals():
    t = np.arange(2000) / 50
    slow, fast = 2 + np.sin(2 * np.pi * 0.05 * t), np.sin(2 * np.pi * 8 * t)
    assert np.std(k.lowpassed(slow + fast, 50, 1.0, 8)[100:-100] - slow[100:-100]) < 0.02
    assert np.std(k.without_low_modes(slow + fast, 50, 1.0)[100:-100] - fast[100:-100]) < 0.02
    g = k.gain_normalised(slow * (1 + 0.01 * fast), 50, 1.0, 8)
    assert np.std(g[100:-100] - 0.01 * fast[100:-100]) < 1e-3
    h = k.apodising(np.array([0.0, 0.01, 1.0, 100.0]), 1.0, 4, True)
    assert h[0] == 0 and h[1] < 1e-6 and h[2] == 0.5 and h[3] > 0.999


def test_noise_fit_recovers_parameters():
    x = k.one_over_f(1 << 15, 50.0, 2.0, 0.5, -1.6, 3)
    s, a, f = k.fit_noise(x, 50.0)
    assert s == pytest.approx(2.0, rel=0.03) and a == pytest.approx(-1.6, abs=0.25) and f == pytest.approx(0.5, rel=0.25)


def test_quasi_newton_on_a_valley():
    x = k.quasi_newton(lambda p: (1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2, np.array([-1.0, 1.0]), 500)
    assert x == pytest.approx([1, 1], abs=1e-3)


def test_polynomial_filter_removes_polynomials():
    c = np.linspace(-1, 1, 32)
    tod = rng().normal(size=(50, 1)) + rng(1).normal(size=(50, 1)) * c
    assert np.abs(k.polynomial_filtered(tod, np.ones(32, bool), 1)).max() < 1e-10


def test_components_are_those_of_svd():
    r = rng(2)
    tod = np.outer(r.normal(size=300), r.normal(size=20)) * 5 + np.outer(r.normal(size=300), r.normal(size=20)) * 2 + r.normal(size=(300, 20)) * 0.1
    comps, amps = k.principal_components(tod, 2)
    u, s, _ = np.linalg.svd(tod - tod.mean(0), full_matrices=False)
    assert np.abs(np.diag(comps @ u[:, :2])) == pytest.approx([1, 1], abs=1e-4)
    assert np.linalg.norm(amps, axis=1) == pytest.approx(s[:2], rel=1e-4)
    left = k.without_components(tod, 2)
    assert np.std(left - left.mean(0)) < 0.12


def test_frequency_filter_removes_common_gain():
    tsys = 40 + rng(3).random(64) * 5
    gain = np.cumsum(rng(4).normal(size=1000)) * 0.01
    noise = rng(5).normal(size=(1000, 64)) * 0.01
    out = k.frequency_filtered(noise + gain[:, None], tsys, 50.0, 5.0, -1.0)
    assert np.std(out.mean(1)) < 0.05 * np.std(gain)


def test_splines():
    x = np.linspace(0, 3, 30)
    at = np.array([0.5, 1.234, 2.9])
    assert k.spline_at(x, np.sin(x), k.spline_second(x, np.sin(x)), at) == pytest.approx(np.sin(at), abs=1e-3)
    f = np.sin(x)[:, None] * np.cos(x)[None, :]
    assert k.bicubic_at(x, x, f, at, at) == pytest.approx(np.sin(at) * np.cos(at), abs=3e-3)


def test_cube_spectra_and_coupling():
    edges, steps = np.linspace(0.3, 3, 6), (1.0, 1.0, 1.0)
    got = np.mean([k.cube_spectrum(c, c, edges, steps)[0] for c in (k.gaussian_cube(lambda q: q**-1.0, (16,) * 3, steps, s) for s in range(30))], 0)
    mid = [1 / q for q in (edges[1:] + edges[:-1]) / 2]
    assert got == pytest.approx(mid, rel=0.15)
    flat = k.mode_coupling(np.ones((8, 8, 8)), edges, steps)
    assert flat == pytest.approx(np.eye(5), abs=1e-12)
    w = rng(6).random((6, 6, 6))
    m = k.mode_coupling(w, edges, steps)
    # by its sum over pairs of modes
    wk, shell = np.abs(np.fft.fftn(w) / w.size) ** 2, np.digitize(k.shells(w.shape, steps), edges) - 1
    i, j = np.argwhere(shell == 1), np.argwhere(shell == 2)
    assert m[1, 2] == pytest.approx(np.mean([sum(wk[tuple((a - b) % 6)] for b in j) for a in i]))


def test_modes_and_solvers():
    r = rng(7)
    a = np.outer(r.normal(size=10), r.normal(size=40))
    assert np.abs(k.without_modes(a, 1)).max() < 1e-10
    m = r.normal(size=(20, 20))
    spd = m @ m.T + np.eye(20)
    b = r.normal(size=20)
    assert k.conjugate_gradient(lambda p: spd @ p, b) == pytest.approx(np.linalg.solve(spd, b), rel=1e-6)
    assert k.conjugate_gradient(lambda p: spd @ p, b, lambda q: q / np.diag(spd)) == pytest.approx(np.linalg.solve(spd, b), rel=1e-6)
    other = m + 8 * np.eye(20)
    assert k.bi_conjugate_gradient(lambda p: other @ p, b) == pytest.approx(np.linalg.solve(other, b), rel=1e-5)
    half = k.matrix_power(spd, 0.5)
    assert half @ half == pytest.approx(spd)
    assert k.without_weak_modes(np.diag([1.0, 0.0]), np.array([2.0, 3.0])) == pytest.approx([2, 0])
    assert k.swapped_weak_modes(np.diag([1.0, 0.001]), np.array([2.0, 3.0]), np.array([5.0, 6.0]), 0.01) == pytest.approx([2, 6])
    assert k.weighted_map_sum([np.ones(2), 3 * np.ones(2)], [np.eye(2), np.eye(2)]) == pytest.approx([2, 2])


def test_sampler_and_simulation():
    chain = k.metropolis(lambda x: -0.5 * float(x @ x), np.zeros(1), np.ones(1) * 2, -9 * np.ones(1), 9 * np.ones(1), 20000, 1)
    assert chain.mean() == pytest.approx(0, abs=0.1) and chain.std() == pytest.approx(1, abs=0.1)
    corr = np.array([[1, 0.6], [0.6, 1]])
    x = k.correlated_noise(corr, np.array([1.0, 3.0]), 50000, 2)
    assert np.corrcoef(x.T)[0, 1] == pytest.approx(0.6, abs=0.02) and x[:, 1].std() == pytest.approx(3, rel=0.02)
