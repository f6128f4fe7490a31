"""Dense numeric kernels of one channel or one feed at a time, run in Arrow-batched groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..runtime import ship


def fields(df: DataFrame, keys: list[str]) -> str:
    """Columns of a result that come from ``df``; whoever asks will run Python workers."""
    ship(df.sparkSession)
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


# Fourier kernels over one evenly sampled stream.


def mirrored(x: np.ndarray) -> np.ndarray:
    """The stream and its mirror image, which a periodic transform joins without a step."""
    return np.concatenate([x, x[::-1]])


def good_length(n: int) -> int:
    """The smallest length >= n whose prime factors are 2, 3, 5 and 7."""
    while True:
        m = n
        for p in (2, 3, 5, 7):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def power_spectrum(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    f = np.fft.rfft(x)
    return np.fft.rfftfreq(len(x), 1 / rate), np.abs(f) ** 2 / len(x)


def inverse_noise(freq: np.ndarray, sigma0: float, fknee: float, alpha: float) -> np.ndarray:
    """1 / (sigma0^2 (1 + (f / fknee)^alpha)), 0 at frequency 0."""
    out = np.zeros_like(freq)
    some = freq > 0
    out[some] = 1 / (sigma0**2 * (1 + (freq[some] / fknee) ** alpha))
    return out


def apodising(freq: np.ndarray, cut: float, alpha: float, high: bool) -> np.ndarray:
    with np.errstate(divide="ignore"):
        ratio = np.where(freq > 0, freq / cut, 0.0)
    return 1 / (1 + ratio**alpha) if not high else np.where(freq > 0, 1 / (1 + np.where(ratio > 0, ratio, 1) ** -abs(alpha)), 0.0)


def filtered(x: np.ndarray, rate: float, shape) -> np.ndarray:
    """The stream, mirrored, times shape(frequency) in Fourier space."""
    m = mirrored(x)
    f = np.fft.rfft(m)
    return np.fft.irfft(f * shape(np.fft.rfftfreq(len(m), 1 / rate)), len(m))[: len(x)]


def lowpassed(x: np.ndarray, rate: float, cut: float, alpha: float) -> np.ndarray:
    return filtered(x, rate, lambda f: apodising(f, cut, alpha, False))


def gain_normalised(x: np.ndarray, rate: float, cut: float, alpha: float) -> np.ndarray:
    """The stream over its own slow part, minus 1."""
    return x / lowpassed(x, rate, cut, alpha) - 1


def without_low_modes(x: np.ndarray, rate: float, cut: float) -> np.ndarray:
    return filtered(x, rate, lambda f: (f >= cut).astype(float))


def correlation_of(spectrum: np.ndarray) -> np.ndarray:
    return np.fft.irfft(spectrum)


# Noise fits.


def quasi_newton(f, x: np.ndarray, steps: int = 100, tol: float = 1e-8) -> np.ndarray:
    """BFGS with numeric gradients and a halving line search."""
    x = np.asarray(x, float)

    def grad(p):
        g = np.zeros_like(p)
        for i in range(len(p)):
            h = 1e-5 * max(1.0, abs(p[i]))
            e = np.zeros_like(p)
            e[i] = h
            g[i] = (f(p + e) - f(p - e)) / (2 * h)
        return g

    n = len(x)
    inv, fx, g = np.eye(n), f(x), grad(x)
    for _ in range(steps):
        step = -inv @ g
        if step @ g > 0:
            inv, step = np.eye(n), -g
        size = 1.0
        while size > 1e-10 and not (f(x + size * step) <= fx + 1e-4 * size * (g @ step)):
            size /= 2
        if size <= 1e-10:
            break
        new = x + size * step
        g2, f2 = grad(new), f(new)
        s, y = new - x, g2 - g
        if s @ y > 1e-12:
            r = 1 / (s @ y)
            a = np.eye(n) - r * np.outer(s, y)
            inv = a @ inv @ a.T + r * np.outer(s, s)
        done = abs(f2 - fx) <= tol * (abs(fx) + tol)
        x, fx, g = new, f2, g2
        if done:
            break
    return x


def fit_noise(x: np.ndarray, rate: float) -> tuple[float, float, float]:
    """(sigma0, alpha, fknee) of greatest likelihood for the stream's power spectrum; sigma0 is solved for in closed form."""
    freq, power = power_spectrum(x - x.mean(), rate)
    freq, power = freq[1:], power[1:]

    def shape(p):
        return 1 + (freq / np.exp(p[0])) ** (-np.exp(p[1]))

    def loss(p):
        if not (-15 < p[0] < np.log(rate)) or not (-3 < p[1] < 2.3):
            return 1e30
        s = shape(p)
        return float(np.log((power / s).mean()) + np.log(s).mean())

    p = min((quasi_newton(loss, np.array([np.log(rate * k), np.log(1.5)])) for k in (0.001, 0.01, 0.1)), key=loss)
    return float(np.sqrt((power / shape(p)).mean())), float(-np.exp(p[1])), float(np.exp(p[0]))


# Channel kernels: rows are samples, columns channels.


def polynomial_filtered(tod: np.ndarray, ok: np.ndarray, degree: int) -> np.ndarray:
    """Each sample minus its masked least-squares polynomial over channels."""
    t = np.polynomial.legendre.legvander(np.linspace(-1, 1, tod.shape[1]), degree)
    fit = np.linalg.lstsq(t[ok], tod[:, ok].T, rcond=None)[0]
    return tod - (t @ fit).T


def principal_components(tod: np.ndarray, n: int, steps: int = 200, tol: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """(components over time, amplitudes by channel) by power iteration and deflation; signs are arbitrary."""
    left, comps, amps = tod - tod.mean(0), [], []
    for _ in range(n):
        v = left.sum(1)
        v = v / (np.linalg.norm(v) or 1.0)
        if not v.any():
            v = np.random.default_rng(0).normal(size=len(left))
            v /= np.linalg.norm(v)
        for _ in range(steps):
            w = left @ (left.T @ v)
            size = np.linalg.norm(w)
            if size == 0:
                break
            w /= size
            close = 1 - abs(w @ v) < tol
            v = w
            if close:
                break
        a = left.T @ v
        left = left - np.outer(v, a)
        comps.append(v)
        amps.append(a)
    return np.array(comps), np.array(amps)


def without_components(tod: np.ndarray, n: int, least: float = 0.0) -> np.ndarray:
    """Minus the components whose largest amplitude reaches ``least`` times the channels' noise."""
    comps, amps = principal_components(tod, n)
    noise = np.std(np.diff(tod, axis=0), axis=0) / np.sqrt(2)
    keep = [k for k in range(n) if np.abs(amps[k]).max() >= least * np.median(noise)]
    return tod - (comps[keep].T @ amps[keep] if keep else 0)


def frequency_filtered(tod: np.ndarray, tsys: np.ndarray, rate: float, fknee: float, alpha: float) -> np.ndarray:
    """Minus a gain fluctuation common to all channels, kept to slow frequencies, and two templates of the system temperature."""
    w = 1 / tsys**2
    t = np.stack([1 / tsys, (np.arange(len(tsys)) / len(tsys) - 0.5) / tsys], 1)
    normal = t.T @ (w[:, None] * t)
    proj = np.eye(len(tsys)) - t @ np.linalg.solve(normal, (w[:, None] * t).T)
    unit = w * (proj @ np.ones(len(tsys)))
    gain = filtered(tod @ unit / unit.sum(), rate, lambda f: 1 / (1 + (f / fknee) ** abs(alpha)))
    left = tod - gain[:, None]
    return left - (t @ np.linalg.solve(normal, (w[:, None] * t).T @ left.T)).T


# Splines.


def spline_second(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives of the natural cubic spline through the points."""
    n = len(x)
    if n < 3:
        return np.zeros(n)
    h = np.diff(x)
    a = np.zeros((n, n))
    a[0, 0] = a[-1, -1] = 1
    i = np.arange(1, n - 1)
    a[i, i - 1], a[i, i], a[i, i + 1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    b = np.zeros(n)
    b[1:-1] = 6 * (np.diff(y[1:]) / h[1:] - np.diff(y[:-1]) / h[:-1])
    return np.linalg.solve(a, b)


def spline_at(x: np.ndarray, y: np.ndarray, second: np.ndarray, at: np.ndarray) -> np.ndarray:
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    h = x[k + 1] - x[k]
    a, b = (x[k + 1] - at) / h, (at - x[k]) / h
    return a * y[k] + b * y[k + 1] + ((a**3 - a) * second[k] + (b**3 - b) * second[k + 1]) * h**2 / 6


def bicubic_at(x: np.ndarray, y: np.ndarray, f: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Spline over both axes of f(x, y) at points."""
    rows = np.array([spline_at(y, r, spline_second(y, r), py) for r in f])
    return np.array([spline_at(x, rows[:, i], spline_second(x, rows[:, i]), px[i : i + 1])[0] for i in range(len(px))])


# Cubes.


def shells(shape: tuple[int, ...], steps: tuple[float, ...]) -> np.ndarray:
    k = np.meshgrid(*[np.fft.fftfreq(n, d) * 2 * np.pi for n, d in zip(shape, steps, strict=True)], indexing="ij")
    return np.sqrt(sum(a * a for a in k))


def cube_spectrum(a: np.ndarray, b: np.ndarray, edges: np.ndarray, steps: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Cross spectrum of two cubes (auto if they are one) by shells of wave number, and the modes in each; empty ones are 0."""
    p = (np.fft.fftn(a) * np.conj(np.fft.fftn(b))).real * np.prod(steps) / a.size
    k = shells(a.shape, steps)
    n, _ = np.histogram(k, edges)
    s, _ = np.histogram(k, edges, weights=p)
    return np.where(n > 0, s / np.maximum(n, 1), 0.0), n


def cube_spectrum_2d(a: np.ndarray, edges: np.ndarray, steps: tuple[float, float, float]) -> np.ndarray:
    """Spectrum by wave number across and along the last axis."""
    p = np.abs(np.fft.fftn(a)) ** 2 * np.prod(steps) / a.size
    kx, ky, kz = np.meshgrid(*[np.fft.fftfreq(n, d) * 2 * np.pi for n, d in zip(a.shape, steps, strict=True)], indexing="ij")
    across, along = np.hypot(kx, ky).ravel(), np.abs(kz).ravel()
    n, _, _ = np.histogram2d(across, along, [edges, edges])
    s, _, _ = np.histogram2d(across, along, [edges, edges], weights=p.ravel())
    return np.where(n > 0, s / np.maximum(n, 1), 0.0)


def gaussian_cube(spectrum, shape: tuple[int, ...], steps: tuple[float, ...], seed: int) -> np.ndarray:
    """A random cube whose expected spectrum is spectrum(k)."""
    white = np.random.default_rng(seed).normal(size=shape)
    k = shells(shape, steps)
    amp = np.sqrt(np.where(k > 0, spectrum(np.maximum(k, 1e-30)), 0.0) / np.prod(steps))
    return np.fft.ifftn(np.fft.fftn(white) * amp).real


def mode_coupling(weight: np.ndarray, edges: np.ndarray, steps: tuple[float, ...]) -> np.ndarray:
    """How a weight moves power between shells: M[i, j] = mean over modes k in i of the sum over q in j of |W(k - q)|^2."""
    power = np.abs(np.fft.fftn(weight) / weight.size) ** 2
    k, nb = shells(weight.shape, steps), len(edges) - 1
    of = np.digitize(k, edges) - 1
    back = np.fft.fftn(power)
    out = np.zeros((nb, nb))
    for j in range(nb):  # the sum over q is a circular convolution of |W|^2 with the shell
        s = np.fft.ifftn(np.fft.fftn((of == j).astype(float)) * back).real
        for i in range(nb):
            here = of == i
            out[i, j] = s[here].mean() if here.any() else 0.0
    return out


def svd_modes(cube: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading modes of a (channel, pixel) matrix: left vectors, sizes and right vectors."""
    u, s, v = np.linalg.svd(cube, full_matrices=False)
    return u[:, :n], s[:n], v[:n]


def without_modes(cube: np.ndarray, n: int) -> np.ndarray:
    u, s, v = svd_modes(cube, n)
    return cube - (u * s) @ v


# Solvers.


def conjugate_gradient(apply, b: np.ndarray, precondition=lambda r: r, tol: float = 1e-10, steps: int = 500) -> np.ndarray:
    x, r = np.zeros_like(b), b.copy()
    z = precondition(r)
    p, rz = z.copy(), r @ z
    for _ in range(steps):
        if np.sqrt(r @ r) <= tol * max(1e-300, np.sqrt(b @ b)):
            break
        q = apply(p)
        a = rz / (p @ q)
        x, r = x + a * p, r - a * q
        z = precondition(r)
        rz, old = r @ z, rz
        p = z + rz / old * p
    return x


def bi_conjugate_gradient(apply, b: np.ndarray, tol: float = 1e-10, steps: int = 500) -> np.ndarray:
    """Stabilised form, for matrices that aren't symmetric."""
    x, r = np.zeros_like(b), b.copy()
    r0, p, rho = r.copy(), r.copy(), r @ r
    for _ in range(steps):
        if np.linalg.norm(r) <= tol * np.linalg.norm(b):
            break
        v = apply(p)
        a = rho / (r0 @ v)
        s = r - a * v
        t = apply(s)
        w = (t @ s) / max(1e-300, t @ t)
        x, r = x + a * p + w * s, s - w * t
        rho, old = r0 @ r, rho
        p = r + rho / old * a / max(1e-300, w) * (p - w * v)
    return x


def without_weak_modes(matrix: np.ndarray, x: np.ndarray, least: float = 1e-12) -> np.ndarray:
    """x without the eigenmodes whose eigenvalue is below ``least`` of the largest."""
    e, v = np.linalg.eigh(matrix)
    keep = np.abs(e) >= least * np.abs(e).max()
    return v[:, keep] @ (v[:, keep].T @ x)


def swapped_weak_modes(matrix: np.ndarray, x: np.ndarray, other: np.ndarray, least: float) -> np.ndarray:
    e, v = np.linalg.eigh(matrix)
    c = v.T @ x
    weak = e < least * e.max()
    c[weak] = (v.T @ other)[weak]
    return v @ c


def matrix_power(matrix: np.ndarray, power: float) -> np.ndarray:
    """Square root (0.5), inverse (-1) and the like of a symmetric matrix; null modes stay null."""
    e, v = np.linalg.eigh(matrix)
    good = np.abs(e) > 1e-12 * np.abs(e).max()
    p = np.zeros_like(e)
    p[good] = e[good] ** power
    return (v * p) @ v.T


def weighted_map_sum(maps: list[np.ndarray], inverses: list[np.ndarray]) -> np.ndarray:
    return np.linalg.solve(sum(inverses), sum(n @ m for n, m in zip(inverses, maps, strict=True)))


def metropolis(log_p, start: np.ndarray, step: np.ndarray, low: np.ndarray, high: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A chain of bounded random-walk Metropolis samples."""
    rng = np.random.default_rng(seed)
    x, lp, out = np.array(start, float), log_p(np.array(start, float)), []
    for _ in range(n):
        y = x + step * rng.normal(size=len(x))
        if ((y >= low) & (y <= high)).all():
            ly = log_p(y)
            if np.log(rng.random()) < ly - lp:
                x, lp = y, ly
        out.append(x.copy())
    return np.array(out)


def correlated_noise(corr: np.ndarray, sigma: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n samples of channels with a correlation matrix and deviations."""
    return np.random.default_rng(seed).normal(size=(n, len(corr))) @ np.linalg.cholesky(corr).T * sigma


def one_over_f(n: int, rate: float, sigma0: float, fknee: float, alpha: float, seed: int) -> np.ndarray:
    """A stream with spectrum sigma0^2 (1 + (f / fknee)^alpha)."""
    f = np.fft.rfftfreq(n, 1 / rate)
    shape = np.ones_like(f)
    shape[1:] = np.sqrt(1 + (f[1:] / fknee) ** alpha)
    return np.fft.irfft(np.fft.rfft(np.random.default_rng(seed).normal(size=n)) * shape, n) * sigma0


# Spark forms: one group a task at a time, so a group is a channel or a feed of one scan.


def per_channel(df: DataFrame, keys: list[str], order: str, value: str, f) -> DataFrame:
    """f (array -> array of the same length) over each channel's samples in order."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(order)
        return p[[*keys, order]].assign(**{value: np.asarray(f(p[value].to_numpy(float)), float)})

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, f"{fields(df, [*keys, order])}, `{value}` double")


def per_feed(df: DataFrame, keys: list[str], order: str, channel: str, value: str, f) -> DataFrame:
    """f (samples x channels -> the same shape) over each feed's matrix of samples.

    A sample that lacks a channel keeps the others: f sees the channel's linear interpolation there (its nearest value
    beyond the ends), and the result leaves that one entry out. A channel without any value is left out altogether.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        m = p.pivot(index=order, columns=channel, values=value).sort_index().dropna(axis=1, how="all").astype(float)
        held = m.notna()
        if not m.size:
            return p.head(0)[[*keys, order, channel, value]]
        m = m.interpolate(limit_direction="both")
        out = pd.DataFrame(f(m.to_numpy(float)), index=m.index, columns=m.columns).where(held).stack().dropna().rename(value).reset_index()
        for k in keys:
            out[k] = p[k].iloc[0]
        return out[[*keys, order, channel, value]]

    return df.select(*keys, order, channel, value).groupBy(*keys).applyInPandas(run, f"{fields(df, [*keys, order, channel])}, `{value}` double")


def noise_fits(df: DataFrame, keys: list[str], order: str, value: str, rate: float) -> DataFrame:
    """sigma0, alpha and fknee by channel."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        s, a, f = fit_noise(p.sort_values(order)[value].to_numpy(float), rate)
        return p[keys].head(1).assign(sigma0=s, alpha=a, fknee=f)

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, f"{fields(df, keys)}, sigma0 double, alpha double, fknee double")


def spectra(df: DataFrame, keys: list[str], order: str, value: str, rate: float) -> DataFrame:
    """freq and power by channel."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        f, s = power_spectrum(p.sort_values(order)[value].to_numpy(float), rate)
        out = pd.DataFrame({"freq": f, "power": s})
        for k in keys:
            out[k] = p[k].iloc[0]
        return out[[*keys, "freq", "power"]]

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, f"{fields(df, keys)}, freq double, power double")


# Gaps, correlation functions, coupling and likelihoods.


def autocovariance(n: int, rate: float, sigma0: float, fknee: float, alpha: float) -> np.ndarray:
    """Covariance by lag of a stream with spectrum sigma0^2 (1 + (f / fknee)^alpha); the lowest frequency bounds its red part."""
    m = 4 * n
    f = np.fft.rfftfreq(m, 1 / rate)
    f[0] = f[1]
    return np.fft.irfft(sigma0**2 * (1 + (f / fknee) ** alpha), m)[:n]


def constrained_realisation(x: np.ndarray, ok: np.ndarray, cov: np.ndarray, seed: int | None = None) -> np.ndarray:
    """x with its gaps drawn (or, without a seed, set to the mean) given the good samples and a covariance by lag."""
    i = np.arange(len(x))
    c = cov[np.abs(i[:, None] - i[None, :])]
    good, gap = np.flatnonzero(ok), np.flatnonzero(~ok)
    mean = x[good].mean()
    gain = np.linalg.solve(c[np.ix_(good, good)], c[np.ix_(good, gap)]).T
    out = x.copy()
    out[gap] = mean + gain @ (x[good] - mean)
    if seed is not None and len(gap):
        left = c[np.ix_(gap, gap)] - gain @ c[np.ix_(good, gap)]
        e, v = np.linalg.eigh(left)
        out[gap] += v @ (np.sqrt(np.maximum(e, 0)) * np.random.default_rng(seed).normal(size=len(gap)))
    return out


def fit_noise_with_gaps(x: np.ndarray, ok: np.ndarray, rate: float, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Draws the gaps and fits the noise in turn; the mean of (sigma0, alpha, fknee) after the first half, and the last stream."""
    y = np.where(ok, x, x[ok].mean())
    got = []
    for k in range(rounds):
        s, a, f = fit_noise(y, rate)
        got.append((s, a, f))
        y = constrained_realisation(np.where(ok, x, 0.0), ok, autocovariance(len(x), rate, s, f, a), seed + k)
    return np.mean(got[rounds // 2 :], 0), y


def angular_correlation(c: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Sum of (2 l + 1) / 4 pi C_l P_l(cos theta)."""
    w = (2 * np.arange(len(c)) + 1) / (4 * np.pi) * c
    return np.polynomial.legendre.legval(np.cos(theta), w)


def wigner_square(a: int, b: int, c: int) -> float:
    """Square of the 3j symbol of three degrees with m = 0."""
    from math import lgamma

    s = a + b + c
    if s % 2 or c < abs(a - b) or c > a + b:
        return 0.0
    g, f = s // 2, lambda k: lgamma(k + 1)
    one = f(s - 2 * a) + f(s - 2 * b) + f(s - 2 * c) - f(s + 1)
    return float(np.exp(one + 2 * (f(g) - f(g - a) - f(g - b) - f(g - c))))


def sky_coupling(window: np.ndarray, lmax: int) -> np.ndarray:
    """How a mask of spectrum ``window`` couples degrees: M = (2 l' + 1) / 4 pi sum (2 l'' + 1) W (3j)^2."""
    out = np.zeros((lmax + 1, lmax + 1))
    for i in range(lmax + 1):
        for j in range(lmax + 1):
            out[i, j] = (2 * j + 1) / (4 * np.pi) * sum((2 * k + 1) * window[k] * wigner_square(i, j, k) for k in range(abs(i - j), min(i + j, len(window) - 1) + 1))
    return out


def likeliest_powers(data: np.ndarray, noise: np.ndarray, parts: list[np.ndarray], start: np.ndarray, steps: int = 30, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Powers of greatest likelihood of data with covariance noise + sum of powers * parts, and their deviations (Fisher scoring)."""
    p = np.array(start, float)
    fisher = np.eye(len(p))
    for _ in range(steps):
        inv = np.linalg.inv(noise + sum(a * m for a, m in zip(p, parts, strict=True)))
        half = [inv @ m for m in parts]
        y = inv @ data
        grad = np.array([0.5 * (y @ m @ y) - 0.5 * np.trace(h) for m, h in zip(parts, half, strict=True)])
        fisher = np.array([[0.5 * np.sum(g * h.T) for h in half] for g in half])
        step = np.linalg.solve(fisher, grad)
        p = p + step
        if np.abs(step).max() <= tol * max(1.0, np.abs(p).max()):
            break
    return p, np.sqrt(np.diag(np.linalg.inv(fisher)))


def top_hat(m: np.ndarray, wx: int, wy: int) -> np.ndarray:
    """Mean over a rectangle of (2 wx + 1) x (2 wy + 1) cells around each, with zeros beyond the edges, by Fourier transforms."""
    shape = (m.shape[0] + 2 * wx, m.shape[1] + 2 * wy)
    box = np.zeros(shape)
    box[: 2 * wx + 1, : 2 * wy + 1] = 1
    full = np.fft.irfft2(np.fft.rfft2(m, shape) * np.fft.rfft2(box), shape)
    return full[wx : wx + m.shape[0], wy : wy + m.shape[1]] / ((2 * wx + 1) * (2 * wy + 1))


def without_sinusoid(t: np.ndarray, x: np.ndarray, steps: int = 200) -> tuple[np.ndarray, float]:
    """x minus its best sinusoid, and that one's frequency: a scan of frequencies around the strongest mode, each by least squares."""
    rate = (len(t) - 1) / (t[-1] - t[0])
    f0 = np.argmax(np.abs(np.fft.rfft(x - x.mean()))[1:]) + 1
    best = (np.inf, None, 0.0)
    for f in np.linspace(max(0.8, f0 - 1), f0 + 1, steps) * rate / len(x):
        b = np.stack([np.ones_like(t), np.sin(2 * np.pi * f * t), np.cos(2 * np.pi * f * t)], 1)
        left = x - b @ np.linalg.lstsq(b, x, rcond=None)[0]
        size = float(left @ left)
        if size < best[0]:
            best = (size, left, float(f))
    return best[1], best[2]


def is_lissajous(t: np.ndarray, az: np.ndarray, el: np.ndarray, share: float = 0.1) -> bool:
    """Both axes move, each as one sinusoid to within a share of its deviation."""
    return all(np.std(x) > 0 and np.std(without_sinusoid(t, x)[0]) < share * np.std(x) for x in (az, el))


def contour_ellipse(x: np.ndarray, y: np.ndarray, chi2: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Centre and covariance of the parabola through a chi2 surface."""
    b = np.stack([np.ones_like(x), x, y, x * x, x * y, y * y], 1)
    _, bx, by, a, c, d = np.linalg.lstsq(b, chi2, rcond=None)[0]
    h = np.array([[2 * a, c], [c, 2 * d]])
    centre = np.linalg.solve(h, [-bx, -by])
    return float(centre[0]), float(centre[1]), 2 * np.linalg.inv(h)
