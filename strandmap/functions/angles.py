"""Angles, rotations, projections and times as column expressions (radians unless said)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi
#: Planck constant, Boltzmann constant, temperature of the background in K; unix epoch in MJD.
PLANCK, BOLTZMANN, T_CMB, MJD_EPOCH = 6.62607015e-34, 1.380649e-23, 2.7255, 40587


def normalize(a: Column, period: float = TAU) -> Column:
    return F.pmod(a, F.lit(period))


def difference(a: Column, b: Column, period: float = TAU) -> Column:
    """a - b, in [-period/2, period/2)."""
    return F.pmod(a - b + period / 2, F.lit(period)) - period / 2


def nearest_to(a: Column, b: Column, period: float = TAU) -> Column:
    """The angle equivalent to a that lies nearest to b."""
    return b + difference(a, b, period)


def unwrap_step(a: Column, before: Column, period: float = TAU) -> Column:
    """What a step from ``before`` to ``a`` adds to all later samples: a period where it jumps by more than a quarter of one."""
    d = a - before
    return F.when(d > period / 4, -period).when(d < -period / 4, period).otherwise(0.0)


def unit_vector(lon: Column, lat: Column) -> list[Column]:
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]


def cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def dot(u: list[Column], v: list[Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def norm(u: list[Column]) -> Column:
    return F.sqrt(dot(u, u))


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance, exact for near and for opposite points alike."""
    u, v = unit_vector(lon1, lat1), unit_vector(lon2, lat2)
    return F.atan2(norm(cross(u, v)), dot(u, v))


def rotate(u: list[Column], axis: str, angle: Column) -> list[Column]:
    """u turned about a coordinate axis."""
    c, s = F.cos(angle), F.sin(angle)
    i, j, k = {"x": (0, 1, 2), "y": (1, 2, 0), "z": (2, 0, 1)}[axis]
    out = [None, None, None]
    out[i], out[j], out[k] = u[i], c * u[j] - s * u[k], s * u[j] + c * u[k]
    return out


def euler_zyz(u: list[Column], phi: Column, theta: Column, psi: Column) -> list[Column]:
    return rotate(rotate(rotate(u, "z", psi), "y", theta), "z", phi)


def euler_zyz_inverse(u: list[Column], phi: Column, theta: Column, psi: Column) -> list[Column]:
    return rotate(rotate(rotate(u, "z", -phi), "y", -theta), "z", -psi)


def lon_lat(u: list[Column]) -> tuple[Column, Column]:
    return normalize(F.atan2(u[1], u[0])), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), u[2])))


def horizontal_to_equatorial(az: Column, el: Column, lst: Column, latitude: float) -> tuple[Column, Column]:
    """(right ascension, declination) of a direction; azimuth runs from north over east."""
    north = [F.cos(el) * F.cos(az), F.cos(el) * F.sin(az), F.sin(el)]  # north, east, up
    lat = F.lit(latitude)
    dec = F.asin(F.sin(lat) * north[2] + F.cos(lat) * north[0])
    hour = F.atan2(-north[1], F.cos(lat) * north[2] - F.sin(lat) * north[0])
    return normalize(lst - hour), dec


def gnomonic(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Tangent-plane coordinates about a centre; null on the far half of the sphere."""
    d = lon - lon0
    cosc = math.sin(lat0) * F.sin(lat) + math.cos(lat0) * F.cos(lat) * F.cos(d)
    near = lambda c: F.when(cosc > 0, c / cosc)
    return near(F.cos(lat) * F.sin(d)), near(math.cos(lat0) * F.sin(lat) - math.sin(lat0) * F.cos(lat) * F.cos(d))


def gnomonic_inverse(x: Column, y: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Longitude (0 to a turn) and latitude of tangent-plane coordinates about a centre."""
    down = F.sqrt(1 + x * x + y * y)
    lat = F.asin((math.sin(lat0) + y * math.cos(lat0)) / down)
    return normalize(lon0 + F.atan2(x, math.cos(lat0) - y * math.sin(lat0))), lat


def sky_to_pixel(lon: Column, lat: Column, centre: tuple[float, float], step: tuple[float, float], at: tuple[float, float]) -> tuple[Column, Column]:
    """Fractional pixel of a direction on a tangent-plane image: its reference direction and pixel, and the size of a pixel."""
    x, y = gnomonic(lon, lat, *centre)
    return x / step[0] + at[0], y / step[1] + at[1]


def pixel_to_sky(i: Column, j: Column, centre: tuple[float, float], step: tuple[float, float], at: tuple[float, float]) -> tuple[Column, Column]:
    return gnomonic_inverse((i - at[0]) * step[0], (j - at[1]) * step[1], *centre)


def detector_direction(lon: Column, lat: Column, dx: Column, dy: Column, turn: Column) -> tuple[Column, Column]:
    """Direction of a detector that lies (dx, dy) off the boresight, across and up, on a focal plane turned by ``turn``
    about it (from across towards up)."""
    across, up = F.cos(turn) * dx - F.sin(turn) * dy, F.sin(turn) * dx + F.cos(turn) * dy
    off = F.sqrt(across * across + up * up)
    share = F.when(off > 0, F.sin(off) / off).otherwise(1.0)
    u = [F.cos(off), share * across, share * up]  # about the x axis
    return lon_lat(rotate(rotate(u, "y", -lat), "z", lon))


#: Terms of a mount model, in radians; fixed names.
MOUNT = ("daz", "del", "ddk", "flex", "tilt_at", "tilt", "el_tilt", "col", "col_at")


def mounted(az: Column, el: Column, deck: Column, **terms: float) -> tuple[Column, Column]:
    """(azimuth, elevation) at which a mount really points for what its encoders read.

    Azimuth turns in the positive sense about the zenith. The encoders' offsets daz and ddk are taken off and del, one of
    the zenith distance, is added to the elevation; then come collimation by ``col`` towards ``col_at`` on the focal plane,
    a sag of ``flex`` times the cosine of the elevation, a tilt of the azimuth axis by ``tilt`` towards ``tilt_at`` and one
    of the elevation axis by ``el_tilt``. Terms left out are 0.
    """
    if unknown := set(terms) - set(MOUNT):
        raise ValueError(f"no such term: {', '.join(sorted(unknown))}")
    t = {k: F.lit(float(terms.get(k, 0.0))) for k in MOUNT}
    lon, up, turn = az - t["daz"], el + t["del"], deck - t["ddk"]
    u = [F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    u = euler_zyz(u, t["col_at"] + math.pi, t["col"], -t["col_at"] + math.pi)
    u = euler_zyz(u, lon, math.pi / 2 - up, turn)
    u = euler_zyz(u, lon, t["flex"] * F.cos(up), -lon)
    u = euler_zyz(u, -t["tilt_at"], t["tilt"], t["tilt_at"])
    return lon_lat(euler_zyz(u, lon - math.pi / 2, t["el_tilt"], math.pi / 2 - lon))


def pickup(lon: Column, lat: Column, turn: Column, beam: list[tuple[float, float, float]], horizon: list[float]) -> Column:
    """Share of a beam that falls below the horizon when it points at (lon, lat).

    The beam is a list of cells (across, up, gain), the horizon its heights at even steps of longitude from 0; both are
    constants of one expression, so a row is all that a task needs. The nearest step's height holds.
    """
    if not beam or not horizon or sum(g for _, _, g in beam) <= 0:
        raise ValueError("a beam of some gain and a horizon are needed")
    heights = F.array(*[F.lit(float(h)) for h in horizon])

    def below(cell: Column) -> Column:
        at, up = detector_direction(lon, lat, cell["x"], cell["y"], turn)
        step = F.floor(at / (TAU / len(horizon)) + 0.5).cast("int") % len(horizon)
        return F.when(up < F.element_at(heights, step + 1), cell["g"]).otherwise(0.0)

    cells = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(g)).alias("g")) for x, y, g in beam])
    return F.aggregate(F.transform(cells, below), F.lit(0.0), lambda s, v: s + v) / sum(g for _, _, g in beam)


def polarisation_turn(q: Column, u: Column, angle: Column) -> tuple[Column, Column]:
    c, s = F.cos(2 * angle), F.sin(2 * angle)
    return c * q - s * u, s * q + c * u


def nearest_int(x: Column) -> Column:
    """Rounded half away from zero."""
    return F.round(x).cast("long")


def half_even(x: Column) -> Column:
    return F.bround(x).cast("long")


def grid_index(x: Column, x0: float, dx: float, n: int, edge: int = 0) -> Column:
    """Index of the cell whose centre lies nearest, from 0; null outside, and within ``edge`` cells of a border."""
    i = nearest_int((x - x0) / dx)
    return F.when((i >= edge) & (i < n - edge), i)


def mjd(ts: Column) -> Column:
    return F.unix_micros(ts) / 86_400e6 + MJD_EPOCH


def from_mjd(day: Column) -> Column:
    return F.timestamp_micros(F.round((day - MJD_EPOCH) * 86_400e6).cast("long"))


def local_hour(day: Column, offset_hours: float) -> Column:
    return F.pmod((day - F.floor(day)) * 24 + offset_hours, F.lit(24.0))


def sidereal_time(day: Column, longitude_deg: float) -> Column:
    """Local mean sidereal time in radians (linear form of the IAU expression)."""
    d = day - 51544.5
    return F.radians(F.pmod(280.46061837 + 360.98564736629 * d + longitude_deg, F.lit(360.0)))


def antenna_to_thermodynamic(ghz: Column) -> Column:
    x = PLANCK * ghz * 1e9 / (BOLTZMANN * T_CMB)
    return F.pow(F.expm1(x), F.lit(2.0)) / (x * x * F.exp(x))


def sz_spectrum(ghz: Column) -> Column:
    x = PLANCK * ghz * 1e9 / (BOLTZMANN * T_CMB)
    return T_CMB * (x * (F.exp(x) + 1) / F.expm1(x) - 4)


def radiometer(bandwidth_hz: Column, seconds: Column) -> Column:
    """Expected relative noise."""
    return 1 / F.sqrt(bandwidth_hz * seconds)


def frequency_index(freq: Column, rate: float, n: int) -> Column:
    """Index of a frequency in the half-complex transform of n samples, from 0."""
    return nearest_int(F.abs(freq) * n / rate)


def index_frequency(i: Column, rate: float, n: int) -> Column:
    return i * (rate / n)


def legendre(x: Column, degree: int) -> list[Column]:
    """P_0 ... P_degree."""
    p = [F.lit(1.0), x]
    for k in range(2, degree + 1):
        p.append(((2 * k - 1) * x * p[k - 1] - (k - 1) * p[k - 2]) / k)
    return p[: degree + 1]
