"""Equal-area pixels of the sphere (the hierarchical scheme of Gorski et al. 2005) as column expressions.

Each of 12 base faces is cut into nside x nside pixels. Ring order counts along circles of latitude from the north,
nested order by face and then by the interleaved bits of the place on the face. Angles: colatitude theta, longitude phi.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_PI = math.pi / 2


def count(nside: int) -> int:
    return 12 * nside * nside


def _long(c: Column) -> Column:
    return F.floor(c).cast("long")


def _face_place(nside: int, theta: Column, phi: Column) -> tuple[Column, Column, Column]:
    """(face, x, y) of a direction."""
    z, t = F.cos(theta), F.pmod(phi, F.lit(2 * math.pi)) / HALF_PI
    # Around the equator: lines of constant t - 3z/4 and t + 3z/4 bound the pixels.
    a, b = nside * (0.5 + t) - nside * 0.75 * z, nside * (0.5 + t) + nside * 0.75 * z
    jp, jm = _long(a), _long(b)
    fp, fm = _long(jp / nside), _long(jm / nside)
    belt_face = F.when(fp == fm, F.pmod(fp, F.lit(4)) + 4).when(fp < fm, F.pmod(fp, F.lit(4))).otherwise(F.pmod(fm, F.lit(4)) + 8)
    belt_x, belt_y = F.pmod(jm, F.lit(nside)), nside - 1 - F.pmod(jp, F.lit(nside))
    # Near the poles: pixels grow linearly with the distance from the pole.
    q = F.least(_long(t), F.lit(3).cast("long"))
    part, grow = t - q, nside * F.sqrt(3 * (1 - F.abs(z)))
    p, m = F.least(_long(part * grow), F.lit(nside - 1).cast("long")), F.least(_long((1 - part) * grow), F.lit(nside - 1).cast("long"))
    north = z > 0
    cap_x, cap_y = F.when(north, nside - 1 - m).otherwise(p), F.when(north, nside - 1 - p).otherwise(m)
    belt = F.abs(z) <= 2 / 3
    return F.when(belt, belt_face).otherwise(F.when(north, q).otherwise(q + 8)), F.when(belt, belt_x).otherwise(cap_x), F.when(belt, belt_y).otherwise(cap_y)


def _spread(v: Column) -> Column:
    """The bits of v with a zero between any two."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def _gather(v: Column) -> Column:
    """Every other bit of v, together."""
    v = v.bitwiseAND(F.lit(0x5555555555555555).cast("long"))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def to_nested(nside: int, theta: Column, phi: Column) -> Column:
    face, x, y = _face_place(nside, theta, phi)
    return (face * nside * nside + _spread(x.cast("long")) + 2 * _spread(y.cast("long"))).cast("long")


def _nested_place(nside: int, pix: Column) -> tuple[Column, Column, Column]:
    face = _long(pix / (nside * nside))
    i = pix - face * nside * nside
    return face, _gather(i), _gather(F.shiftright(i, 1))


def _ring_of(nside: int, face: Column, x: Column, y: Column) -> tuple[Column, Column, Column]:
    """(ring from 1, pixels in a quarter of the ring, index in the ring from 1)."""
    row, column = _long(face / 4) + 2, F.pmod(2 * F.pmod(face, F.lit(4)) + F.when((face >= 4) & (face < 8), 0).otherwise(1), F.lit(8))
    ring = row * nside - x - y - 1
    quarter = F.when(ring < nside, ring).when(ring > 3 * nside, 4 * nside - ring).otherwise(F.lit(nside).cast("long"))
    shift = F.when((ring < nside) | (ring > 3 * nside), 0).otherwise(F.pmod(ring - nside, F.lit(2)))
    at = (column * quarter + x - y + 1 + shift) / 2
    return ring, quarter, F.pmod(_long(at) - 1, 4 * quarter) + 1


def nested_to_ring(nside: int, pix: Column) -> Column:
    ring, quarter, at = _ring_of(nside, *_nested_place(nside, pix))
    cap = 2 * nside * (nside - 1)
    before = F.when(ring < nside, 2 * ring * (ring - 1)).when(ring <= 3 * nside, cap + (ring - nside) * 4 * nside).otherwise(count(nside) - 2 * quarter * (quarter + 1))
    return (before + at - 1).cast("long")


def nested_angles(nside: int, pix: Column) -> tuple[Column, Column]:
    """(theta, phi) of a nested pixel's centre."""
    ring, quarter, at = _ring_of(nside, *_nested_place(nside, pix))
    cap = 1 - quarter * quarter / (3.0 * nside * nside)
    z = F.when(ring < nside, cap).when(ring > 3 * nside, -cap).otherwise((2 * nside - ring) * 2 / (3.0 * nside))
    shift = F.when((ring < nside) | (ring > 3 * nside), 0.5).otherwise((1 - F.pmod(ring - nside, F.lit(2))) * 0.5)
    return F.acos(z), F.pmod((at - 1 + shift) * HALF_PI / quarter, F.lit(2 * math.pi))


def parent(pix: Column, steps: int) -> Column:
    """The pixel ``steps`` levels coarser that a nested pixel lies in."""
    return F.shiftright(pix, 2 * steps)
