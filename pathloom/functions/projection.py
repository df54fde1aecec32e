"""Transverse Mercator for UTM zones as columns: Krüger's series to the sixth order on WGS84.

The zone and the hemisphere follow from the SRID: 326zz north, 327zz south.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid and UTM's scale and false origins.
A, FLATTENING, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
N = FLATTENING / (2 - FLATTENING)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
ECC = math.sqrt(FLATTENING * (2 - FLATTENING))
# Krüger's coefficients, forward and inverse, as polynomials in n.
ALPHA = [
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180 - 127 * N**5 / 288 + 7891 * N**6 / 37800,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440 + 281 * N**5 / 630 - 1983433 * N**6 / 1935360,
    61 * N**3 / 240 - 103 * N**4 / 140 + 15061 * N**5 / 26880 + 167603 * N**6 / 181440,
    49561 * N**4 / 161280 - 179 * N**5 / 168 + 6601661 * N**6 / 7257600,
    34729 * N**5 / 80640 - 3418889 * N**6 / 1995840,
    212378941 * N**6 / 319334400,
]
BETA = [
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360 - 81 * N**5 / 512 + 96199 * N**6 / 604800,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440 + 46 * N**5 / 105 - 1118711 * N**6 / 3870720,
    17 * N**3 / 480 - 37 * N**4 / 840 - 209 * N**5 / 4480 + 5569 * N**6 / 90720,
    4397 * N**4 / 161280 - 11 * N**5 / 504 - 830251 * N**6 / 7257600,
    4583 * N**5 / 161280 - 108847 * N**6 / 3991680,
    20648693 * N**6 / 638668800,
]


def _zone(srid: int) -> tuple[float, bool]:
    if not (32601 <= srid <= 32660 or 32701 <= srid <= 32760):
        raise ValueError(f"SRID {srid} is no UTM zone")
    return math.radians((srid % 100) * 6 - 183), srid >= 32700


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_utm(lon: Column, lat: Column, srid: int) -> tuple[Column, Column]:
    """(x, y) in metres of degrees of longitude and latitude."""
    middle, south = _zone(srid)

    def conformal(v):
        t = F.sinh(F.atanh(v["s"]) - ECC * F.atanh(ECC * v["s"]))
        return let(t, lambda t: F.struct(F.atan2(t, F.cos(v["lam"])).alias("xi"), F.atanh(F.sin(v["lam"]) / F.sqrt(1 + t * t)).alias("eta")))

    def series(v):
        xi, eta = v["xi"], v["eta"]
        for j, a in enumerate(ALPHA, 1):
            xi = xi + a * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
            eta = eta + a * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
        return F.struct((EAST + SCALE * RADIUS * eta).alias("x"), ((SOUTH if south else 0.0) + SCALE * RADIUS * xi).alias("y"))

    place = F.struct(F.sin(F.radians(lat)).alias("s"), (F.radians(lon) - middle).alias("lam"))
    out = let(let(place, conformal), series)
    return out["x"], out["y"]


def from_utm(x: Column, y: Column, srid: int) -> tuple[Column, Column]:
    """(lon, lat) in degrees; the latitude by three Newton steps from the conformal one."""
    middle, south = _zone(srid)

    def series(v):
        xi, eta = v["xi"], v["eta"]
        for j, b in enumerate(BETA, 1):
            xi = xi - b * F.sin(2 * j * v["xi"]) * F.cosh(2 * j * v["eta"])
            eta = eta - b * F.cos(2 * j * v["xi"]) * F.sinh(2 * j * v["eta"])
        return F.struct(xi.alias("xi"), eta.alias("eta"))

    def newton(want, t):
        hyp = F.sqrt(1 + t * t)
        sigma = F.sinh(ECC * F.atanh(ECC * t / hyp))
        return let(F.struct(hyp.alias("h"), (t * F.sqrt(1 + sigma * sigma) - sigma * hyp).alias("now")), lambda v: t + (want - v["now"]) * (1 + (1 - ECC**2) * t * t) / ((1 - ECC**2) * F.sqrt(1 + v["now"] * v["now"]) * v["h"]))

    def degrees(v):
        want = F.sin(v["xi"]) / F.sqrt(F.sinh(v["eta"]) * F.sinh(v["eta"]) + F.cos(v["xi"]) * F.cos(v["xi"]))
        tan = let(want, lambda w: let(newton(w, w), lambda t: let(newton(w, t), lambda u: newton(w, u))))
        return F.struct(F.degrees(F.atan2(F.sinh(v["eta"]), F.cos(v["xi"])) + middle).alias("lon"), F.degrees(F.atan(tan)).alias("lat"))

    plane = F.struct(((y - (SOUTH if south else 0.0)) / (SCALE * RADIUS)).alias("xi"), ((x - EAST) / (SCALE * RADIUS)).alias("eta"))
    out = let(let(plane, series), degrees)
    return out["lon"], out["lat"]
