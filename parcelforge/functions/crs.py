"""Universal Transverse Mercator as column expressions: the Krueger series to the sixth power of the third flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import let

#: WGS 84 and UTM.
SEMI_MAJOR, FLATTENING, SCALE, FALSE_EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_N = FLATTENING / (2 - FLATTENING)
RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
ECCENTRICITY = (FLATTENING * (2 - FLATTENING)) ** 0.5
#: The published coefficients of the forward and inverse series.
ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180 - 127 * _N**5 / 288 + 7891 * _N**6 / 37800,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440 + 281 * _N**5 / 630 - 1983433 * _N**6 / 1935360,
    61 * _N**3 / 240 - 103 * _N**4 / 140 + 15061 * _N**5 / 26880 + 167603 * _N**6 / 181440,
    49561 * _N**4 / 161280 - 179 * _N**5 / 168 + 6601661 * _N**6 / 7257600,
    34729 * _N**5 / 80640 - 3418889 * _N**6 / 1995840,
    212378941 * _N**6 / 319334400,
)
BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360 - 81 * _N**5 / 512 + 96199 * _N**6 / 604800,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440 + 46 * _N**5 / 105 - 1118711 * _N**6 / 3870720,
    17 * _N**3 / 480 - 37 * _N**4 / 840 - 209 * _N**5 / 4480 + 5569 * _N**6 / 90720,
    4397 * _N**4 / 161280 - 11 * _N**5 / 504 - 830251 * _N**6 / 7257600,
    4583 * _N**5 / 161280 - 108847 * _N**6 / 3991680,
    20648693 * _N**6 / 638668800,
)


def central_meridian(zone: int) -> float:
    return zone * 6 - 183.0


def _forward(zone: int) -> list:
    """The steps from longitude and latitude to metres: each takes two numbers, that it uses many times, and gives two."""

    def conformal(lon: Column, lat: Column) -> tuple[Column, Column]:
        phi = F.radians(lat)
        return F.radians(lon - central_meridian(zone)), F.sinh(F.atanh(F.sin(phi)) - ECCENTRICITY * F.atanh(ECCENTRICITY * F.sin(phi)))

    def sphere(lam: Column, t: Column) -> tuple[Column, Column]:
        return F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))

    def metres(xi: Column, eta: Column) -> tuple[Column, Column]:
        x, y = eta, xi
        for j, a in enumerate(ALPHA, 1):
            x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return FALSE_EASTING + SCALE * RADIUS * x, SCALE * RADIUS * y

    return [conformal, sphere, metres]


def _inverse(zone: int) -> list:
    """The steps from metres to longitude and latitude; four Newton steps for the latitude."""
    e2 = ECCENTRICITY**2

    def angles(x: Column, y: Column) -> tuple[Column, Column]:
        return y / (SCALE * RADIUS), (x - FALSE_EASTING) / (SCALE * RADIUS)

    def sphere(xi: Column, eta: Column) -> tuple[Column, Column]:
        a, b = xi, eta
        for j, k in enumerate(BETA, 1):
            a = a - k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            b = b - k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        return a, b

    def newton(acc: Column, _: Column) -> Column:
        def step(root: Column, have: Column) -> Column:
            tau = acc.tau + (acc.want - have) / F.sqrt(1 + have * have) * (1 + (1 - e2) * acc.tau * acc.tau) / ((1 - e2) * root)
            return F.struct(acc.want.alias("want"), tau.alias("tau"))

        sigma = lambda root: F.sinh(ECCENTRICITY * F.atanh(ECCENTRICITY * acc.tau / root))
        return let(F.sqrt(1 + acc.tau * acc.tau), lambda root: let(sigma(root), lambda s: let(acc.tau * F.sqrt(1 + s * s) - s * root, lambda have: step(root, have))))

    def degrees(a: Column, b: Column) -> tuple[Column, Column]:
        want = F.sin(a) / F.sqrt(F.sinh(b) * F.sinh(b) + F.cos(a) * F.cos(a))
        tau = F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.struct(want.alias("want"), want.alias("tau")), newton, lambda acc: acc.tau)
        return F.degrees(F.atan2(F.sinh(b), F.cos(a))) + central_meridian(zone), F.degrees(F.atan(tau))

    return [angles, sphere, degrees]


def _all(steps: list, x: Column, y: Column) -> tuple[Column, Column]:
    for step in steps:
        x, y = step(x, y)
    return x, y


def to_utm(lon: Column, lat: Column, zone: int = 11) -> tuple[Column, Column]:
    """Easting and northing (northern hemisphere) in metres."""
    return _all(_forward(zone), lon, lat)


def from_utm(x: Column, y: Column, zone: int = 11) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    return _all(_inverse(zone), x, y)


GEOGRAPHIC = 4326
#: The codes of the northern zones are these plus the zone.
NORTH = 32600


def planar(fields: DataFrame, zone: int = 11, geometry: str = "polygons") -> DataFrame:
    """``fields`` with their geometry in metres of the zone, and the column's metadata saying so.

    The geometry is in the system that the column's metadata names as ``srid``; without one it is taken to be in longitude and latitude. What
    is in the zone already stays as it is, what is in another northern zone is brought over by longitude and latitude; other systems are refused.
    """
    srid = fields.schema[geometry].metadata.get("srid", GEOGRAPHIC)
    points = F.col(geometry)
    if srid == GEOGRAPHIC:
        points = project(points, zone)
    elif srid in range(NORTH + 1, NORTH + 61):
        points = points if srid == NORTH + zone else project(unproject(points, srid - NORTH), zone)
    else:
        raise ValueError(f"{geometry} is in the system {srid}, which is neither {GEOGRAPHIC} nor a northern UTM zone")
    return fields.select(*(points.alias(c, metadata={"srid": NORTH + zone}) if c == geometry else F.col(f"`{c}`") for c in fields.columns))


def unproject(polygons: Column, zone: int) -> Column:
    """All points of a geometry from metres to longitude and latitude."""
    return _each(polygons, _inverse(zone))


def project(polygons: Column, zone: int = 11) -> Column:
    """All points of a geometry from longitude and latitude to metres."""
    return _each(polygons, _forward(zone))


def _each(polygons: Column, steps: list) -> Column:
    """Each point moved by the steps, each of whose numbers is computed once: generated code, which finds what is repeated, has no part in a higher-order function."""

    def moved(p: Column, step, *rest) -> Column:
        x, y = step(p.x, p.y)
        to = F.struct(x.alias("x"), y.alias("y"))
        return let(to, lambda v: moved(v, *rest)) if rest else to

    return F.transform(polygons, lambda p: F.transform(p, lambda r: F.transform(r, lambda q: moved(q, *steps))))
