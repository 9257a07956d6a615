"""Map projections and frame shifts as Column expressions, GRS 80."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A, F_INV = 6378137.0, 298.257222101
FLAT = 1 / F_INV
E2 = FLAT * (2 - FLAT)
E1 = math.sqrt(E2)


def _dms(d: float, m: float = 0.0, s: float = 0.0) -> float:
    return math.copysign(abs(d) + m / 60 + s / 3600, d)


def _latitude(chi: Column) -> Column:
    """The latitude of a conformal latitude, by the series in the third flattening to its fourth power."""
    n = FLAT / (2 - FLAT)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return phi


@dataclass(frozen=True)
class TransverseMercator:
    """By the third-order-in-n series of Krueger."""

    lon0: float
    k: float = 0.9996
    east: float = 500000.0
    north: float = 0.0

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        n = FLAT / (2 - FLAT)
        radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
        phi, lam = F.radians(lat), F.radians(lon - self.lon0)
        root = 2 * math.sqrt(n) / (1 + n)
        t = F.sinh(F.atanh(F.sin(phi)) - root * F.atanh(root * F.sin(phi)))
        xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
        east, north = eta, xi
        for j, a in enumerate(alpha, 1):
            east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return self.east + self.k * radius * east, self.north + self.k * radius * north

    def inverse(self, east: Column, north: Column) -> tuple[Column, Column]:
        n = FLAT / (2 - FLAT)
        radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
        xi0, eta0 = (north - self.north) / (self.k * radius), (east - self.east) / (self.k * radius)
        xi, eta = xi0, eta0
        for j, b in enumerate(beta, 1):
            xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
            eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
        chi = F.asin(F.sin(xi) / F.cosh(eta))
        lam = F.atan2(F.sinh(eta), F.cos(xi))
        return self.lon0 + F.degrees(lam), F.degrees(_latitude(chi))


def _t(phi: float) -> float:
    s = E1 * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (E1 / 2)


def _t_column(phi: Column) -> Column:
    s = E1 * F.sin(phi)
    return F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(E1 / 2))


@dataclass(frozen=True)
class LambertTwoParallels:
    lat0: float
    lon0: float
    lat1: float
    lat2: float
    east: float
    north: float

    def _cone(self) -> tuple[float, float, float]:
        m = lambda p: math.cos(p) / math.sqrt(1 - E2 * math.sin(p) ** 2)
        p0, p1, p2 = map(math.radians, (self.lat0, self.lat1, self.lat2))
        n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(_t(p1)) - math.log(_t(p2)))
        f = m(p1) / (n * _t(p1) ** n)
        return n, f, A * f * _t(p0) ** n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        n, f, r0 = self._cone()
        r = A * f * F.pow(_t_column(F.radians(lat)), F.lit(n))
        theta = n * F.radians(lon - self.lon0)
        return self.east + r * F.sin(theta), self.north + r0 - r * F.cos(theta)

    def inverse(self, east: Column, north: Column) -> tuple[Column, Column]:
        n, f, r0 = self._cone()
        x, y = east - self.east, r0 - (north - self.north)
        t = F.pow(F.sqrt(x * x + y * y) / (A * f), F.lit(1 / n))
        return self.lon0 + F.degrees(F.atan2(x, y)) / n, F.degrees(_latitude(math.pi / 2 - 2 * F.atan(t)))


@dataclass(frozen=True)
class ObliqueMercator:
    """Hotine, variant A: false coordinates at the natural origin."""

    lat0: float
    lon0: float
    azimuth: float
    rectified: float
    k: float
    east: float
    north: float

    def _sphere(self) -> tuple[float, float, float, float, float]:
        """b, a, h, the azimuth at the equator, and the longitude where the line crosses it."""
        p0, az = math.radians(self.lat0), math.radians(self.azimuth)
        b = math.sqrt(1 + E2 * math.cos(p0) ** 4 / (1 - E2))
        a = A * b * self.k * math.sqrt(1 - E2) / (1 - E2 * math.sin(p0) ** 2)
        d = max(1.0, b * math.sqrt(1 - E2) / (math.cos(p0) * math.sqrt(1 - E2 * math.sin(p0) ** 2)))
        f = d + math.sqrt(d * d - 1) * math.copysign(1, p0)
        gamma = math.asin(math.sin(az) / d)
        return b, a, f * _t(p0) ** b, gamma, math.radians(self.lon0) - math.asin((f - 1 / f) / 2 * math.tan(gamma)) / b

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        b, a, h, gamma, start = self._sphere()
        turn = math.radians(self.rectified)
        q = h / F.pow(_t_column(F.radians(lat)), F.lit(b))
        s, t = (q - 1 / q) / 2, (q + 1 / q) / 2
        turned = b * (F.radians(lon) - start)
        v = F.sin(turned)
        w = (-v * math.cos(gamma) + s * math.sin(gamma)) / t
        across = a * F.log((1 - w) / (1 + w)) / (2 * b)
        along = a * F.atan2(s * math.cos(gamma) + v * math.sin(gamma), F.cos(turned)) / b
        return self.east + across * math.cos(turn) + along * math.sin(turn), self.north + along * math.cos(turn) - across * math.sin(turn)

    def inverse(self, east: Column, north: Column) -> tuple[Column, Column]:
        b, a, h, gamma, start = self._sphere()
        turn = math.radians(self.rectified)
        x, y = east - self.east, north - self.north
        across, along = x * math.cos(turn) - y * math.sin(turn), y * math.cos(turn) + x * math.sin(turn)
        q = F.exp(-b / a * across)
        s, t = (q - 1 / q) / 2, (q + 1 / q) / 2
        v = F.sin(b / a * along)
        w = (v * math.cos(gamma) + s * math.sin(gamma)) / t
        lat = _latitude(math.pi / 2 - 2 * F.atan(F.pow(h / F.sqrt((1 + w) / (1 - w)), F.lit(1 / b))))
        lon = start - F.atan2(s * math.cos(gamma) - v * math.sin(gamma), F.cos(b / a * along)) / b
        return F.degrees(lon), F.degrees(lat)


#: Projected systems by EPSG code.
PROJECTIONS = {
    **{26900 + zone: TransverseMercator(6.0 * zone - 183) for zone in range(1, 24)},
    **{6329 + zone: TransverseMercator(6.0 * zone - 183) for zone in range(1, 20)},
    3631: LambertTwoParallels(33.75, -79.0, _dms(36, 10), _dms(34, 20), 609601.22, 0.0),
    3673: LambertTwoParallels(_dms(27, 50), -99.0, _dms(30, 17), _dms(28, 23), 600000.0, 4000000.0),
    3495: LambertTwoParallels(_dms(35, 20), -119.0, _dms(37, 15), 36.0, 2000000.0, 500000.0),
    3468: ObliqueMercator(57.0, -_dms(133, 40), _dms(323, 7, 48.3685), _dms(323, 7, 48.3685), 0.9999, 5000000.0, -5000000.0),
}


@dataclass(frozen=True)
class Helmert:
    """Seven parameters, metres, arc seconds and parts per million, with yearly rates from an epoch; coordinate frame."""

    shift: tuple[float, float, float]
    turn: tuple[float, float, float]
    scale: float
    shift_rate: tuple[float, float, float]
    turn_rate: tuple[float, float, float]
    scale_rate: float
    epoch: float

    def at(self, year: float | None) -> tuple[tuple[float, ...], tuple[float, ...], float]:
        dt = 0.0 if year is None else year - self.epoch
        add = lambda a, r: tuple(x + y * dt for x, y in zip(a, r))
        arc = math.pi / 180 / 3600
        return add(self.shift, self.shift_rate), tuple(x * arc for x in add(self.turn, self.turn_rate)), 1 + (self.scale + self.scale_rate * dt) * 1e-6


#: From the ITRF realisations to NAD83(2011).
TO_NAD83 = {
    "ITRF2008": Helmert((0.99343, -1.90331, -0.52655), (0.02591467, 0.00942645, 0.01159935), 0.00171504, (0.00079, -0.0006, -0.00134), (6.667e-05, -0.00075744, -5.133e-05), -0.00010201, 1997.0),
    "ITRF2014": Helmert((1.0053, -1.9092, -0.5416), (0.0267814, -0.0004203, 0.0109321), 0.00037, (0.0008, -0.0006, -0.0014), (6.67e-05, -0.0007574, -5.13e-05), -7e-05, 2010.0),
}


def to_cartesian(lon: Column, lat: Column, h: Column) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    return (n + h) * F.cos(phi) * F.cos(lam), (n + h) * F.cos(phi) * F.sin(lam), (n * (1 - E2) + h) * F.sin(phi)


def from_cartesian(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Bowring's start and one repetition: exact to well below a millimetre on and near the ground."""
    b = A * (1 - FLAT)
    p = F.sqrt(x * x + y * y)
    beta = F.atan2(z * A, p * b)
    phi = None
    for _ in range(2):
        phi = F.atan2(z + E2 / (1 - E2) * b * F.pow(F.sin(beta), F.lit(3.0)), p - E2 * A * F.pow(F.cos(beta), F.lit(3.0)))
        beta = F.atan((1 - FLAT) * F.tan(phi))
    n = A / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    h = p * F.cos(phi) + z * F.sin(phi) - A * A / n
    return F.degrees(F.atan2(y, x)), F.degrees(phi), h


def frame_shift(x: Column, y: Column, z: Column, frame: str, to_nad83: bool, year: float | None = None) -> tuple[Column, Column, Column]:
    """Cartesian shift between an ITRF realisation and NAD83(2011); the way back solves the small rotation exactly to first order."""
    (tx, ty, tz), (rx, ry, rz), k = TO_NAD83[frame].at(year)
    if to_nad83:
        return tx + k * (x + rz * y - ry * z), ty + k * (-rz * x + y + rx * z), tz + k * (ry * x - rx * y + z)
    x, y, z = (x - tx) / k, (y - ty) / k, (z - tz) / k
    return x - rz * y + ry * z, rz * x + y - rx * z, -ry * x + rx * y + z


#: Geographic systems and the frame they are in; projected ones are all in NAD83.
FRAMES = {6318: "NAD83(2011)", 6319: "NAD83(2011)", 8999: "ITRF2008", 7911: "ITRF2008", 9000: "ITRF2014", 7912: "ITRF2014"}
NAD83 = "NAD83(2011)"


def frame_of(epsg: int) -> str:
    """Of a geographic or projected system; realisations of NAD83 count as one."""
    if epsg not in FRAMES and epsg not in PROJECTIONS:
        raise NotImplementedError(f"no parameters for EPSG {epsg}")
    return FRAMES.get(epsg, NAD83)


def geographic(epsg: int, x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of coordinates of a system, in its own frame."""
    frame_of(epsg)
    return PROJECTIONS[epsg].inverse(x, y) if epsg in PROJECTIONS else (x, y)


def projected(epsg: int, lon: Column, lat: Column) -> tuple[Column, Column]:
    frame_of(epsg)
    return PROJECTIONS[epsg].forward(lon, lat) if epsg in PROJECTIONS else (lon, lat)


def add_geographic(df: DataFrame, out: str, epsg: int, x: Column, y: Column, h: Column, frame: str, year: float | None = None) -> DataFrame:
    """df with a struct out of x, y, h: longitude, latitude and ellipsoid height in a frame, of coordinates of a system.

    Two ITRF realisations meet by way of NAD83. What is used often is a column of its own, so that no expression grows by
    being repeated; df must have no column that begins with out.
    """
    lon, lat = geographic(epsg, x, y)
    own, geo = frame_of(epsg), F.struct(lon.alias("x"), lat.alias("y"), h.alias("h"))
    if own == frame:
        return df.withColumn(out, geo)
    df = df.withColumn(f"{out}_own", geo)
    at = F.col(f"{out}_own")
    xyz = to_cartesian(at["x"], at["y"], at["h"])
    for source, to_nad83 in ((own, True), (frame, False)):
        if source != NAD83:
            df = df.withColumn(f"{out}_{to_nad83}", F.struct(*[c.alias(n) for c, n in zip(frame_shift(*xyz, source, to_nad83, year), "xyz")]))
            xyz = tuple(F.col(f"{out}_{to_nad83}")[n] for n in "xyz")
    drop = [c for c in df.columns if c.startswith(f"{out}_")]
    return df.withColumn(out, F.struct(*[c.alias(n) for c, n in zip(from_cartesian(*xyz), "xyh")])).drop(*drop)
