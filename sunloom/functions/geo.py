"""Map projections and the sun's position as Column expressions (published closed forms).

OSGB <-> longitude/latitude: transverse Mercator series on Airy 1830 and the
seven-parameter Helmert shift (good to a few metres).  Geostationary: the
satellite view of PROJ's `geos`, sweep y.  Sun: the short almanac series (good to
some thousandths of a degree).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_WGS84, _AIRY = (6378137.0, 6356752.314245), (6377563.396, 6356256.909)
_SHIFT, _SCALE, _TURN = (-446.448, 125.157, -542.060), 20.4894e-6, tuple(math.radians(x / 3600) for x in (-0.1502, -0.2470, -0.8421))
_F0, _LAT0, _LON0, _E0, _N0 = 0.9996012717, math.radians(49), math.radians(-2), 400000.0, -100000.0


def _let(values: tuple[Column, ...], f) -> tuple[Column, Column]:
    """f's pair of columns of the values, each evaluated once, so that repeated steps don't multiply the expression."""
    names = [f"v{k}" for k in range(len(values))]

    def step(s: Column) -> Column:
        a, b = f(*(s[n] for n in names))
        return F.struct(a.alias("a"), b.alias("b"))

    out = F.element_at(F.transform(F.array(F.struct(*(v.alias(n) for v, n in zip(values, names, strict=True)))), step), 1)
    return out["a"], out["b"]


def _to_xyz(lat: Column, lon: Column, axes: tuple[float, float]) -> tuple[Column, Column, Column]:
    a, b = axes
    e2 = 1 - (b / a) ** 2
    nu = F.lit(a) / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return nu * F.cos(lat) * F.cos(lon), nu * F.cos(lat) * F.sin(lon), nu * (1 - e2) * F.sin(lat)


def _to_lat_lon(x: Column, y: Column, z: Column, axes: tuple[float, float]) -> tuple[Column, Column]:
    a, b = axes
    e2 = 1 - (b / a) ** 2
    p = F.sqrt(x * x + y * y)
    lat = F.atan2(z, p * (1 - e2))
    for _ in range(4):
        lat, _same = _let((lat, z, p), lambda t, z, p: (F.atan2(z + e2 * F.lit(a) / F.sqrt(1 - e2 * F.sin(t) * F.sin(t)) * F.sin(t), p), t))
    return lat, F.atan2(y, x)


def _shifted(lat: Column, lon: Column, source: tuple[float, float], target: tuple[float, float], sign: int) -> tuple[Column, Column]:
    """(lat, lon) in radians on another datum."""

    def turned(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
        u, v, w = _helmert(x, y, z, sign)
        return _let((u, v, w), lambda u, v, w: _to_lat_lon(u, v, w, target))

    return _let((lat, lon), lambda a, o: _let(_to_xyz(a, o, source), turned))


def _helmert(x: Column, y: Column, z: Column, sign: int) -> tuple[Column, Column, Column]:
    (tx, ty, tz), s, (rx, ry, rz) = (tuple(sign * t for t in _SHIFT), sign * _SCALE, tuple(sign * r for r in _TURN))
    return tx + (1 + s) * x - rz * y + ry * z, ty + rz * x + (1 + s) * y - rx * z, tz - ry * x + rx * y + (1 + s) * z


def _arc(lat: Column) -> Column:
    a, b = _AIRY
    n = (a - b) / (a + b)
    d, s = lat - _LAT0, lat + _LAT0
    return F.lit(b * _F0) * ((1 + n + 1.25 * n**2 + 1.25 * n**3) * d - (3 * n + 3 * n**2 + 2.625 * n**3) * F.sin(d) * F.cos(s) + (1.875 * n**2 + 1.875 * n**3) * F.sin(2 * d) * F.cos(2 * s) - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * s))


def lon_lat_to_osgb(lon: Column, lat: Column, datum_shift: bool = True) -> tuple[Column, Column]:
    """National Grid (x, y) in metres of WGS84 degrees (of Airy degrees without the datum shift)."""
    lat, lon = F.radians(lat), F.radians(lon)
    if datum_shift:
        lat, lon = _shifted(lat, lon, _WGS84, _AIRY, 1)
    return _let((lat, lon), _to_grid)


def _to_grid(lat: Column, lon: Column) -> tuple[Column, Column]:
    a, b = _AIRY
    e2 = 1 - (b / a) ** 2
    s, c = F.sin(lat), F.cos(lat)
    nu = F.lit(a * _F0) / F.sqrt(1 - e2 * s * s)
    rho = F.lit(a * _F0 * (1 - e2)) / F.pow(1 - e2 * s * s, F.lit(1.5))
    eta = nu / rho - 1
    t2, d = F.tan(lat) * F.tan(lat), lon - _LON0
    y = _arc(lat) + _N0 + nu / 2 * s * c * d**2 + nu / 24 * s * c**3 * (5 - t2 + 9 * eta) * d**4 + nu / 720 * s * c**5 * (61 - 58 * t2 + t2 * t2) * d**6
    x = _E0 + nu * c * d + nu / 6 * c**3 * (nu / rho - t2) * d**3 + nu / 120 * c**5 * (5 - 18 * t2 + t2 * t2 + 14 * eta - 58 * t2 * eta) * d**5
    return x, y


def osgb_to_lon_lat(x: Column, y: Column, datum_shift: bool = True) -> tuple[Column, Column]:
    """WGS84 (longitude, latitude) in degrees of National Grid metres."""
    a, _b = _AIRY
    lat = (y - _N0) / (a * _F0) + _LAT0
    for _ in range(4):
        lat, _same = _let((lat, y), lambda t, y: (t + (y - _N0 - _arc(t)) / (a * _F0), t))
    lat, lon = _let((lat, x), _from_grid)
    if datum_shift:
        lat, lon = _shifted(lat, lon, _AIRY, _WGS84, -1)
    return F.degrees(lon), F.degrees(lat)


def _from_grid(lat: Column, x: Column) -> tuple[Column, Column]:
    a, b = _AIRY
    e2 = 1 - (b / a) ** 2
    s, t = F.sin(lat), F.tan(lat)
    nu = F.lit(a * _F0) / F.sqrt(1 - e2 * s * s)
    rho = F.lit(a * _F0 * (1 - e2)) / F.pow(1 - e2 * s * s, F.lit(1.5))
    eta, sec, d, t2 = nu / rho - 1, 1 / F.cos(lat), x - _E0, t * t
    out_lat = lat - t / (2 * rho * nu) * d**2 + t / (24 * rho * nu**3) * (5 + 3 * t2 + eta - 9 * t2 * eta) * d**4 - t / (720 * rho * nu**5) * (61 + 90 * t2 + 45 * t2 * t2) * d**6
    out_lon = _LON0 + sec / nu * d - sec / (6 * nu**3) * (nu / rho + 2 * t2) * d**3 + sec / (120 * nu**5) * (5 + 28 * t2 + 24 * t2 * t2) * d**5
    return out_lat, out_lon


@dataclass(frozen=True)
class Area:
    """Parameters of a geostationary view."""

    height: float = 35785831.0
    a: float = 6378169.0
    rf: float = 295.488065897014
    lon_0: float = 9.5

    @staticmethod
    def parse(text: str | None) -> Area:
        """From an area description with the keys h, a, rf (or b) and lon_0; without one there is no projection."""
        if not text:
            raise ValueError("a geostationary projection needs its area")
        found = {m[1]: float(m[2]) for m in re.finditer(r"(?<![\w.])\+?(h|a|b|rf|lon_0)\s*[:=]\s*'?([-+\d.eE]+)", text)}
        a = found.get("a", 6378137.0)
        rf = found.get("rf") or (a / (a - found["b"]) if "b" in found else 298.257223563)
        return Area(found.get("h", 35785831.0), a, rf, found.get("lon_0", 0.0))


def lon_lat_to_geostationary(lon: Column, lat: Column, area: Area) -> tuple[Column, Column]:
    """(x, y) in metres on the view, null where the point can't be seen."""
    f = 1 / area.rf
    rp2 = 1 - f * (2 - f)
    dl, p = F.radians(lon - area.lon_0), F.atan(rp2 * F.tan(F.radians(lat)))
    r = math.sqrt(rp2) / F.sqrt(rp2 * F.cos(p) * F.cos(p) + F.sin(p) * F.sin(p))
    vx, vy, vz = r * F.cos(dl) * F.cos(p), r * F.sin(dl) * F.cos(p), r * F.sin(p)
    t = F.lit(1 + area.height / area.a) - vx
    seen = t * vx - vy * vy - vz * vz / rp2 >= 0
    return F.when(seen, area.height * F.atan(vy / t)), F.when(seen, area.height * F.atan(vz / F.sqrt(vy * vy + t * t)))


def convert(x: Column, y: Column, source: str, target: str, area: str | None = None) -> tuple[Column, Column]:
    """Coordinates of one system in another: lon_lat, osgb, geostationary (as a target only)."""
    match source, target:
        case (a, b) if a == b:
            return x, y
        case "osgb", "lon_lat":
            return osgb_to_lon_lat(x, y)
        case "lon_lat", "osgb":
            return lon_lat_to_osgb(x, y)
        case "lon_lat", "geostationary":
            return lon_lat_to_geostationary(x, y, Area.parse(area))
        case "osgb", "geostationary":
            return lon_lat_to_geostationary(*osgb_to_lon_lat(x, y), Area.parse(area))
        case _:
            raise NotImplementedError(f"no conversion from {source} to {target}")


@dataclass
class Location:
    """A place with its coordinates in one or more systems."""

    id: int
    coords: dict[str, tuple[float, float]]

    SYSTEMS = ("lon_lat", "osgb", "geostationary")

    def __post_init__(self):
        for system in self.coords:
            self._known(system)

    def _known(self, system: str) -> None:
        if system not in self.SYSTEMS:
            raise ValueError(f"unknown coordinate system {system!r}")

    def in_coord_system(self, system: str) -> tuple[float, float]:
        """(x, y) in a system that was added."""
        self._known(system)
        if system not in self.coords:
            raise ValueError(f"location {self.id} has no coordinates in {system}")
        return self.coords[system]

    def add_coord_system(self, x: float, y: float, system: str) -> None:
        """Adds coordinates; other ones for a system that is there already are an error."""
        self._known(system)
        if self.coords.get(system, (x, y)) != (x, y):
            raise ValueError(f"location {self.id} has other coordinates in {system}")
        self.coords[system] = (x, y)


def find_coord_system(names: list[str]) -> str:
    """The one coordinate system whose axes are among the names."""
    pairs = {"lon_lat": ("longitude", "latitude"), "geostationary": ("x_geostationary", "y_geostationary"), "osgb": ("x_osgb", "y_osgb")}
    found = [k for k, axes in pairs.items() if all(a in names for a in axes)]
    if len(found) != 1:
        raise ValueError(f"expected the axes of one coordinate system, found {found}")
    return found[0]


def solar_position(ts: Column, lon: Column, lat: Column) -> tuple[Column, Column]:
    """(azimuth, elevation) of the sun in degrees, without refraction."""
    day = F.unix_micros(ts.cast("timestamp")) / F.lit(86_400_000_000.0)
    t = (day + 2440587.5 - 2451545.0) / 36525.0
    mean_lon = F.pmod(280.46646 + t * (36000.76983 + t * 0.0003032), F.lit(360.0))
    anomaly = F.radians(357.52911 + t * (35999.05029 - 0.0001537 * t))
    ecc = 0.016708634 - t * (0.000042037 + 0.0000001267 * t)
    centre = F.sin(anomaly) * (1.914602 - t * (0.004817 + 0.000014 * t)) + F.sin(2 * anomaly) * (0.019993 - 0.000101 * t) + F.sin(3 * anomaly) * 0.000289
    node = F.radians(125.04 - 1934.136 * t)
    apparent = F.radians(mean_lon + centre - 0.00569 - 0.00478 * F.sin(node))
    tilt = F.radians(23.0 + (26.0 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60.0) / 60.0 + 0.00256 * F.cos(node))
    declination = F.asin(F.sin(tilt) * F.sin(apparent))
    y, l0 = F.tan(tilt / 2) * F.tan(tilt / 2), F.radians(mean_lon)
    equation = 4 * F.degrees(y * F.sin(2 * l0) - 2 * ecc * F.sin(anomaly) + 4 * ecc * y * F.sin(anomaly) * F.cos(2 * l0) - 0.5 * y * y * F.sin(4 * l0) - 1.25 * ecc * ecc * F.sin(2 * anomaly))
    minute = (day - F.floor(day)) * 1440.0
    hour = F.radians(F.pmod(minute + equation + 4 * lon, F.lit(1440.0)) / 4 - 180.0)
    phi = F.radians(lat)
    up = F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour)
    east, north = -F.cos(declination) * F.sin(hour), F.sin(declination) * F.cos(phi) - F.cos(declination) * F.sin(phi) * F.cos(hour)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0)), F.degrees(F.asin(F.least(F.greatest(up, F.lit(-1.0)), F.lit(1.0))))


def solar_normalised(ts: Column, lon: Column, lat: Column) -> tuple[Column, Column]:
    azimuth, elevation = solar_position(ts, lon, lat)
    return azimuth / 360, elevation / 180 + 0.5
