"""Coordinate reference systems: definitions, and map projections as formulas.

Closed forms follow Snyder, *Map Projections - A Working Manual* (USGS
Professional Paper 1395). ``forward`` and ``inverse`` work on Spark columns and
on numbers alike; points that a projection cannot show become missing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from gridloom.functions.mathx import COLUMNS, NUMBERS, RAD, world

# Ellipsoids, by semi-major axis and inverse flattening (0: sphere).
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563),
    "WGS72": (6378135.0, 298.26),
    "GRS80": (6378137.0, 298.257222101),
    "bessel": (6377397.155, 299.1528128),
    "clrk66": (6378206.4, 294.9786982),
    "clrk80": (6378249.145, 293.4663),
    "intl": (6378388.0, 297.0),
    "krass": (6378245.0, 298.3),
    "airy": (6377563.396, 299.3249646),
    "sphere": (6370997.0, 0.0),
}

# Registry codes as definitions.
EPSG = {
    4326: "+proj=longlat +datum=WGS84",
    4258: "+proj=longlat +ellps=GRS80",
    3857: "+proj=merc +a=6378137 +b=6378137",
    3395: "+proj=merc +datum=WGS84",
    3035: "+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +ellps=GRS80",
    3031: "+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=0 +datum=WGS84",
    3411: "+proj=stere +lat_0=90 +lat_ts=70 +lon_0=-45 +a=6378273 +b=6356889.449",
    3412: "+proj=stere +lat_0=-90 +lat_ts=-70 +lon_0=0 +a=6378273 +b=6356889.449",
    3413: "+proj=stere +lat_0=90 +lat_ts=70 +lon_0=-45 +datum=WGS84",
    3408: "+proj=laea +lat_0=90 +lon_0=0 +a=6371228 +b=6371228",
    3409: "+proj=laea +lat_0=-90 +lon_0=0 +a=6371228 +b=6371228",
    6931: "+proj=laea +lat_0=90 +lon_0=0 +datum=WGS84",
    6932: "+proj=laea +lat_0=-90 +lon_0=0 +datum=WGS84",
}

_TEXT = {"proj", "datum", "ellps", "units", "sweep", "o_proj", "type", "pm", "title", "axis", "towgs84", "nadgrids", "geoidgrids"}


def parse_proj(text: str) -> dict:
    """``+key=value`` text as a dict; numbers become floats, bare keys True."""
    out: dict = {}
    for part in text.replace("+", " ").split():
        key, _, value = part.partition("=")
        out[key] = _number(key, value) if value else True
    return out


def _number(key: str, value):
    if key in _TEXT and key != "pm" or not isinstance(value, str):
        return value
    try:
        return float(value)
    except ValueError:
        return value


def format_proj(params: dict) -> str:
    """The inverse of ``parse_proj``, keys sorted behind the projection's."""
    keys = sorted(params, key=lambda k: (k != "proj", k))
    show = lambda v: "" if v is True else f"={v:g}" if isinstance(v, float) and float(f"{v:g}") == v else f"={v!r}" if isinstance(v, float) else f"={v}"
    return " ".join(f"+{k}{show(params[k])}" for k in keys)


@dataclass(frozen=True)
class Crs:
    """A projection and its parameters; equal if those are."""

    params: tuple[tuple[str, object], ...]
    a: float = field(compare=False, default=0.0)
    b: float = field(compare=False, default=0.0)

    @staticmethod
    def of(definition) -> "Crs":
        """From a Crs, a dict, a ``+proj`` text, an EPSG number or ``EPSG:n``."""
        if isinstance(definition, Crs):
            return definition
        if isinstance(definition, (int, np.integer)) or isinstance(definition, str) and definition.upper().startswith("EPSG:"):
            code = int(str(definition).split(":")[-1])
            if 32601 <= code <= 32660 or 32701 <= code <= 32760:
                definition = f"+proj=utm +zone={code % 100} +datum=WGS84" + (" +south" if code > 32700 else "")
            elif code in EPSG:
                definition = EPSG[code]
            else:
                raise ValueError(f"no definition for EPSG:{code}")
        params = parse_proj(definition) if isinstance(definition, str) else {str(k).lstrip("+"): _number(str(k).lstrip("+"), v) for k, v in dict(definition).items()}
        params = {k: float(v) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else v for k, v in params.items() if v is not None and k not in ("no_defs", "wktext", "type", "title")}
        for code in ("init", "EPSG", "epsg"):
            if code in params:
                return Crs.of("EPSG:" + str(int(float(str(params[code]).lower().replace("epsg:", "")))))
        if "proj" not in params:
            raise ValueError(f"a definition without a projection: {definition!r}")
        if params["proj"] in ("latlong", "latlon", "lonlat", "longlat", "latlng"):
            params["proj"] = "longlat"
        if params["proj"] not in PROJECTIONS:
            raise ValueError(f"unknown projection {params['proj']!r}")
        a, b = _axes(params)
        return Crs(tuple(sorted(params.items(), key=lambda p: p[0])), a, b)

    def get(self, key: str, default=0.0):
        return dict(self.params).get(key, default)

    @property
    def name(self) -> str:
        return self.get("proj")

    @property
    def geographic(self) -> bool:
        return self.name == "longlat" or self.name == "ob_tran" and self.get("o_proj") in ("longlat", "latlong", "lonlat")

    @property
    def units(self) -> str:
        return "degrees" if self.geographic else str(self.get("units", "m"))

    @property
    def e2(self) -> float:
        return 1 - (self.b / self.a) ** 2

    def to_proj(self) -> str:
        return format_proj(dict(self.params))

    def with_params(self, **more) -> "Crs":
        return Crs.of(dict(self.params) | more)

    def same_as(self, other: "Crs") -> bool:
        """Equal numbers, whatever names the ellipsoid goes by."""
        skip = {"ellps", "datum", "a", "b", "rf", "R", "f", "units"}
        own, their = ({k: v for k, v in dict(c.params).items() if k not in skip and v not in (0, 0.0)} for c in (self, other))
        return own == their and math.isclose(self.a, other.a, rel_tol=1e-12) and math.isclose(self.b, other.b, rel_tol=1e-9)

    def forward(self, lon, lat):
        """Projection coordinates (degrees for geographic systems) of degrees."""
        m = world(lon)
        if m is NUMBERS:
            lon, lat = np.asarray(lon, float), np.asarray(lat, float)
        with np.errstate(all="ignore"):
            x, y = PROJECTIONS[self.name][0](self, m, lon, lat)
        scale = 0.001 if self.get("units", "m") == "km" and not self.geographic else 1.0
        return (x * scale, y * scale) if scale != 1 else (x, y)

    def inverse(self, x, y):
        """Degrees of projection coordinates."""
        m = world(x)
        if m is NUMBERS:
            x, y = np.asarray(x, float), np.asarray(y, float)
        if self.get("units", "m") == "km" and not self.geographic:
            x, y = x * 1000.0, y * 1000.0
        with np.errstate(all="ignore"):
            return PROJECTIONS[self.name][1](self, m, x, y)


def _axes(p: dict) -> tuple[float, float]:
    if "R" in p:
        return float(p["R"]), float(p["R"])
    if "a" in p:
        a = float(p["a"])
        if "b" in p:
            return a, float(p["b"])
        if p.get("rf"):
            return a, a * (1 - 1 / float(p["rf"]))
        if "f" in p:
            return a, a * (1 - float(p["f"]))
        if "ellps" not in p:
            return a, a
    name = p.get("ellps") or {"WGS84": "WGS84", "NAD83": "GRS80", "NAD27": "clrk66", "ETRS89": "GRS80"}.get(p.get("datum"), "WGS84")
    if name not in ELLIPSOIDS:
        raise ValueError(f"unknown ellipsoid {name!r}")
    a, rf = ELLIPSOIDS[name]
    return a, a * (1 - 1 / rf) if rf else a


def _lam(c: Crs, m, lon, key: str = "lon_0"):
    """Radians east of the central meridian, in [-pi, pi)."""
    return m.pmod(lon - float(c.get(key)) + 180.0, 360.0) * RAD - math.pi


def _lon(c: Crs, m, lam, key: str = "lon_0"):
    return m.pmod(lam / RAD + float(c.get(key)) + 180.0, 360.0) - 180.0


def _move(c: Crs, x, y):
    return x + float(c.get("x_0")), y + float(c.get("y_0"))


def _back(c: Crs, x, y):
    return x - float(c.get("x_0")), y - float(c.get("y_0"))


def _ts(m, e: float, phi):
    """Snyder (15-9): tangent of half the conformal colatitude."""
    s = m.sin(phi)
    t = m.tan(math.pi / 4 - phi / 2)
    return t if not e else t / m.power((1 - s * e) / (1 + s * e), e / 2)


def _phi_of_chi(m, e: float, chi):
    """Latitude of a conformal latitude: Krueger's series in the third flattening, summed as a polynomial in cos(2 chi).

    ``chi`` is named six times, once a round would be two to the number of rounds.
    """
    if not e:
        return chi
    f = 1 - math.sqrt(1 - e * e)
    n = f / (2 - f)
    d2 = 2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45
    d4 = 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45
    d6 = 56 * n**3 / 15 - 136 * n**4 / 35
    d8 = 4279 * n**4 / 630
    # sin(4x) = 2 sin(2x) c, sin(6x) = sin(2x) (4 c^2 - 1), sin(8x) = sin(2x) (8 c^3 - 4 c) with c = cos(2x)
    c = m.cos(chi * 2)
    return chi + m.sin(chi * 2) * (((c * (8 * d8) + 4 * d6) * c + (2 * d4 - 4 * d8)) * c + (d2 - d6))


def _phi_of_ts(m, e: float, t):
    return _phi_of_chi(m, e, math.pi / 2 - m.atan(t) * 2)


def _q(m, e: float, phi):
    """Snyder (3-12)."""
    s = m.sin(phi)
    if not e:
        return s * 2
    return (s / (1 - s * s * (e * e)) - m.log((1 - s * e) / (1 + s * e)) / (2 * e)) * (1 - e * e)


def _phi_of_beta(m, e2: float, beta):
    """Snyder (3-18): latitude of an authalic latitude."""
    return (
        beta
        + m.sin(beta * 2) * (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040)
        + m.sin(beta * 4) * (23 * e2**2 / 360 + 251 * e2**3 / 3780)
        + m.sin(beta * 6) * (761 * e2**3 / 45360)
    )


def _mm(e2: float, phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)


def _longlat(c, m, lon, lat):
    return wrap_at(m, lon - float(c.get("pm"))), lat


def _longlat_inverse(c, m, x, y):
    return wrap_at(m, x + float(c.get("pm"))), y


def wrap_at(m, lon):
    """Into [-180, 180]; degrees inside stay bit for bit."""
    inside = (lon >= -180.0) & (lon <= 180.0)
    return m.where(inside, lon, m.pmod(lon + 180.0, 360.0) - 180.0)


def _merc_k(c) -> float:
    return _mm(c.e2, float(c.get("lat_ts")) * RAD) if c.get("lat_ts") else float(c.get("k_0", c.get("k", 1.0)))


def _merc(c, m, lon, lat):
    e, k = math.sqrt(c.e2), _merc_k(c) * c.a
    phi = m.only(m.abs(lat) < 90.0, lat) * RAD
    return _move(c, _lam(c, m, lon) * k, m.log(_ts(m, e, phi)) * -k)


def _merc_inverse(c, m, x, y):
    x, y = _back(c, x, y)
    k = _merc_k(c) * c.a
    return _lon(c, m, x / k), _phi_of_ts(m, math.sqrt(c.e2), m.exp(y / -k)) / RAD


def _eqc(c, m, lon, lat):
    k = math.cos(float(c.get("lat_ts")) * RAD) * c.a
    return _move(c, _lam(c, m, lon) * k, (lat - float(c.get("lat_0"))) * (RAD * c.a))


def _eqc_inverse(c, m, x, y):
    x, y = _back(c, x, y)
    k = math.cos(float(c.get("lat_ts")) * RAD) * c.a
    return _lon(c, m, x / k), y / (RAD * c.a) + float(c.get("lat_0"))


def _stere_polar_scale(c) -> float:
    e, e2 = math.sqrt(c.e2), c.e2
    ts = abs(float(c.get("lat_ts", 90.0))) * RAD
    if abs(ts - math.pi / 2) < 1e-10:
        return 2 * c.a * float(c.get("k_0", c.get("k", 1.0))) / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
    return c.a * _mm(e2, ts) / float(_ts(NUMBERS, e, ts))


def _conformal(m, e, phi):
    return math.pi / 2 - m.atan(_ts(m, e, phi)) * 2


def _stere(c, m, lon, lat):
    e, lat_0 = math.sqrt(c.e2), float(c.get("lat_0"))
    lam = _lam(c, m, lon)
    if abs(abs(lat_0) - 90) < 1e-9:
        s = 1.0 if lat_0 > 0 else -1.0
        rho = _ts(m, e, m.only(lat * s > -90.0, lat) * (RAD * s)) * _stere_polar_scale(c)
        return _move(c, rho * m.sin(lam), rho * m.cos(lam) * -s)
    phi1 = lat_0 * RAD
    chi1, chi = float(_conformal(NUMBERS, e, phi1)), _conformal(m, e, lat * RAD)
    k = 2 * c.a * float(c.get("k_0", c.get("k", 1.0))) * _mm(c.e2, phi1) / math.cos(chi1)
    below = m.sin(chi) * math.sin(chi1) + m.cos(chi) * m.cos(lam) * math.cos(chi1) + 1
    scale = m.div(k, m.only(below > 1e-10, below))
    return _move(c, scale * m.cos(chi) * m.sin(lam), scale * (m.sin(chi) * math.cos(chi1) - m.cos(chi) * m.cos(lam) * math.sin(chi1)))


def _stere_inverse(c, m, x, y):
    x, y = _back(c, x, y)
    e, lat_0 = math.sqrt(c.e2), float(c.get("lat_0"))
    if abs(abs(lat_0) - 90) < 1e-9:
        s = 1.0 if lat_0 > 0 else -1.0
        phi = _phi_of_ts(m, e, m.hypot(x, y) / _stere_polar_scale(c)) * s
        return _lon(c, m, m.atan2(x, y * -s)), phi / RAD
    phi1 = lat_0 * RAD
    chi1 = float(_conformal(NUMBERS, e, phi1))
    half = math.cos(chi1) / (2 * c.a * float(c.get("k_0", c.get("k", 1.0))) * _mm(c.e2, phi1))
    u, v = x * half, y * half  # tangents of half the angle from the centre
    square = u * u + v * v
    chi = m.asin(m.clip(((1 - square) * math.sin(chi1) + v * (2 * math.cos(chi1))) / (1 + square), -1, 1))
    lam = m.atan2(u * 2, (1 - square) * math.cos(chi1) - v * (2 * math.sin(chi1)))
    return _lon(c, m, lam), _phi_of_chi(m, e, chi) / RAD


def _laea(c, m, lon, lat):
    e2, lat_0 = c.e2, float(c.get("lat_0"))
    e, lam = math.sqrt(e2), _lam(c, m, lon)
    qp, q = float(_q(NUMBERS, e, math.pi / 2)), _q(m, e, lat * RAD)
    if abs(abs(lat_0) - 90) < 1e-9:
        s = 1.0 if lat_0 > 0 else -1.0
        rho = m.sqrt(m.clip(qp - q * s, 0, 2 * qp)) * c.a
        return _move(c, rho * m.sin(lam), rho * m.cos(lam) * -s)
    rq, phi1 = c.a * math.sqrt(qp / 2), lat_0 * RAD
    beta1, beta = math.asin(max(-1, min(1, float(_q(NUMBERS, e, phi1)) / qp))), m.asin(m.clip(q / qp, -1, 1))
    d = c.a * _mm(e2, phi1) / (rq * math.cos(beta1))
    below = m.sin(beta) * math.sin(beta1) + m.cos(beta) * m.cos(lam) * math.cos(beta1) + 1
    b = m.sqrt(m.div(2.0, m.only(below > 1e-10, below))) * rq
    return _move(c, b * m.cos(beta) * m.sin(lam) * d, b * (m.sin(beta) * math.cos(beta1) - m.cos(beta) * m.cos(lam) * math.sin(beta1)) / d)


def _laea_inverse(c, m, x, y):
    x, y = _back(c, x, y)
    e2, lat_0 = c.e2, float(c.get("lat_0"))
    e = math.sqrt(e2)
    qp = float(_q(NUMBERS, e, math.pi / 2))
    if abs(abs(lat_0) - 90) < 1e-9:
        s = 1.0 if lat_0 > 0 else -1.0
        share = (x * x + y * y) / (c.a**2 * qp)
        beta = m.asin(m.only(share <= 2.0, 1 - share)) * s
        return _lon(c, m, m.atan2(x, y * -s)), _phi_of_beta(m, e2, beta) / RAD
    rq, phi1 = c.a * math.sqrt(qp / 2), lat_0 * RAD
    beta1 = math.asin(max(-1, min(1, float(_q(NUMBERS, e, phi1)) / qp)))
    d = c.a * _mm(e2, phi1) / (rq * math.cos(beta1))
    rho = m.hypot(x / d, y * d)
    half = rho / (2 * rq)
    ce = m.asin(m.only(half <= 1.0, half)) * 2
    safe = m.where(rho > 0, rho, 1.0)
    sin_beta = m.where(rho > 0, m.cos(ce) * math.sin(beta1) + y * d * m.sin(ce) * math.cos(beta1) / safe, math.sin(beta1))
    lam = m.atan2(x * m.sin(ce), rho * m.cos(ce) * (d * math.cos(beta1)) - y * m.sin(ce) * (d * d * math.sin(beta1)))
    return _lon(c, m, lam), _phi_of_beta(m, e2, m.asin(m.clip(sin_beta, -1, 1))) / RAD


def _lcc_constants(c):
    e2 = c.e2
    e = math.sqrt(e2)
    lat_1 = float(c.get("lat_1", c.get("lat_0")))
    lat_2 = float(c.get("lat_2", lat_1))
    lat_0 = float(c.get("lat_0", lat_1))
    p1, p2 = lat_1 * RAD, lat_2 * RAD
    m1, m2, t1, t2 = _mm(e2, p1), _mm(e2, p2), float(_ts(NUMBERS, e, p1)), float(_ts(NUMBERS, e, p2))
    n = math.sin(p1) if abs(lat_1 - lat_2) < 1e-9 else (math.log(m1) - math.log(m2)) / (math.log(t1) - math.log(t2))
    f = m1 / (n * t1**n) * c.a * float(c.get("k_0", c.get("k", 1.0)))
    rho0 = 0.0 if abs(abs(lat_0) - 90) < 1e-9 else f * float(_ts(NUMBERS, e, lat_0 * RAD)) ** n
    return e, n, f, rho0


def _lcc(c, m, lon, lat):
    e, n, f, rho0 = _lcc_constants(c)
    s = 1.0 if n > 0 else -1.0
    rho = m.power(_ts(m, e, m.only(lat * s > -90.0, lat) * RAD), n) * f
    theta = _lam(c, m, lon) * n
    return _move(c, rho * m.sin(theta), rho0 - rho * m.cos(theta))


def _lcc_inverse(c, m, x, y):
    x, y = _back(c, x, y)
    e, n, f, rho0 = _lcc_constants(c)
    s = 1.0 if n > 0 else -1.0
    rho = m.hypot(x, rho0 - y) * s
    t = m.power(m.abs(rho) / abs(f), 1 / n)
    return _lon(c, m, m.atan2(x * s, (rho0 - y) * s) / n), _phi_of_ts(m, e, t) / RAD


def _aea_constants(c):
    e2 = c.e2
    e = math.sqrt(e2)
    p1, p2 = float(c.get("lat_1")) * RAD, float(c.get("lat_2", c.get("lat_1"))) * RAD
    q = lambda p: float(_q(NUMBERS, e, p))
    m1, m2 = _mm(e2, p1), _mm(e2, p2)
    n = math.sin(p1) if abs(p1 - p2) < 1e-10 else (m1**2 - m2**2) / (q(p2) - q(p1))
    k = m1**2 + n * q(p1)
    return e, n, k, c.a * math.sqrt(max(0.0, k - n * q(float(c.get("lat_0")) * RAD))) / n


def _aea(c, m, lon, lat):
    e, n, k, rho0 = _aea_constants(c)
    inside = k - _q(m, e, lat * RAD) * n
    rho = m.sqrt(m.only(inside >= 0.0, inside)) * (c.a / n)
    theta = _lam(c, m, lon) * n
    return _move(c, rho * m.sin(theta), rho0 - rho * m.cos(theta))


def _aea_inverse(c, m, x, y):
    x, y = _back(c, x, y)
    e, n, k, rho0 = _aea_constants(c)
    s = 1.0 if n > 0 else -1.0
    rho = m.hypot(x, rho0 - y)
    qp = float(_q(NUMBERS, e, math.pi / 2))
    share = (k - (rho * (n / c.a)) * (rho * (n / c.a))) / (n * qp)
    beta = m.asin(m.only(m.abs(share) <= 1.0 + 1e-12, m.clip(share, -1, 1)))
    return _lon(c, m, m.atan2(x * s, (rho0 - y) * s) / n), _phi_of_beta(m, c.e2, beta) / RAD


def _geos(c, m, lon, lat):
    away = float(c.get("h", 35785831.0)) / c.a
    g, p = 1 + away, c.b / c.a
    lam = _lam(c, m, lon)
    phi = m.atan(m.tan(lat * RAD) * p**2)
    r = m.div(p, m.hypot(m.cos(phi) * p, m.sin(phi)))
    vx, vy, vz = r * m.cos(lam) * m.cos(phi), r * m.sin(lam) * m.cos(phi), r * m.sin(phi)
    seen = (g - vx) * vx - vy * vy - vz * vz / p**2 >= 0
    left = g - vx
    if c.get("sweep", "y") == "x":
        x, y = m.atan(vy / m.hypot(vz, left)), m.atan(vz / left)
    else:
        x, y = m.atan(vy / left), m.atan(vz / m.hypot(vy, left))
    h = away * c.a
    return _move(c, m.only(seen, x) * h, m.only(seen, y) * h)


def _geos_inverse(c, m, x, y):
    x, y = _back(c, x, y)
    h = float(c.get("h", 35785831.0))
    g, p = 1 + h / c.a, c.b / c.a
    if c.get("sweep", "y") == "x":
        vz = m.tan(y / h)
        vy = m.tan(x / h) * m.hypot(vz, vz * 0 + 1)
    else:
        vy = m.tan(x / h)
        vz = m.tan(y / h) * m.hypot(vy, vy * 0 + 1)
    qa = vy * vy + (vz / p) * (vz / p) + 1
    det = 4 * g * g - qa * (4 * (g * g - 1))
    k = (2 * g - m.sqrt(m.only(det >= 0.0, det))) / (qa * 2)
    return _lon(c, m, m.atan2(vy * k, g - k)), m.atan(vz / m.hypot(g / k - 1, vy) / p**2) / RAD


def _tmerc_params(c):
    if c.name == "utm":
        zone = int(float(c.get("zone")))
        return zone * 6 - 183.0, 0.0, 0.9996, 500000.0, 10000000.0 if c.get("south", False) else 0.0
    return float(c.get("lon_0")), float(c.get("lat_0")), float(c.get("k_0", c.get("k", 1.0))), float(c.get("x_0")), float(c.get("y_0"))


def _kruger(c):
    f = 1 - c.b / c.a
    n = f / (2 - f)
    radius = c.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    return radius, alpha, beta


def _tm_forward(c, m, lam, phi):
    radius, alpha, _ = _kruger(c)
    chi = _conformal(m, math.sqrt(c.e2), phi)
    xi = m.atan2(m.tan(chi), m.cos(lam))
    eta = m.asinh(m.sin(lam) / m.hypot(m.tan(chi), m.cos(lam)))
    x, y = eta, xi
    for j, k in enumerate(alpha, 1):
        y = y + m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * k
        x = x + m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * k
    return x * radius, y * radius


def _tmerc(c, m, lon, lat):
    lon_0, lat_0, k, x_0, y_0 = _tmerc_params(c)
    lam = m.pmod(lon - lon_0 + 180.0, 360.0) * RAD - math.pi
    x, y = _tm_forward(c, m, lam, lat * RAD)
    y_low = float(_tm_forward(c, NUMBERS, 0.0, lat_0 * RAD)[1]) if lat_0 else 0.0
    return x * k + x_0, (y - y_low) * k + y_0


def _tmerc_inverse(c, m, x, y):
    lon_0, lat_0, k, x_0, y_0 = _tmerc_params(c)
    radius, _, beta = _kruger(c)
    y_low = float(_tm_forward(c, NUMBERS, 0.0, lat_0 * RAD)[1]) if lat_0 else 0.0
    xi, eta = ((y - y_0) / k + y_low) / radius, (x - x_0) / (k * radius)
    p, q = xi, eta
    for j, b in enumerate(beta, 1):
        p = p - m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * b
        q = q - m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * b
    chi = m.asin(m.clip(m.sin(p) / m.cosh(q), -1, 1))
    lam = m.atan2(m.sinh(q), m.cos(p))
    return m.pmod(lam / RAD + lon_0 + 180.0, 360.0) - 180.0, _phi_of_chi(m, math.sqrt(c.e2), chi) / RAD


def _omerc_constants(c):
    e2 = c.e2
    e, phi0 = math.sqrt(e2), float(c.get("lat_0")) * RAD
    alpha, lonc = float(c.get("alpha")) * RAD, float(c.get("lonc")) * RAD
    gamma = float(c.get("gamma")) * RAD if "gamma" in dict(c.params) else alpha
    k0 = float(c.get("k_0", c.get("k", 1.0)))
    b = math.sqrt(1 + e2 * math.cos(phi0) ** 4 / (1 - e2))
    a = c.a * b * k0 * math.sqrt(1 - e2) / (1 - e2 * math.sin(phi0) ** 2)
    t0 = float(_ts(NUMBERS, e, phi0))
    d = max(1.0, b * math.sqrt(1 - e2) / (math.cos(phi0) * math.sqrt(1 - e2 * math.sin(phi0) ** 2)))
    root = math.sqrt(d * d - 1) * (1 if phi0 >= 0 else -1)
    f = d + root
    ee = f * t0**b
    g = (f - 1 / f) / 2
    gamma0 = math.asin(math.sin(alpha) / d)
    lam0 = lonc - math.asin(max(-1, min(1, g * math.tan(gamma0)))) / b
    uc = 0.0 if c.get("no_uoff", c.get("no_off", False)) else a / b * math.atan2(abs(root), math.cos(alpha)) * (1 if phi0 >= 0 else -1)
    return e, a, b, ee, gamma0, lam0, gamma, uc


def _omerc(c, m, lon, lat):
    e, a, b, ee, gamma0, lam0, gamma, uc = _omerc_constants(c)
    w = m.log(_ts(m, e, m.only(m.abs(lat) < 90.0, lat) * RAD)) * -b + math.log(ee)
    s, t = m.sinh(w), m.cosh(w)
    lam = m.pmod(lon - lam0 / RAD + 180.0, 360.0) * RAD - math.pi
    v = m.sin(lam * b)
    across = m.atanh((s * math.sin(gamma0) - v * math.cos(gamma0)) / t) * (-a / b)
    along = m.atan2(s * math.cos(gamma0) + v * math.sin(gamma0), m.cos(lam * b)) * (a / b) - uc
    return _move(c, across * math.cos(gamma) + along * math.sin(gamma), along * math.cos(gamma) - across * math.sin(gamma))


def _omerc_inverse(c, m, x, y):
    x, y = _back(c, x, y)
    e, a, b, ee, gamma0, lam0, gamma, uc = _omerc_constants(c)
    across, along = x * math.cos(gamma) - y * math.sin(gamma), y * math.cos(gamma) + x * math.sin(gamma) + uc
    s, t, v = m.sinh(across * (-b / a)), m.cosh(across * (-b / a)), m.sin(along * (b / a))
    ts = m.exp((m.atanh((v * math.cos(gamma0) + s * math.sin(gamma0)) / t) * -1.0 + math.log(ee)) / b)
    lam = m.atan2(s * math.cos(gamma0) - v * math.sin(gamma0), m.cos(along * (b / a))) / -b
    return m.pmod(lam / RAD + lam0 / RAD + 180.0, 360.0) - 180.0, _phi_of_ts(m, e, ts) / RAD


def _ob_tran(c, m, lon, lat):
    pole, turn = float(c.get("o_lat_p", 90.0)) * RAD, float(c.get("o_lon_p")) * RAD
    lam, phi = _lam(c, m, lon), lat * RAD
    out_lam = m.atan2(m.cos(phi) * m.sin(lam), m.cos(phi) * m.cos(lam) * math.sin(pole) + m.sin(phi) * math.cos(pole)) + turn
    out_phi = m.asin(m.clip(m.sin(phi) * math.sin(pole) - m.cos(phi) * m.cos(lam) * math.cos(pole), -1, 1))
    x, y = m.pmod(out_lam / RAD + 180.0, 360.0) - 180.0, out_phi / RAD
    return (x, y) if c.geographic else _move(c, x * (RAD * c.a), y * (RAD * c.a))


def _ob_tran_inverse(c, m, x, y):
    pole, turn = float(c.get("o_lat_p", 90.0)) * RAD, float(c.get("o_lon_p")) * RAD
    if not c.geographic:
        x, y = _back(c, x, y)
        x, y = x / (RAD * c.a), y / (RAD * c.a)
    lam, phi = x * RAD - turn, y * RAD
    out_phi = m.asin(m.clip(m.sin(phi) * math.sin(pole) + m.cos(phi) * m.cos(lam) * math.cos(pole), -1, 1))
    out_lam = m.atan2(m.cos(phi) * m.sin(lam), m.cos(phi) * m.cos(lam) * math.sin(pole) - m.sin(phi) * math.cos(pole))
    return _lon(c, m, out_lam), out_phi / RAD


PROJECTIONS = {
    "longlat": (_longlat, _longlat_inverse),
    "merc": (_merc, _merc_inverse),
    "eqc": (_eqc, _eqc_inverse),
    "stere": (_stere, _stere_inverse),
    "laea": (_laea, _laea_inverse),
    "lcc": (_lcc, _lcc_inverse),
    "aea": (_aea, _aea_inverse),
    "geos": (_geos, _geos_inverse),
    "tmerc": (_tmerc, _tmerc_inverse),
    "utm": (_tmerc, _tmerc_inverse),
    "omerc": (_omerc, _omerc_inverse),
    "ob_tran": (_ob_tran, _ob_tran_inverse),
}


def transform(source: Crs, target: Crs, x, y):
    """Coordinates of one system in another."""
    return target.forward(*source.inverse(x, y))


__all__ = ["COLUMNS", "Crs", "EPSG", "ELLIPSOIDS", "PROJECTIONS", "format_proj", "parse_proj", "transform"]
