"""One set of formulas for two worlds: Spark columns and driver-side numbers.

Projection and sphere formulas are written against the names below. With
``COLUMNS`` they build Catalyst expressions, with ``NUMBERS`` they compute with
numpy on the driver, where areas, boundaries and literals are prepared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Columns:
    sin, cos, tan, asin, acos, atan, sinh, cosh, asinh, atanh, sqrt, exp, abs, rint = (
        staticmethod(getattr(F, n)) for n in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "asinh", "atanh", "sqrt", "exp", "abs", "rint")
    )
    atan2 = staticmethod(F.atan2)
    hypot = staticmethod(F.hypot)

    @staticmethod
    def log(x):
        return F.log(x)

    @staticmethod
    def div(a, b):
        """NULL where the divisor is zero."""
        a, b = (v if isinstance(v, Column) else F.lit(float(v)) for v in (a, b))
        return F.try_divide(a, b)

    @staticmethod
    def power(a, b):
        return F.pow(a, b)

    @staticmethod
    def where(condition, a, b):
        return F.when(condition, a).otherwise(b)

    @staticmethod
    def only(condition, a):
        """``a``, or missing."""
        return F.when(condition, a)

    @staticmethod
    def pmod(a, b):
        return F.pmod(a, F.lit(float(b)))

    @staticmethod
    def floor(a):
        return F.floor(a).cast("double")

    @staticmethod
    def clip(a, low, high):
        return F.least(F.greatest(a, F.lit(float(low))), F.lit(float(high)))


class _Numbers:
    sin, cos, tan, asin, acos, atan, sinh, cosh, asinh, atanh, sqrt, exp, abs, rint, floor = (
        staticmethod(getattr(np, n)) for n in ("sin", "cos", "tan", "arcsin", "arccos", "arctan", "sinh", "cosh", "arcsinh", "arctanh", "sqrt", "exp", "abs", "rint", "floor")
    )
    atan2, hypot, log, power = (staticmethod(f) for f in (np.arctan2, np.hypot, np.log, np.power))

    @staticmethod
    def div(a, b):
        with np.errstate(divide="ignore", invalid="ignore"):
            b = np.asarray(b, float)
            return np.where(b == 0, np.nan, np.divide(a, np.where(b == 0, 1, b)))

    @staticmethod
    def where(condition, a, b):
        return np.where(condition, a, b)

    @staticmethod
    def only(condition, a):
        return np.where(condition, a, np.nan)

    @staticmethod
    def pmod(a, b):
        return np.mod(a, b)

    @staticmethod
    def clip(a, low, high):
        return np.clip(a, low, high)


COLUMNS, NUMBERS = _Columns(), _Numbers()


def world(value):
    """The formulas' world of a coordinate."""
    return COLUMNS if isinstance(value, Column) else NUMBERS


RAD = np.pi / 180.0
EARTH_RADIUS = 6370997.0


def wrap_longitude(lon):
    """Into [-180, 180)."""
    m = world(lon)
    return m.pmod(lon + 180.0, 360.0) - 180.0


def unwrap(angle, half: float = np.pi):
    """Into [-half, half)."""
    m = world(angle)
    return m.pmod(angle + half, 2 * half) - half


def round_to_resolution(value, resolution: float):
    """The nearest multiple, halves to the even one."""
    m = world(value)
    return m.rint(value / resolution) * resolution


def fwhm_to_sigma(fwhm: float) -> float:
    return fwhm / (2 * float(np.sqrt(np.log(2))))


def geocentric_xyz(lon, lat, radius: float = EARTH_RADIUS):
    """Earth-centred coordinates of degrees on a sphere."""
    m = world(lon)
    lam, phi = lon * RAD, lat * RAD
    return m.cos(phi) * m.cos(lam) * radius, m.cos(phi) * m.sin(lam) * radius, m.sin(phi) * radius


def geographic(x, y, z):
    """Degrees of a direction."""
    m = world(x)
    return m.atan2(y, x) / RAD, m.atan2(z, m.hypot(x, y)) / RAD
