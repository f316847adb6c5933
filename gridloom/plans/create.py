"""Areas from whatever is known of them, and from data."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.crs import Crs
from gridloom.plans.area import AreaSpec

# Metres of a unit.
UNITS = {"m": 1.0, "meter": 1.0, "meters": 1.0, "metre": 1.0, "metres": 1.0, "km": 1000.0, "kilometer": 1000.0, "kilometers": 1000.0, "cm": 0.01, "ft": 0.3048, "mi": 1609.344}
_DEGREES = ("deg", "degree", "degrees", "°")


def _pair(value, name: str):
    if value is None:
        return None
    if np.isscalar(value):
        return float(value), float(value)
    value = [float(v) for v in value]
    if len(value) != 2:
        raise ValueError(f"{name} needs two numbers")
    return tuple(value)


def _in_projection(crs: Crs, point, units: str | None, name: str, center=None):
    """A point or a length in projection units, from degrees or metric units."""
    if point is None:
        return None
    units = units or ("degrees" if crs.geographic else "m")
    if units in _DEGREES:
        if crs.geographic:
            return point
        if name in ("resolution", "radius"):
            if center is None:
                raise ValueError(f"{name} in degrees needs a center")
            lon, lat = (float(v) for v in crs.inverse(*center))
            east = [float(v) for v in crs.forward(lon + point[0], lat)]
            north = [float(v) for v in crs.forward(lon, lat + point[1] if lat + point[1] <= 90 else lat - point[1])]
            return math.dist(east, center), math.dist(north, center)
        x, y = crs.forward(*point)
        return float(x), float(y)
    if units in ("radians", "rad"):
        return _in_projection(crs, tuple(math.degrees(v) for v in point), "degrees", name, center)
    if units not in UNITS:
        raise ValueError(f"unknown units {units!r}")
    if crs.geographic:
        lon_scale = 111_194.9266 * (math.cos(math.radians(center[1])) if center else 1.0)
        metres = [v * UNITS[units] for v in point]
        return metres[0] / lon_scale, metres[1] / 111_194.9266
    scale = UNITS[units] / UNITS.get(crs.units, 1.0)
    return tuple(v * scale for v in point)


def _agree(old, new, name: str):
    if old is not None and new is not None and not np.allclose(old, new):
        raise ValueError(f"CONFLICTING DATA: {name} is given as {old} and follows as {new}")
    return new if old is None else old


@dataclass(frozen=True)
class DynamicArea:
    """An area that data complete: ``freeze`` gives it extent and shape."""

    crs: Crs
    width: int | None = None
    height: int | None = None
    extent: tuple | None = None
    resolution: tuple | None = None
    optimize: bool = False
    area_id: str = ""
    description: str = ""

    def freeze(self, data, resolution=None, shape=None, antimeridian_mode: str | None = None) -> AreaSpec:
        """The area around ``data``: a DataFrame with ``lon`` and ``lat``, or an AreaSpec.

        One aggregation finds the extent in the projection; with a resolution the
        edges go to its multiples, with a shape the outer pixels' centres lie on
        the outermost locations. ``antimeridian_mode`` tells what to do in degrees
        when the data lie on both sides of 180: None keeps the wide extent,
        ``modify_extents`` lets the extent go past 180, ``modify_crs`` turns the
        system by 180, ``global_extents`` takes -180 to 180.
        """
        if self.optimize:
            return optimal_area(data)
        resolution = _pair(resolution, "resolution") or self.resolution
        height, width = shape if shape is not None else (self.height, self.width)
        if self.extent is not None:
            low, crs = self.extent, self.crs
            return _finish(crs, low, resolution, height, width, self, snapped=False)
        low, crs = self._bounds(data, antimeridian_mode)
        return _finish(crs, low, resolution, height, width, self, snapped=True)

    def _bounds(self, data, mode):
        crs = self.crs
        if isinstance(data, AreaSpec):
            lon, lat = data.boundary_lonlat(64)
            x, y = crs.forward(lon, lat)
            keep = np.isfinite(x) & np.isfinite(y)
            x, y = x[keep], y[keep]
            found = [x.min(), y.min(), x.max(), y.max(), np.mod(x, 360).min(), np.mod(x, 360).max()]
        else:
            from gridloom.operators.filters import legal

            x, y = crs.forward(F.col("lon"), F.col("lat"))
            xy = legal(data).select(x.alias("x"), y.alias("y")).where("not isnan(x) and not isnan(y)")
            row = xy.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.min(F.pmod("x", F.lit(360.0))), F.max(F.pmod("x", F.lit(360.0)))).first()
            if row[0] is None:
                raise ValueError("no legal location to freeze an area around")
            found = list(row)
        extent = tuple(float(v) for v in found[:4])
        if mode and crs.geographic and extent[2] - extent[0] > 355 and abs(extent[1]) < 90 and abs(extent[3]) < 90:
            if mode == "modify_extents":
                extent = (float(found[4]), extent[1], float(found[5]), extent[3])
            elif mode == "modify_crs":
                crs = crs.with_params(pm=180.0)
                extent = (float(found[4]) - 180, extent[1], float(found[5]) - 180, extent[3])
            elif mode == "global_extents":
                extent = (-180.0, extent[1], 180.0, extent[3])
            else:
                raise ValueError(f"unknown antimeridian mode {mode!r}")
        return extent, crs


def _finish(crs, extent, resolution, height, width, area, snapped: bool) -> AreaSpec:
    llx, lly, urx, ury = extent
    if resolution is not None:
        rx, ry = resolution
        if snapped:  # to multiples, so that areas of one resolution share a grid
            llx, lly, urx, ury = (f(v / r) * r for f, v, r in ((math.floor, llx, rx), (math.floor, lly, ry), (math.ceil, urx, rx), (math.ceil, ury, ry)))
        width, height = int(round((urx - llx) / rx)), int(round((ury - lly) / ry))
    elif height and width:
        if snapped:
            px, py = (urx - llx) / max(1, width - 1), (ury - lly) / max(1, height - 1)
            llx, lly, urx, ury = llx - px / 2, lly - py / 2, urx + px / 2, ury + py / 2
    else:
        raise ValueError("a shape or a resolution is needed")
    return AreaSpec.make(crs, max(1, width), max(1, height), (llx, lly, urx, ury), area.area_id, area.description)


def create_area(
    area_id: str, projection, width=None, height=None, area_extent=None, shape=None, upper_left_extent=None, center=None, resolution=None, radius=None, units=None, description: str = "", **attrs
):
    """An AreaSpec from any sufficient set of extent, shape, centre, resolution, radius and upper left corner.

    Values are numbers, pairs, or dicts with ``units``. What follows from two
    ways must agree (ValueError "CONFLICTING DATA"); what does not suffice gives
    a DynamicArea.
    """
    crs = Crs.of(projection)
    unit = {}

    def take(name, value):
        if isinstance(value, dict):
            unit[name] = value.get("units", units)
            keys = {"area_extent": ("lower_left_xy", "upper_right_xy"), "center": ("x", "y"), "resolution": ("dx", "dy"), "radius": ("dx", "dy"), "upper_left_extent": ("x", "y"), "shape": ("height", "width")}[name]
            value = [value[k] for k in keys if k in value]
            return [v for pair in value for v in (pair if isinstance(pair, (list, tuple)) else [pair])]
        unit[name] = units
        return value

    shape = take("shape", shape)
    if width is not None or height is not None:
        shape = _agree(shape, (height, width) if width is not None and height is not None else None, "shape")
    if shape is not None:
        shape = tuple(shape)
        if len(shape) != 2:
            raise ValueError("shape needs two numbers")
        rounded = tuple(int(math.ceil(round(v, 6))) for v in shape)
        shape = rounded
    center, radius, resolution, ul = (take(n, v) for n, v in (("center", center), ("radius", radius), ("resolution", resolution), ("upper_left_extent", upper_left_extent)))
    extent = take("area_extent", area_extent)
    center = _in_projection(crs, _pair(center, "center"), unit["center"], "center")
    ul = _in_projection(crs, _pair(ul, "upper_left_extent"), unit["upper_left_extent"], "upper_left_extent")
    radius = _in_projection(crs, _pair(radius, "radius"), unit["radius"], "radius", center)
    resolution = _in_projection(crs, _pair(resolution, "resolution"), unit["resolution"], "resolution", center)
    if extent is not None:
        extent = [float(v) for v in extent]
        if len(extent) != 4:
            raise ValueError("area_extent needs four numbers")
        extent = (*_in_projection(crs, tuple(extent[:2]), unit["area_extent"], "area_extent"), *_in_projection(crs, tuple(extent[2:]), unit["area_extent"], "area_extent"))

    if extent is not None:
        c = ((extent[0] + extent[2]) / 2, (extent[1] + extent[3]) / 2)
        center, ul = _agree(center, c, "center"), _agree(ul, (extent[0], extent[3]), "upper_left_extent")
        radius = _agree(radius, ((extent[2] - extent[0]) / 2, (extent[3] - extent[1]) / 2), "radius")
    if radius is None and shape is not None and resolution is not None:
        radius = shape[1] * resolution[0] / 2, shape[0] * resolution[1] / 2
    if radius is None and center is not None and ul is not None:
        radius = center[0] - ul[0], ul[1] - center[1]
    if center is None and radius is not None and ul is not None:
        center = ul[0] + radius[0], ul[1] - radius[1]
    if radius is not None and center is not None:
        follows = center[0] - radius[0], center[1] - radius[1], center[0] + radius[0], center[1] + radius[1]
        extent = _agree(extent, follows, "area_extent")
        ul = _agree(ul, (extent[0], extent[3]), "upper_left_extent")
    if radius is not None and resolution is not None:
        follows = tuple(int(math.ceil(round(2 * r / s, 6))) for r, s in ((radius[1], resolution[1]), (radius[0], resolution[0])))
        shape = _agree(shape, follows, "shape")
    if extent is None or shape is None:
        return DynamicArea(crs, shape[1] if shape else None, shape[0] if shape else None, extent, resolution, bool(attrs.get("optimize_projection")), area_id, description)
    return AreaSpec.make(crs, shape[1], shape[0], extent, area_id, description, **{k: v for k, v in attrs.items() if k != "optimize_projection"})


def from_extent(area_id, projection, shape, area_extent, **more) -> AreaSpec:
    return create_area(area_id, projection, shape=shape, area_extent=area_extent, **more)


def from_circle(area_id, projection, center, radius, shape=None, resolution=None, **more):
    return create_area(area_id, projection, center=center, radius=radius, shape=shape, resolution=resolution, **more)


def from_area_of_interest(area_id, projection, shape, center, resolution, **more) -> AreaSpec:
    return create_area(area_id, projection, shape=shape, center=center, resolution=resolution, **more)


def from_ul_corner(area_id, projection, shape, upper_left_extent, resolution, **more) -> AreaSpec:
    return create_area(area_id, projection, shape=shape, upper_left_extent=upper_left_extent, resolution=resolution, **more)


# The extents, in degrees or metres, that whole-system areas of these codes span.
EPSG_EXTENTS = {4326: (-180.0, -90.0, 180.0, 90.0), 3857: (-20037508.342789244, -20048966.104014594, 20037508.342789244, 20048966.104014594), 3035: (1896628.62, 1095703.18, 7104179.2, 6882401.15)}


def from_epsg(code, resolution) -> AreaSpec:
    """The whole of a registered system at a resolution."""
    number = int(str(code).upper().replace("EPSG:", ""))
    if number not in EPSG_EXTENTS:
        raise ValueError(f"no extent for EPSG:{number}")
    return create_area(f"EPSG:{number}", number, area_extent=EPSG_EXTENTS[number], resolution=resolution)


def optimal_area(data: DataFrame, proj: str | None = None) -> AreaSpec:
    """An area that fits a two-dimensional swath: an oblique Mercator along its middle column, or ``proj`` about its middle.

    Reads the outer and middle rows and columns only.
    """
    size = data.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    if size.r is None:
        raise ValueError("an empty swath has no area")
    edge = data.where(F.col("row").isin(0, size.r, size.r // 2) | F.col("col").isin(0, size.c, size.c // 2)).select("row", "col", "lon", "lat").collect()
    at = {(r.row, r.col): (float(r.lon), float(r.lat)) for r in edge}
    middle = at[size.r // 2, size.c // 2]
    if proj is None or proj == "omerc":
        first, last = at[0, size.c // 2], at[size.r, size.c // 2]
        dx, dy = (last[0] - first[0]) * math.cos(math.radians(middle[1])), last[1] - first[1]
        alpha = math.degrees(math.atan2(dx, dy))
        alpha = (alpha + 90) % 180 - 90
        crs = Crs.of({"proj": "omerc", "alpha": alpha, "lonc": middle[0], "lat_0": middle[1] if abs(middle[1]) > 1e-3 else 1e-3, "gamma": 0.0, "ellps": "sphere"})
    else:
        crs = Crs.of({"proj": proj, "lon_0": middle[0], "lat_0": middle[1], "lat_1": middle[1] if abs(middle[1]) > 1e-3 else 1e-3, "ellps": "WGS84"})
    lon, lat = (np.array([p[k] for p in at.values()]) for k in range(2))
    x, y = crs.forward(lon, lat)
    wide, high = x.max() - x.min(), y.max() - y.min()
    pixel = math.sqrt(wide * high / ((size.r + 1) * (size.c + 1)))
    shape = max(2, round(high / pixel)), max(2, round(wide / pixel))
    return replace(DynamicArea(crs, shape[1], shape[0]).freeze_bounds((x.min(), y.min(), x.max(), y.max())), area_id="swath")


def _freeze_bounds(self: DynamicArea, extent) -> AreaSpec:
    return _finish(self.crs, tuple(float(v) for v in extent), self.resolution, self.height, self.width, self, snapped=True)


DynamicArea.freeze_bounds = _freeze_bounds
