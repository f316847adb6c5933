"""Area specifications: small immutable grids in a projection.

An area is metadata on the driver; its coordinates are made when a query scans
it (``gridloom.sources.scans``). Row 0 is the top. ``extent`` is the outer edge
(llx, lly, urx, ury); it may run backwards, pixel sizes are then negative.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass, field, replace

import numpy as np

from gridloom.errors import IncompatibleAreas
from gridloom.functions.crs import Crs
from gridloom.functions.mathx import EARTH_RADIUS, geocentric_xyz, world


@dataclass(frozen=True)
class AreaSpec:
    crs: Crs
    width: int
    height: int
    extent: tuple[float, float, float, float]
    area_id: str = field(default="", compare=False)
    description: str = field(default="", compare=False)
    attrs: tuple = field(default=(), compare=False)

    @staticmethod
    def make(crs, width: int, height: int, extent, area_id: str = "", description: str = "", **attrs) -> "AreaSpec":
        return AreaSpec(Crs.of(crs), int(width), int(height), tuple(float(v) for v in extent), area_id, description, tuple(sorted(attrs.items())))

    @property
    def shape(self) -> tuple[int, int]:
        return self.height, self.width

    @property
    def size(self) -> int:
        return self.width * self.height

    @property
    def pixel_size_x(self) -> float:
        return (self.extent[2] - self.extent[0]) / self.width

    @property
    def pixel_size_y(self) -> float:
        return (self.extent[3] - self.extent[1]) / self.height

    @property
    def resolution(self) -> tuple[float, float]:
        return self.pixel_size_x, self.pixel_size_y

    @property
    def upper_left(self) -> tuple[float, float]:
        """Centre of the first pixel."""
        return self.extent[0] + self.pixel_size_x / 2, self.extent[3] - self.pixel_size_y / 2

    @property
    def pixel_offset(self) -> tuple[float, float]:
        """Where the projection's origin lies, in pixels from the left and top edge."""
        return -self.extent[0] / self.pixel_size_x, self.extent[3] / self.pixel_size_y

    @property
    def is_geostationary(self) -> bool:
        return self.crs.name == "geos"

    @property
    def outer_boundary_corners(self) -> list[tuple[float, float]]:
        """Degrees of the four outer corners, clockwise from the upper left."""
        llx, lly, urx, ury = self.extent
        return [tuple(float(v) for v in self.crs.inverse(x, y)) for x, y in ((llx, ury), (urx, ury), (urx, lly), (llx, lly))]

    def __eq__(self, other) -> bool:
        return isinstance(other, AreaSpec) and self.shape == other.shape and self.crs.same_as(other.crs) and np.allclose(self.extent, other.extent, rtol=5e-9, atol=1e-6)

    def __hash__(self) -> int:
        return hash((self.shape, self.crs.name))

    def digest(self) -> str:
        """SHA-1 of what defines the area."""
        return hashlib.sha1(json.dumps([self.crs.to_proj(), self.shape, self.extent]).encode()).hexdigest()

    # coordinates: each works on Spark columns and on numbers

    def xy_of(self, col, row):
        """Projection coordinates of (fractional) array coordinates."""
        ulx, uly = self.upper_left
        return col * self.pixel_size_x + ulx, uly - row * self.pixel_size_y

    def array_coordinates(self, x, y):
        """Fractional (col, row) of projection coordinates; pixel centres are whole."""
        ulx, uly = self.upper_left
        return (x - ulx) / self.pixel_size_x, (uly - y) / self.pixel_size_y

    def array_coordinates_lonlat(self, lon, lat):
        return self.array_coordinates(*self.crs.forward(lon, lat))

    def lonlat_of(self, col, row):
        return self.crs.inverse(*self.xy_of(col, row))

    def indices(self, col, row):
        """Integer (col, row) of fractional ones, halves to even; a hair outside snaps to the edge, farther is missing."""
        m = world(col)
        inside = (col >= -0.52) & (col <= self.width - 0.48) & (row >= -0.52) & (row <= self.height - 0.48)
        snap = lambda v, n: m.clip(m.rint(v), 0, n - 1)
        return m.only(inside, snap(col, self.width)), m.only(inside, snap(row, self.height))

    def indices_lonlat(self, lon, lat):
        return self.indices(*self.array_coordinates_lonlat(lon, lat))

    def index_of_lonlat(self, lon: float, lat: float) -> tuple[int, int]:
        """One location's (col, row); raises outside."""
        col, row = self.indices_lonlat(float(lon), float(lat))
        if np.isnan(col) or np.isnan(row):
            raise ValueError("the location is outside the area")
        return int(col), int(row)

    def x_vector(self) -> np.ndarray:
        return np.arange(self.width) * self.pixel_size_x + self.upper_left[0]

    def y_vector(self) -> np.ndarray:
        return self.upper_left[1] - np.arange(self.height) * self.pixel_size_y

    # geometry

    def sides_lonlat(self, per_side: int | None = None, clockwise: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
        """Degrees along top, right, bottom and left, ends shared; for a geostationary area that sees space, of the disk."""
        if self.is_geostationary:
            if (disk := self._disk(per_side or 50)) is not None:
                lon, lat = disk
                cuts = [round(i * len(lon) / 4) for i in range(5)]
                lon, lat = np.append(lon, lon[0]), np.append(lat, lat[0])
                return [(lon[a : b + 1], lat[a : b + 1]) for a, b in zip(cuts, cuts[1:])]
        cols, rows = (np.arange(n) if per_side is None else np.unique(np.linspace(0, n - 1, per_side).round()) for n in (self.width, self.height))
        top, right, bottom, left = ((cols, np.zeros(len(cols))), (np.full(len(rows), self.width - 1), rows), (cols[::-1], np.full(len(cols), self.height - 1)), (np.zeros(len(rows)), rows[::-1]))
        sides = [self.lonlat_of(c, r) for c, r in (top, right, bottom, left)]
        if clockwise and not self._clockwise():
            sides = [(lon[::-1], lat[::-1]) for lon, lat in reversed(sides)]
        return sides

    def _clockwise(self) -> bool:
        return self.pixel_size_x * self.pixel_size_y > 0

    def _disk(self, points: int):
        llx, lly, urx, ury = self.extent
        corners = self.crs.inverse(np.array([llx, urx, urx, llx]), np.array([ury, ury, lly, lly]))
        if not np.isnan(corners[0]).any():
            return None
        x, y = geostationary_disk(self, points)
        keep = np.clip(x, min(llx, urx), max(llx, urx)), np.clip(y, min(lly, ury), max(lly, ury))
        return self.crs.inverse(*keep)

    def boundary_lonlat(self, per_side: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The closed boundary's vertices in order, each once."""
        sides = self.sides_lonlat(per_side)
        return np.concatenate([s[0][:-1] for s in sides]), np.concatenate([s[1][:-1] for s in sides])

    def corners(self) -> list[tuple[float, float]]:
        """Degrees of the corner pixels' centres, clockwise from the upper left."""
        w, h = self.width - 1, self.height - 1
        return [tuple(float(v) for v in self.lonlat_of(float(c), float(r))) for c, r in ((0, 0), (w, 0), (w, h), (0, h))]

    def geocentric_resolution(self, radius: float | None = None) -> float:
        """The longer typical step between neighbours along the middle row and column, in metres."""
        steps = []
        for cols, rows in ((np.arange(self.width), np.full(self.width, self.height // 2)), (np.full(self.height, self.width // 2), np.arange(self.height))):
            lon, lat = self.lonlat_of(cols.astype(float), rows.astype(float))
            xyz = np.stack(geocentric_xyz(lon, lat, radius or EARTH_RADIUS), 1)
            step = np.linalg.norm(np.diff(xyz, axis=0), axis=1)
            step = step[np.isfinite(step)]
            if len(step):
                edges = np.histogram(step, 10)[1]
                steps.append(float((edges[0] + edges[1]) / 2))
        if not steps:
            raise ValueError("no two neighbouring pixels have a place on earth")
        return max(steps)

    def overlaps(self, other: "AreaSpec") -> bool:
        return self.overlap_rate(other) > 0

    def overlap_rate(self, other: "AreaSpec") -> float:
        """The share of this area's corner quadrangle that lies inside the other's."""
        from gridloom.functions.sphere import SphericalPolygon

        own, their = (SphericalPolygon(np.radians(np.array(a.corners()))) for a in (other, self))
        both = own.intersection(their)
        return 0.0 if both is None else float(both.area() / own.area())

    def contains_lonlat(self, lon, lat):
        """Whether a location lies inside the corner quadrangle, by great circles."""
        from gridloom.functions.sphere import inside_corners

        return inside_corners(lon, lat, self.corners())

    # parts

    def subset(self, rows: slice, cols: slice) -> "AreaSpec":
        """The area of a slice, steps included."""
        r0, r1, rs = rows.indices(self.height)
        c0, c1, cs = cols.indices(self.width)
        if r1 <= r0 or c1 <= c0 or rs < 1 or cs < 1:
            raise IncompatibleAreas("an empty slice")
        ulx, uly = self.upper_left
        px, py = self.pixel_size_x, self.pixel_size_y
        llx, ury = ulx + (c0 - 0.5) * px, uly - (r0 - 0.5) * py
        urx, lly = ulx + (c1 - 0.5) * px, uly - (r1 - 0.5) * py
        return replace(self, width=-(-(c1 - c0) // cs), height=-(-(r1 - r0) // rs), extent=(llx, lly, urx, ury))

    def __getitem__(self, key) -> "AreaSpec":
        rows, cols = key
        return self.subset(rows, cols)

    def aggregate(self, y: float = 1, x: float = 1) -> "AreaSpec":
        """The same extent in pixels ``y`` times as high and ``x`` times as wide."""
        return replace(self, width=int(self.width / x), height=int(self.height / y))

    def slices_over(self, other: "AreaSpec", divisible_by: int | None = None) -> tuple[slice, slice]:
        """Columns and rows of this area that cover ``other``."""
        if self.crs.same_as(other.crs):
            llx, lly, urx, ury = other.extent
            (c0, c1), (r0, r1) = (np.sort([a, b]) for a, b in zip(self.array_coordinates(llx, ury), self.array_coordinates(urx, lly)))
            c0, r0, c1, r1 = round(c0 + 0.5), round(r0 + 0.5), round(c1 + 0.5), round(r1 + 0.5)
            return _clipped(c0, c1, self.width), _clipped(r0, r1, self.height)
        lon, lat = other.boundary_lonlat(min(64, max(other.shape)))
        col, row = self.array_coordinates_lonlat(lon, lat)
        seen = np.isfinite(col) & np.isfinite(row)
        if not seen.any():
            raise IncompatibleAreas("the areas do not meet")
        cols = _clipped(math.floor(col[seen].min()) - 1, math.ceil(col[seen].max()) + 2, self.width)
        rows = _clipped(math.floor(row[seen].min()) - 1, math.ceil(row[seen].max()) + 2, self.height)
        if divisible_by:
            cols, rows = (_divisible(s, n, divisible_by) for s, n in ((cols, self.width), (rows, self.height)))
        return cols, rows

    def crop_around(self, other: "AreaSpec") -> "AreaSpec":
        cols, rows = self.slices_over(other)
        return self.subset(rows, cols)

    def to_yaml(self) -> str:
        from gridloom.sources.area_files import dump_area

        return dump_area(self)


def _clipped(start: int, stop: int, n: int) -> slice:
    start, stop = max(0, int(start)), min(n, int(stop))
    if stop <= start:
        raise IncompatibleAreas("the areas do not meet")
    return slice(start, stop)


def _divisible(s: slice, n: int, factor: int) -> slice:
    missing = -(s.stop - s.start) % factor
    stop = min(n, s.stop + missing)
    return slice(max(0, s.start - (missing - (stop - s.stop))), stop)


def check_slice_orientation(s: slice) -> slice:
    """The slice with a step of its own direction."""
    if s.start is not None and s.stop is not None and s.start > s.stop and (s.step is None or s.step > 0):
        return slice(s.start, s.stop, -(s.step or 1))
    return s


def geostationary_angles(area: AreaSpec) -> tuple[float, float]:
    """Largest scan angles at which the earth is seen, in radians."""
    h, a, b = float(area.crs.get("h", 35785831.0)), area.crs.a, area.crs.b
    g = 1 + h / a
    req, rp = 1.0, b / a
    return math.acos(math.sqrt(g * g - req) / g), math.acos(math.sqrt(g * g - req) / math.sqrt(g * g - req + rp * rp))


def geostationary_disk(area: AreaSpec, points: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Projection coordinates along the edge of the visible disk, clockwise from the left, pulled in by 1e-4 rad."""
    x_max, y_max = (v - 1e-4 for v in geostationary_angles(area))
    h = float(area.crs.get("h", 35785831.0))
    turn = np.linspace(math.pi, -math.pi, points, endpoint=False)
    return np.cos(turn) * x_max * h, np.sin(turn) * y_max * h


def concatenate_areas(first: AreaSpec, second: AreaSpec) -> AreaSpec:
    """Two areas on top of each other as one; they must share projection, columns and an edge."""
    if first.crs != second.crs or first.width != second.width or not np.allclose((first.extent[0], first.extent[2]), (second.extent[0], second.extent[2])):
        raise IncompatibleAreas("only areas of the same columns can be joined")
    if math.isclose(first.extent[1], second.extent[3]):
        top, low = first, second
    elif math.isclose(first.extent[3], second.extent[1]):
        top, low = second, first
    else:
        raise IncompatibleAreas("the areas have no edge in common")
    return replace(first, height=first.height + second.height, extent=(first.extent[0], low.extent[1], first.extent[2], top.extent[3]))


@dataclass(frozen=True)
class StackedArea:
    """Areas under each other; neighbours with a common edge are merged."""

    areas: tuple[AreaSpec, ...]

    @staticmethod
    def of(*areas: AreaSpec) -> "StackedArea":
        out: list[AreaSpec] = []
        for area in areas:
            if out and out[-1].crs != area.crs:
                raise IncompatibleAreas("stacked areas share a projection")
            try:
                out[-1:] = [concatenate_areas(out[-1], area)] if out else [area]
            except IncompatibleAreas:
                out.append(area)
        return StackedArea(tuple(out))

    def append(self, area: AreaSpec) -> "StackedArea":
        return StackedArea.of(*self.areas, area)

    @property
    def height(self) -> int:
        return sum(a.height for a in self.areas)

    @property
    def width(self) -> int:
        return self.areas[0].width

    @property
    def crs(self) -> Crs:
        return self.areas[0].crs

    def squeeze(self):
        """The area itself, if it is only one."""
        return self.areas[0] if len(self.areas) == 1 else self


def enclose_areas(*areas: AreaSpec, area_id: str = "joint") -> AreaSpec:
    """The smallest area on the common grid that holds all."""
    if not areas:
        raise TypeError("no areas given")
    first = areas[0]
    if any(not a.crs.same_as(first.crs) for a in areas):
        raise ValueError("areas of different projections")
    if any(not np.allclose(a.resolution, first.resolution) for a in areas):
        raise ValueError("areas of different resolutions")
    e = np.array([a.extent for a in areas])
    extent = (e[:, 0].min(), e[:, 1].min(), e[:, 2].max(), e[:, 3].max())
    w, h = (extent[2] - extent[0]) / first.pixel_size_x, (extent[3] - extent[1]) / first.pixel_size_y
    return AreaSpec.make(first.crs, round(w), round(h), extent, area_id)


def swath_resolution(df, nadir_factor: float = 2.0, resolution: float | None = None) -> float:
    """Of a swath DataFrame: its stated resolution, else the step between the first two columns of the middle row, times ``nadir_factor``.

    One-dimensional swaths (no ``col``) raise RuntimeError.
    """
    from pyspark.sql import functions as F

    if resolution is not None:
        return resolution * nadir_factor
    if "col" not in df.columns:
        raise RuntimeError("a swath without columns has no resolution")
    span = df.agg(F.min("row").alias("a"), F.max("row").alias("b")).first()
    if span.a is None:
        raise RuntimeError("an empty swath has no resolution")
    middle = (span.a + span.b + 1) // 2
    two = df.where((F.col("row") == middle) & F.col("col").isin(0, 1)).select("col", "lon", "lat").orderBy("col").limit(2).collect()
    if len(two) < 2:
        raise RuntimeError("the middle row has no two neighbours")
    xyz = [np.array(geocentric_xyz(float(r.lon), float(r.lat))) for r in two]
    return float(np.linalg.norm(xyz[1] - xyz[0])) * nadir_factor
