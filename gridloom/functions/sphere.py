"""Spherical geometry: distances, arcs and polygons.

Scalar functions work on Spark columns and numbers, in degrees unless said
otherwise. Polygons are small, live on the driver (or in an Arrow-batched
function) as clockwise arrays of (lon, lat) in radians; their interior is on the
right hand of the edges.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.mathx import RAD, unwrap, world

EPSILON = 1e-7


def haversine(lon1, lat1, lon2, lat2):
    """Great-circle angle in radians."""
    m = world(lon1)
    a = m.sin((lat2 - lat1) * (RAD / 2))
    b = m.sin((lon2 - lon1) * (RAD / 2))
    return m.asin(m.sqrt(m.clip(a * a + m.cos(lat1 * RAD) * m.cos(lat2 * RAD) * b * b, 0, 1))) * 2


def vincenty(lon1, lat1, lon2, lat2):
    """Great-circle angle in radians, well conditioned at all distances."""
    m = world(lon1)
    d, p, q = (lon2 - lon1) * RAD, lat1 * RAD, lat2 * RAD
    x = m.cos(p) * m.sin(q) - m.sin(p) * m.cos(q) * m.cos(d)
    y = m.cos(q) * m.sin(d)
    return m.atan2(m.hypot(y, x), m.sin(p) * m.sin(q) + m.cos(p) * m.cos(q) * m.cos(d))


def cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def normalized(a):
    """Unit vector; of a zero vector, missing."""
    m = world(a[0])
    n = m.sqrt(dot(a, a))
    return tuple(m.div(v, n) for v in a)


def unit(lon, lat):
    """The unit vector of radians."""
    m = world(lon)
    return m.cos(lat) * m.cos(lon), m.cos(lat) * m.sin(lon), m.sin(lat)


def spherical(v):
    """Radians of a vector."""
    m = world(v[0])
    return m.atan2(v[1], v[0]), m.atan2(v[2], m.hypot(v[0], v[1]))


def signed_angle(a, b, c):
    """The turn at unit vector ``b`` from the arc to ``a`` to the arc to ``c``, radians; clockwise is negative."""
    m = world(a[0])
    u, v = cross(a, b), cross(c, b)
    return -m.atan2(dot(cross(u, v), b), dot(u, v))


def inside_corners(lon, lat, corners):
    """Whether a location (degrees) is inside the quadrangle of clockwise ``corners``."""
    m = world(lon)
    p = unit(lon * RAD, lat * RAD)
    ring = [unit(math.radians(a), math.radians(b)) for a, b in corners]
    out = None
    for a, b in zip(ring, ring[1:] + ring[:1]):
        n = cross(a, b)
        side = dot(n, p) <= 1e-12 if m is not None else None
        out = side if out is None else out & side
    return out


def valid(lon, lat):
    """Whether radians are finite, with a latitude on the sphere."""
    if isinstance(lon, Column):
        return ~F.isnan(lon) & (F.abs(lon) < float("inf")) & (F.abs(lat) <= math.pi / 2 + 1e-12)
    return np.isfinite(lon) & (np.abs(lat) <= math.pi / 2 + 1e-12)


class Arc:
    """A great-circle arc between two (lon, lat) in radians."""

    def __init__(self, start, end):
        self.start, self.end = np.asarray(start, float), np.asarray(end, float)
        for p in (self.start, self.end):
            if not valid(p[0], p[1]):
                raise ValueError("a point beyond the sphere")

    def __eq__(self, other) -> bool:
        return _same(self.start, other.start) and _same(self.end, other.end)

    __hash__ = None

    def length(self) -> float:
        return _distance(self.start, self.end)

    def angle(self, other: "Arc") -> float:
        """The oriented angle at the point the arcs share; negative is clockwise."""
        for own, their in ((0, 0), (0, 1), (1, 0), (1, 1)):
            a, b = (self.start, self.end)[own], (other.start, other.end)[their]
            if _same(a, b):
                at, u, v = a, (self.end, self.start)[own], (other.end, other.start)[their]
                turn = float(signed_angle(unit(*u), unit(*at), unit(*v)))
                return math.pi if abs(abs(turn) - math.pi) < EPSILON else 0.0 if abs(turn) < EPSILON else turn
        raise ValueError("the arcs have no point in common")

    def intersections(self, other: "Arc") -> list[np.ndarray]:
        """The two opposite points where the great circles cross."""
        p, q = (cross(unit(*a.start), unit(*a.end)) for a in (self, other))
        v = np.array(cross(p, q))
        if np.linalg.norm(v) < 1e-15:
            return []
        v = v / np.linalg.norm(v)
        return [np.array(spherical(tuple(v))), np.array(spherical(tuple(-v)))]

    def holds(self, point) -> bool:
        return abs(_distance(self.start, point) + _distance(point, self.end) - self.length()) < EPSILON

    def intersection(self, other: "Arc"):
        """The point on both arcs, or None."""
        for p in self.intersections(other):
            if self.holds(p) and other.holds(p):
                return p
        return None

    def intersects(self, other: "Arc") -> bool:
        return self.intersection(other) is not None

    def next_intersection(self, arcs: list["Arc"], known=None):
        """The crossing next to the start (other than ``known``) and the arc crossed there; (None, None) without one."""
        found = []
        for arc in arcs:
            p = self.intersection(arc)
            if p is not None and (known is None or not _same(p, known)) and not _same(p, self.end):
                found.append((_distance(self.start, p), len(found), p, arc))
        return min(found)[2:] if found else (None, None)


def _same(a, b) -> bool:
    return abs(a[1] - b[1]) < EPSILON and (abs(float(unwrap(a[0] - b[0]))) < EPSILON or abs(abs(a[1]) - math.pi / 2) < EPSILON)


def _distance(a, b) -> float:
    return float(vincenty(a[0] / RAD, a[1] / RAD, b[0] / RAD, b[1] / RAD))


class SphericalPolygon:
    """A polygon of great-circle arcs; ``vertices`` is an (n, 2) array of radians, clockwise around the interior."""

    def __init__(self, vertices, radius: float = 1.0):
        self.vertices = np.asarray(vertices, float)
        if self.vertices.ndim != 2 or len(self.vertices) < 3 or not valid(self.vertices[:, 0], self.vertices[:, 1]).all():
            raise ValueError("a polygon needs three valid vertices")
        self.radius = radius

    def __len__(self) -> int:
        return len(self.vertices)

    def inverse(self) -> "SphericalPolygon":
        return SphericalPolygon(self.vertices[::-1], self.radius)

    def edges(self) -> list[Arc]:
        return [Arc(a, b) for a, b in zip(self.vertices, np.roll(self.vertices, -1, axis=0))]

    def area(self) -> float:
        """By the interior angles (Bevis and Cambareri, 1987)."""
        return float(polygon_area(self.vertices)) * self.radius**2

    def contains(self, point) -> bool:
        """Whether a (lon, lat) is inside or on the edge: an arc from a place surely inside crosses the edges an even number of times."""
        if any(arc.holds(point) for arc in self.edges()):
            return True
        return _crossings(self._inner(), point, self.edges()) % 2 == 0

    def _inner(self) -> np.ndarray:
        """A point just to the right of the middle of the longest edge."""
        arc = max(self.edges(), key=Arc.length)
        a, b = np.array(unit(*arc.start)), np.array(unit(*arc.end))
        middle, right = a + b, -np.array(cross(tuple(a), tuple(b)))
        middle, right = middle / np.linalg.norm(middle), right / np.linalg.norm(right)
        step = 1e-5
        v = middle * math.cos(step) + right * math.sin(step)
        return np.array(spherical(tuple(v)))

    def holds(self, other: "SphericalPolygon") -> bool:
        """Whether all of ``other``'s vertices are inside and no edges cross."""
        return all(self.contains(p) for p in other.vertices)

    def _combined(self, other: "SphericalPolygon", outward: bool):
        own, their = self.edges(), other.edges()
        crossings = []
        for i, a in enumerate(own):
            for j, b in enumerate(their):
                p = a.intersection(b)
                if p is not None and not (_same(p, a.end) or _same(p, b.end)):
                    crossings.append((i, _distance(a.start, p), j, _distance(b.start, p), p))
        if not crossings:
            if self.holds(other):
                return self if outward else other
            if other.holds(self):
                return other if outward else self
            return None
        # walk along one outline, changing over at each crossing
        lists = [self._with(own, [(i, d, k) for k, (i, d, _, _, _) in enumerate(crossings)], crossings), self._with(their, [(j, d, k) for k, (_, _, j, d, _) in enumerate(crossings)], crossings)]
        places = [{k: n for n, (k, _) in enumerate(ring) if k is not None} for ring in lists]
        first = None
        for k in range(len(crossings)):
            nxt = lists[0][(places[0][k] + 1) % len(lists[0])][1]
            middle = _middle(crossings[k][4], nxt)
            if other.contains(middle) != outward:
                first = k
                break
        if first is None:
            return None
        out, ring, n, k = [], 0, places[0][first], first
        for _ in range(2 * (len(lists[0]) + len(lists[1]))):
            out.append(lists[ring][n][1])
            n = (n + 1) % len(lists[ring])
            k = lists[ring][n][0]
            if k is not None:
                if k == first:
                    break
                ring = 1 - ring
                n = places[ring][k]
        kept = [p for i, p in enumerate(out) if not _same(p, out[i - 1])]
        return SphericalPolygon(np.array(kept), self.radius) if len(kept) >= 3 else None

    @staticmethod
    def _with(edges, marks, crossings):
        ring = []
        for i, edge in enumerate(edges):
            ring.append((None, edge.start))
            ring += [(k, crossings[k][4]) for _, _, k in sorted(m for m in marks if m[0] == i)]
        return ring

    def intersection(self, other: "SphericalPolygon"):
        """The common part; None if there is none."""
        return self._combined(other, outward=False)

    def union(self, other: "SphericalPolygon"):
        """Both together; None if they do not meet."""
        return self._combined(other, outward=True)

    def to_wkt(self) -> str:
        ring = np.degrees(np.vstack([self.vertices, self.vertices[:1]]))
        return "POLYGON ((" + ", ".join(f"{a:.10g} {b:.10g}" for a, b in ring) + "))"


def _middle(a, b) -> np.ndarray:
    v = np.array(unit(*a)) + np.array(unit(*b))
    return np.array(spherical(tuple(v / np.linalg.norm(v))))


def _crossings(a, b, edges) -> int:
    arc = Arc(a, b)
    found = []
    for edge in edges:
        p = arc.intersection(edge)
        if p is not None and not any(_same(p, q) for q in found):
            found.append(p)
    return len(found)


def polygon_area(vertices: np.ndarray) -> float:
    """Area on the unit sphere of clockwise (lon, lat) radians."""
    v = np.asarray(vertices, float)
    lon, lat = v[:, 0], v[:, 1]
    nxt_lon, nxt_lat, third_lon, third_lat = (np.roll(a, -k) for k in (1, 2) for a in (lon, lat))

    def bearing(lon_a, lat_a, lon_b, lat_b):
        d = lon_b - lon_a
        return np.arctan2(np.sin(d) * np.cos(lat_b), np.cos(lat_a) * np.sin(lat_b) - np.sin(lat_a) * np.cos(lat_b) * np.cos(d))

    turn = np.mod(bearing(nxt_lon, nxt_lat, lon, lat) - bearing(nxt_lon, nxt_lat, third_lon, third_lat), 2 * np.pi)
    return float(turn.sum() - (len(v) - 2) * np.pi)


def polygon_area_column(points: Column) -> Column:
    """The same of an ``ARRAY<STRUCT<lon, lat>>`` in radians, by array functions."""
    n = F.size(points)

    def bearing(a, b):
        d = b["lon"] - a["lon"]
        return F.atan2(F.sin(d) * F.cos(b["lat"]), F.cos(a["lat"]) * F.sin(b["lat"]) - F.sin(a["lat"]) * F.cos(b["lat"]) * F.cos(d))

    def turn(i):
        a, b, c = (F.element_at(points, ((i + k) % n + 1).cast("int")) for k in (0, 1, 2))
        return F.pmod(bearing(b, a) - bearing(b, c), F.lit(2 * math.pi))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + turn(i)) - (n - 2) * math.pi


def convex_area(vertices: np.ndarray) -> float:
    """Area of a convex polygon as a fan of triangles' spherical excesses."""
    total = 0.0
    for b, c in zip(vertices[1:-1], vertices[2:]):
        sides = [_distance(p, q) for p, q in ((vertices[0], b), (b, c), (c, vertices[0]))]
        s = sum(sides) / 2
        product = math.tan(s / 2) * math.prod(math.tan(max(0.0, s - side) / 2) for side in sides)
        total += 4 * math.atan(math.sqrt(max(0.0, product)))
    return total


def sphere_points_array(df, lon: str = "lon", lat: str = "lat", order: str = "i"):
    """Vertices of each group collected in order, as radians; for grouped aggregation of outlines."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, F.radians(lon).alias("lon"), F.radians(lat).alias("lat")))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
