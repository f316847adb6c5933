"""Registered queries of the resampling operators, each with DuckDB SQL of the same rows.

The plain tables have no places, so events are laid out on the earth by fixed
formulas (``gridloom.sources.scans``); floats are rounded last, cells are made
first, so both engines agree whatever their mathematics libraries round.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.mathx import EARTH_RADIUS, geocentric_xyz, round_to_resolution, wrap_longitude
from gridloom.functions.sphere import haversine, polygon_area_column, vincenty
from gridloom.operators import bilinear, blocks, bucket, ewa, filters, gradient, grid, knn, polygons, swath
from gridloom.plans.area import AreaSpec, StackedArea
from gridloom.sources.scans import POINTS_SQL, SWATH_SQL, area_grid, densify, events_points, events_swath
from gridloom.streaming.buckets import windowed_buckets

QUERIES: dict = {}
SQL: dict[str, str] = {}

MERC = AreaSpec.make("+proj=merc +datum=WGS84", 40, 40, (-20e6, -20e6, 20e6, 20e6), "merc")
GLOBE = AreaSpec.make("+proj=longlat +datum=WGS84", 60, 30, (-180, -90, 180, 90), "globe")
RASTER = AreaSpec.make("+proj=longlat +datum=WGS84", 100, 100, (-50, -50, 50, 50), "raster")
FINE = AreaSpec.make("+proj=longlat +datum=WGS84", 60, 40, (-12.2, -9.7, 17.8, 10.3), "fine")
EWA = AreaSpec.make("+proj=longlat +datum=WGS84", 64, 104, (-96, 14, -64, 66), "ewa")
R = EARTH_RADIUS

P = f"with p as ({POINTS_SQL})"
_E = "0.08181919084262149e0"  # of WGS84
MERC_SQL = f"""{P}, xy as (select *, 6378137.0e0 * radians(lon) as x,
  -6378137.0e0 * ln(tan(pi() / 4 - radians(lat) / 2) / pow((1 - {_E} * sin(radians(lat))) / (1 + {_E} * sin(radians(lat))), {_E} / 2)) as y from p),
c as (select *, cast(floor((20000000.0e0 - y) / 1000000.0e0) as int) as row, cast(floor((x + 20000000.0e0) / 1000000.0e0) as int) as col from xy),
cells as (select * from c where row between 0 and 39 and col between 0 and 39)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c, digits: int = 6):
    return F.round(c, digits)


# bucket statistics


@query(f"{MERC_SQL} select row, col, count(*) as n from cells group by row, col")
def bucket_count(spark: SparkSession, sf: str) -> DataFrame:
    return bucket.bucket(events_points(spark, sf), MERC, n=bucket.count())


@query(f"{MERC_SQL} select row, col, round(sum(coalesce(value, 0.0e0)), 4) as total from cells group by row, col")
def bucket_sum(spark, sf):
    return bucket.bucket(events_points(spark, sf), MERC, total=_r(bucket.total("value"), 4))


@query(f"{MERC_SQL} select row, col, round(case when count(value) = count(*) then sum(value) else -1.0e0 end, 4) as total from cells group by row, col")
def bucket_sum_skipna_false(spark, sf):
    return bucket.bucket(events_points(spark, sf), MERC, total=_r(bucket.total("value", skipna=False, fill=-1.0), 4))


@query(f"{MERC_SQL} select row, col, min(value) as low from cells group by row, col")
def bucket_min(spark, sf):
    return bucket.bucket(events_points(spark, sf), MERC, low=bucket.minimum("value"))


@query(f"{MERC_SQL} select row, col, max(value) as high from cells group by row, col")
def bucket_max(spark, sf):
    return bucket.bucket(events_points(spark, sf), MERC, high=bucket.maximum("value"))


@query(f"{MERC_SQL} select row, col, case when count(value) = count(*) then max(value) end as high from cells group by row, col")
def bucket_max_propagate(spark, sf):
    return bucket.bucket(events_points(spark, sf), MERC, high=bucket.maximum("value", "propagate"))


@query(f"{MERC_SQL}, v as (select row, col, value - 50.0e0 as d from cells) select row, col, case when -min(d) > max(d) then min(d) else max(d) end as extreme from v group by row, col")
def bucket_absmax(spark, sf):
    return bucket.bucket(events_points(spark, sf).withColumn("d", F.col("value") - 50.0), MERC, extreme=bucket.absolute_maximum("d"))


@query(f"{MERC_SQL} select row, col, round(coalesce(avg(value), -999.0e0), 6) as mean from cells group by row, col")
def bucket_avg(spark, sf):
    return bucket.bucket(events_points(spark, sf), MERC, mean=_r(bucket.average("value", fill=-999.0)))


@query(f"{MERC_SQL} select row, col, round(case when count(value) = count(*) then avg(value) end, 6) as mean from cells group by row, col")
def bucket_avg_skipna_false(spark, sf):
    return bucket.bucket(events_points(spark, sf), MERC, mean=_r(bucket.average("value", skipna=False)))


@query(f"""{MERC_SQL}, k as (select row, col, category, count(*) as c from cells where category is not null group by row, col, category),
t as (select row, col, count(*) as n from cells group by row, col)
select k.row, k.col, category, round(c::double / n, 9) as fraction from k join t on k.row = t.row and k.col = t.col""")
def bucket_fractions(spark, sf):
    out = bucket.fractions(events_points(spark, sf), MERC, "category")
    return out.withColumn("fraction", _r(F.col("fraction"), 9))


@query(f"""{P}, c as (select cast(floor((90.0e0 - lat) / 6.0e0) as int) as row, cast(floor((lon + 180.0e0) / 6.0e0) as int) as col, value from p),
g as (select cast(i // 60 as int) as row, cast(i % 60 as int) as col from range(1800) t(i)),
s as (select row, col, count(*) as n, round(avg(value), 6) as mean from c where row between 0 and 29 and col between 0 and 59 group by row, col)
select g.row, g.col, coalesce(n, 0) as n, coalesce(mean, -1.0e0) as mean from g left join s on g.row = s.row and g.col = s.col""")
def bucket_densify(spark, sf):
    cells = bucket.bucket(events_points(spark, sf), GLOBE, n=bucket.count(), mean=_r(bucket.average("value")))
    return densify(cells, GLOBE, {"n": 0, "mean": -1.0})


@query(f"""{MERC_SQL} select row, col, count(*) as n, round(sum(coalesce(value, 0.0e0)), 4) as total, min(value) as low, max(value) as high, round(avg(value), 6) as mean from cells group by row, col""")
def bucket_stats(spark, sf):
    return bucket.bucket(events_points(spark, sf), MERC, n=bucket.count(), total=_r(bucket.total("value"), 4), low=bucket.minimum("value"), high=bucket.maximum("value"), mean=_r(bucket.average("value")))


@query(f"""{P}, c as (select time_bucket(interval '6 hours', ts::timestamp) as start, cast(floor((90.0e0 - lat) / 6.0e0) as int) as row, cast(floor((lon + 180.0e0) / 6.0e0) as int) as col, value from p)
select start, row, col, count(*) as n, round(avg(value), 6) as mean from c where row between 0 and 29 and col between 0 and 59 group by all""")
def bucket_windowed(spark, sf):
    found = windowed_buckets(events_points(spark, sf), GLOBE, "6 hours", "1 hour", n=bucket.count(), mean=_r(bucket.average("value")))
    return found.drop("end").withColumn("start", F.col("start").cast("timestamp_ntz"))


# projections: points counted by cell


def _cells_sql(x: str, y: str, half: float, n: int, keep: str = "true") -> str:
    size = 2 * half / n
    return f"""{P}, xy as (select {x} as x, {y} as y from p where {keep}),
c as (select cast(floor(({half}e0 - y) / {size}e0) as int) as row, cast(floor((x + {half}e0) / {size}e0) as int) as col from xy)
select row, col, count(*) as n from c where row between 0 and {n - 1} and col between 0 and {n - 1} group by row, col"""


def _square(crs, half: float, n: int) -> AreaSpec:
    return AreaSpec.make(crs, n, n, (-half, -half, half, half))


def _project(crs, half, n):
    return lambda spark, sf: bucket.bucket(events_points(spark, sf), _square(crs, half, n), n=bucket.count())


_K = 2 * 6371228.0
_PROJECTED = {
    "project_laea_cells": ("+proj=laea +lat_0=90 +lon_0=0 +R=6371228", 9e6, 60, _cells_sql(f"{_K}e0 * sin(pi() / 4 - radians(lat) / 2) * sin(radians(lon))", f"-{_K}e0 * sin(pi() / 4 - radians(lat) / 2) * cos(radians(lon))", 9000000.0, 60)),
    "project_laea_oblique_cells": (
        "+proj=laea +lat_0=50 +lon_0=10 +R=6371228",
        6e6,
        40,
        f"""{P}, l as (select radians(lon - 10.0e0) as l, radians(lat) as f, radians(50.0e0) as g from p),
k as (select *, 1 + sin(g) * sin(f) + cos(g) * cos(f) * cos(l) as b from l), xy as (select 6371228.0e0 * sqrt(2 / b) * cos(f) * sin(l) as x, 6371228.0e0 * sqrt(2 / b) * (cos(g) * sin(f) - sin(g) * cos(f) * cos(l)) as y from k where b > 1e-10),
c as (select cast(floor((6000000.0e0 - y) / 300000.0e0) as int) as row, cast(floor((x + 6000000.0e0) / 300000.0e0) as int) as col from xy)
select row, col, count(*) as n from c where row between 0 and 39 and col between 0 and 39 group by row, col""",
    ),
    "project_stere_cells": (
        "+proj=stere +lat_0=90 +lat_ts=60 +lon_0=0 +R=6371228",
        10e6,
        50,
        _cells_sql("6371228.0e0 * (1 + sin(radians(60.0e0))) * tan(pi() / 4 - radians(lat) / 2) * sin(radians(lon))", "-6371228.0e0 * (1 + sin(radians(60.0e0))) * tan(pi() / 4 - radians(lat) / 2) * cos(radians(lon))", 10000000.0, 50),
    ),
    "project_eqc_cells": ("+proj=eqc +lat_ts=30 +R=6371228", 12e6, 48, _cells_sql("6371228.0e0 * cos(radians(30.0e0)) * radians(lon)", "6371228.0e0 * radians(lat)", 12000000.0, 48)),
    "project_lcc_cells": (
        "+proj=lcc +lat_0=25 +lat_1=25 +lon_0=-95 +R=6371200",
        8e6,
        40,
        f"""{P}, l as (select radians(((lon + 95.0e0 + 180.0e0) % 360.0e0 + 360.0e0) % 360.0e0 - 180.0e0) as l, radians(lat) as f, sin(radians(25.0e0)) as n, cos(radians(25.0e0)) * pow(tan(pi() / 4 + radians(25.0e0) / 2), sin(radians(25.0e0))) / sin(radians(25.0e0)) * 6371200.0e0 as k from p),
r as (select *, k * pow(tan(pi() / 4 - f / 2), n) as rho, k * pow(tan(pi() / 4 - radians(25.0e0) / 2), n) as rho0 from l), xy as (select rho * sin(n * l) as x, rho0 - rho * cos(n * l) as y from r),
c as (select cast(floor((8000000.0e0 - y) / 400000.0e0) as int) as row, cast(floor((x + 8000000.0e0) / 400000.0e0) as int) as col from xy)
select row, col, count(*) as n from c where row between 0 and 39 and col between 0 and 39 group by row, col""",
    ),
    "project_aea_cells": (
        "+proj=aea +lat_1=20 +lat_2=50 +lat_0=0 +lon_0=0 +R=6371228",
        10e6,
        40,
        f"""{P}, k as (select radians(lon) as l, radians(lat) as f, (sin(radians(20.0e0)) + sin(radians(50.0e0))) / 2 as n from p), q as (select *, pow(cos(radians(20.0e0)), 2) + 2 * n * sin(radians(20.0e0)) as c from k),
r as (select *, 6371228.0e0 * sqrt(c - 2 * n * sin(f)) / n as rho, 6371228.0e0 * sqrt(c) / n as rho0 from q where c - 2 * n * sin(f) >= 0), xy as (select rho * sin(n * l) as x, rho0 - rho * cos(n * l) as y from r),
d as (select cast(floor((10000000.0e0 - y) / 500000.0e0) as int) as row, cast(floor((x + 10000000.0e0) / 500000.0e0) as int) as col from xy)
select row, col, count(*) as n from d where row between 0 and 39 and col between 0 and 39 group by row, col""",
    ),
    "project_geos_cells": (
        "+proj=geos +h=35785831 +lon_0=0 +R=6371228",
        5.6e6,
        56,
        f"""{P}, v as (select cos(radians(lat)) * cos(radians(lon)) as vx, cos(radians(lat)) * sin(radians(lon)) as vy, sin(radians(lat)) as vz, 1 + 35785831.0e0 / 6371228.0e0 as g from p),
xy as (select 35785831.0e0 * atan(vy / (g - vx)) as x, 35785831.0e0 * atan(vz / sqrt(vy * vy + (g - vx) * (g - vx))) as y from v where (g - vx) * vx - vy * vy - vz * vz >= 0),
c as (select cast(floor((5600000.0e0 - y) / 200000.0e0) as int) as row, cast(floor((x + 5600000.0e0) / 200000.0e0) as int) as col from xy)
select row, col, count(*) as n from c where row between 0 and 55 and col between 0 and 55 group by row, col""",
    ),
    "project_tmerc_cells": (
        "+proj=tmerc +lon_0=15 +k_0=0.9996 +R=6371228",
        4e6,
        40,
        f"""{P}, b as (select radians(lat) as f, radians(lon - 15.0e0) as l from p where abs(lon - 15.0e0) < 80), k as (select *, cos(f) * sin(l) as s from b),
xy as (select 6371228.0e0 * 0.9996e0 * ln((1 + s) / (1 - s)) / 2 as x, 6371228.0e0 * 0.9996e0 * atan2(tan(f), cos(l)) as y from k),
c as (select cast(floor((4000000.0e0 - y) / 200000.0e0) as int) as row, cast(floor((x + 4000000.0e0) / 200000.0e0) as int) as col from xy)
select row, col, count(*) as n from c where row between 0 and 39 and col between 0 and 39 group by row, col""",
    ),
    "project_rotated_cells": (
        "+proj=ob_tran +o_proj=eqc +o_lat_p=40 +lon_0=10 +R=6371228",
        10e6,
        40,
        f"""{P}, b as (select radians(lat) as f, radians(lon - 10.0e0) as l, radians(40.0e0) as o from p),
xy as (select 6371228.0e0 * atan2(cos(f) * sin(l), sin(o) * cos(f) * cos(l) + cos(o) * sin(f)) as x, 6371228.0e0 * asin(greatest(-1.0e0, least(1.0e0, sin(o) * sin(f) - cos(o) * cos(f) * cos(l)))) as y from b),
c as (select cast(floor((10000000.0e0 - y) / 500000.0e0) as int) as row, cast(floor((x + 10000000.0e0) / 500000.0e0) as int) as col from xy)
select row, col, count(*) as n from c where row between 0 and 39 and col between 0 and 39 group by row, col""",
    ),
}
for _name, (_crs, _half, _n, _sql) in _PROJECTED.items():
    QUERIES[_name], SQL[_name] = _project(_crs, _half, _n), _sql


@query(f"{P} select count(*) as n from p where (lon + 96.0e0) / 0.5e0 - 0.5e0 between -1 and 65 and (66.0e0 - lat) / 0.5e0 - 0.5e0 between -1 and 105")
def ll2cr_points_in_grid(spark, sf):
    placed = ewa.ll2cr(events_points(spark, sf), EWA)
    near = F.col("gc").between(-1, EWA.width + 1) & F.col("gr").between(-1, EWA.height + 1)
    return placed.agg(F.count_if(near).alias("n"))


@query(f"""{P}, f as (select pt_id, (lon + 49.5e0) / 1.0e0 as c, (49.5e0 - lat) / 1.0e0 as r from p)
select pt_id, case when c between -0.52 and 99.52 and r between -0.52 and 99.52 then cast(greatest(0, least(99, round_even(c, 0))) as int) end as col,
  case when c between -0.52 and 99.52 and r between -0.52 and 99.52 then cast(greatest(0, least(99, round_even(r, 0))) as int) end as row from f""")
def array_indices(spark, sf):
    col, row = RASTER.indices_lonlat(F.col("lon"), F.col("lat"))
    return events_points(spark, sf).select("pt_id", col.cast("int").alias("col"), row.cast("int").alias("row"))


@query(f"{P} select pt_id, round(((lon * 3 + 180.0e0) % 360.0e0 + 360.0e0) % 360.0e0 - 180.0e0, 6) as lon from p")
def wrap_longitudes(spark, sf):
    return events_points(spark, sf).select("pt_id", _r(wrap_longitude(F.col("lon") * 3)).alias("lon"))


@query(f"{P} select pt_id, round(cos(radians(lat)) * cos(radians(lon)) * 6370997.0e0, 3) as x, round(cos(radians(lat)) * sin(radians(lon)) * 6370997.0e0, 3) as y, round(sin(radians(lat)) * 6370997.0e0, 3) as z from p")
def geocentric(spark, sf):
    x, y, z = geocentric_xyz(F.col("lon"), F.col("lat"))
    return events_points(spark, sf).select("pt_id", *[(_r(c, 3) + 0.0).alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))])


@query(f"""{P} select pt_id, round(2 * asin(sqrt(least(1.0e0, pow(sin(radians(lat - 55.7e0) / 2), 2) + cos(radians(55.7e0)) * cos(radians(lat)) * pow(sin(radians(lon - 12.5e0) / 2), 2)))), 8) as angle from p""")
def haversine_distance(spark, sf):
    return events_points(spark, sf).select("pt_id", _r(haversine(F.lit(12.5), F.lit(55.7), F.col("lon"), F.col("lat")), 8).alias("angle"))


@query(f"""{P}, v as (select pt_id, radians(lon - 12.5e0) as d, radians(55.7e0) as a, radians(lat) as b from p)
select pt_id, round(atan2(sqrt(pow(cos(b) * sin(d), 2) + pow(cos(a) * sin(b) - sin(a) * cos(b) * cos(d), 2)), sin(a) * sin(b) + cos(a) * cos(b) * cos(d)), 8) as angle from v""")
def vincenty_distance(spark, sf):
    return events_points(spark, sf).select("pt_id", _r(vincenty(F.lit(12.5), F.lit(55.7), F.col("lon"), F.col("lat")), 8).alias("angle"))


@query(f"{P} select pt_id, round_even(value / 1.7e0, 0) * 1.7e0 as value from p")
def rounded_to_resolution(spark, sf):
    return events_points(spark, sf).select("pt_id", round_to_resolution(F.col("value"), 1.7).alias("value"))


# neighbours: every event is a source and, moved a little, a target

RADIUS = 300_000.0
_XYZ = "cos(radians(lat)) * cos(radians(lon)) * 6370997.0e0 as x, cos(radians(lat)) * sin(radians(lon)) * 6370997.0e0 as y, sin(radians(lat)) * 6370997.0e0 as z"
_CUBE = ", ".join(f"cast(floor({c} / {RADIUS}) as int) as i{c}" for c in "xyz")
# all meet all within a radius: by cubes in SQL too, plain inequalities would compare every pair
PAIRS_SQL = f"""{P}, moved as (select pt_id, lon, lat + 0.05e0 as lat from p), s as (select *, {_CUBE} from (select pt_id, value, {_XYZ} from p)),
t as (select *, {_CUBE} from (select pt_id, {_XYZ} from moved)), n as (select a, b, c from (values (-1), (0), (1)) u(a), (values (-1), (0), (1)) v(b), (values (-1), (0), (1)) w(c)),
around as (select pt_id, x, y, z, ix + a as ix, iy + b as iy, iz + c as iz from t, n),
e as (select t.pt_id as t_pt_id, s.pt_id as s_pt_id, s.value, sqrt((t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y) + (t.z - s.z) * (t.z - s.z)) as dist from around t join s on t.ix = s.ix and t.iy = s.iy and t.iz = s.iz),
k as (select *, cast(row_number() over (partition by t_pt_id order by dist, s_pt_id) as int) as rank from e where dist < {RADIUS})"""


def _sides(spark, sf):
    points = events_points(spark, sf)
    return points, points.withColumn("lat", F.col("lat") + 0.05)


def _edges(spark, sf, k):
    source, target = _sides(spark, sf)
    return knn.knn_join(source, target, RADIUS, k, ["pt_id"], ["pt_id"]), source


@query(f"{PAIRS_SQL} select t_pt_id as pt_id, s_pt_id, round(dist, 3) as dist from k where rank = 1")
def knn_nearest(spark, sf):
    edges, _ = _edges(spark, sf, 1)
    return edges.select(F.col("t_pt_id").alias("pt_id"), "s_pt_id", _r(F.col("dist"), 3).alias("dist"))


@query(f"{PAIRS_SQL} select t_pt_id, rank, s_pt_id, round(dist, 3) as dist from k where rank <= 4")
def knn_k(spark, sf):
    edges, _ = _edges(spark, sf, 4)
    return edges.withColumn("dist", _r(F.col("dist"), 3))


@query(f"{PAIRS_SQL}, f as (select t_pt_id, value from k where rank = 1) select pt_id, value from (select t.pt_id, f.value from t left join f on t.pt_id = f.t_pt_id)")
def resample_nearest(spark, sf):
    source, target = _sides(spark, sf)
    return knn.nearest(source, target, RADIUS, ["value"], ["pt_id"], ["pt_id"], keep_all=True)


_W = "exp(-(dist * dist) / (150000.0e0 * 150000.0e0))"


@query(f"{PAIRS_SQL} select t_pt_id as pt_id, round(sum(case when value is not null then {_W} * value end) / sum(case when value is not null then {_W} end), 6) as value from k where rank <= 8 group by t_pt_id")
def resample_gauss(spark, sf):
    edges, source = _edges(spark, sf, 8)
    return knn.weighted(edges, source, knn.gauss(150_000.0), ["value"], ["pt_id"], ["pt_id"]).withColumn("value", _r(F.col("value")))


@query(f"""{PAIRS_SQL}, w as (select t_pt_id, value, {_W} as w from k where rank <= 8 and value is not null),
a as (select t_pt_id, sum(w) as v1, sum(w * w) as v2, sum(w * value) / sum(w) as m, count(*) as n from w group by t_pt_id),
v as (select w.t_pt_id, sum(w * (value - m) * (value - m)) as q from w join a on w.t_pt_id = a.t_pt_id group by w.t_pt_id),
ts as (select distinct t_pt_id from k where rank <= 8)
select ts.t_pt_id as pt_id, round(m, 6) as value, round(case when n > 1 then sqrt(v1 / (v1 * v1 - v2) * q) end, 4) as value_stddev, coalesce(n, 0) as value_n from ts left join a on ts.t_pt_id = a.t_pt_id left join v on v.t_pt_id = ts.t_pt_id""")
def resample_gauss_uncertainty(spark, sf):
    edges, source = _edges(spark, sf, 8)
    out = knn.weighted(edges, source, knn.gauss(150_000.0), ["value"], ["pt_id"], ["pt_id"], uncertainty=True)
    return out.select("pt_id", _r(F.col("value")).alias("value"), _r(F.col("value_stddev"), 4).alias("value_stddev"), "value_n")


@query(f"{PAIRS_SQL} select t_pt_id as pt_id, round(sum(case when value is not null then (1 - dist / 400000.0e0) * value end) / sum(case when value is not null then 1 - dist / 400000.0e0 end), 6) as value from k where rank <= 8 group by t_pt_id")
def resample_custom(spark, sf):
    source, target = _sides(spark, sf)
    out = knn.resample_custom(source, target, RADIUS, lambda d: 1 - d / 400_000.0, ["value"], source_keys=["pt_id"], target_keys=["pt_id"])
    return out.withColumn("value", _r(F.col("value")))


@query(f"{PAIRS_SQL} select k.t_pt_id as pt_id, p.category, p.value from k join p on p.pt_id = k.s_pt_id where rank = 1")
def lut_apply(spark, sf):
    edges, source = _edges(spark, sf, 1)
    return knn.gather(edges, source, ["pt_id"], ["category", "value"]).select(F.col("t_pt_id").alias("pt_id"), "category", "value")


# filters


@query(f"{P}, q as (select pt_id, lon * 1.2e0 as lon, lat * 1.2e0 as lat from p) select pt_id from q where lon between -180 and 180 and lat between -90 and 90")
def legal_filter(spark, sf):
    points = events_points(spark, sf).select("pt_id", (F.col("lon") * 1.2).alias("lon"), (F.col("lat") * 1.2).alias("lat"))
    return filters.legal(points).select("pt_id")


_WIDE = math.degrees((100_000.0 + 2 * EARTH_RADIUS * math.sin(math.radians(0.5) / 2)) / EARTH_RADIUS)


@query(f"{P} select pt_id from p where lat between {-9.45 - _WIDE!r} and {10.05 + _WIDE!r} and lon between {-11.95 - _WIDE / math.cos(math.radians(10.05 + _WIDE))!r} and {17.55 + _WIDE / math.cos(math.radians(10.05 + _WIDE))!r}")
def boundary_reduce(spark, sf):
    return filters.reduce_to_area(events_points(spark, sf), FINE, 100_000.0).select("pt_id")


@query(f"""{P}, c as (select pt_id, lon, lat, lon / 1.0e0 + 50.0e0 as c, 50.0e0 - lat / 1.0e0 as r from p)
select pt_id from c where c > -1 and c < 100 and r > -1 and r < 100 and (cast(trunc(c) as int) + cast(trunc(r) as int)) % 3 = 0""")
def grid_filter(spark, sf):
    mask = area_grid(spark, RASTER, lonlat=False, xy=False).where("(row + col) % 3 = 0")
    return filters.grid_filter(events_points(spark, sf), mask, RASTER).select("pt_id")


_RASTER_SQL = "with d as (select cast(event_id // 100 as int) as row, cast(event_id % 100 as int) as col, value from events)"


def _raster(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.selectExpr("cast(event_id div 100 as int) as row", "cast(event_id % 100 as int) as col", "value")


@query(f"{_RASTER_SQL} select row - 40 as row, col - 38 as col, value from d where row between 40 and 59 and col between 38 and 67")
def area_crop(spark, sf):
    target = AreaSpec.make(RASTER.crs, 15, 10, (-12, -10, 18, 10))
    out, area = filters.crop_to_area(_raster(spark, sf), RASTER, target)
    assert area.shape == (20, 30)
    return out


@query(f"{_RASTER_SQL} select (row - 10) // 3 as row, (col - 5) // 2 as col, value from d where row >= 10 and row < 70 and (row - 10) % 3 = 0 and col >= 5 and col < 90 and (col - 5) % 2 = 0")
def strided_slice(spark, sf):
    return filters.slice_pixels(_raster(spark, sf), slice(10, 70, 3), slice(5, 90, 2))


@query(f"{P}, v as (select pt_id, cos(radians(lat)) * cos(radians(lon)) as x, cos(radians(lat)) * sin(radians(lon)) as y, sin(radians(lat)) as z from p) select pt_id from v where x > 0 and y > 0 and z > 0")
def in_octant(spark, sf):
    # the octant between the equator and two meridians, open: points on its edges are left to neither side
    x, y, z = geocentric_xyz(F.col("lon"), F.col("lat"))
    points = events_points(spark, sf).where((F.abs(x) > 1e-3) & (F.abs(y) > 1e-3) & (F.abs(z) > 1e-3))
    from gridloom.functions.sphere import inside_corners

    return points.where(inside_corners(F.col("lon"), F.col("lat"), [(0.0, 90.0), (90.0, 0.0), (0.0, 0.0)])).select("pt_id")


SQL["in_octant"] = SQL["in_octant"].replace("x > 0 and y > 0 and z > 0", "x > 1.6e-10 and y > 1.6e-10 and z > 1.6e-10")


# index gathers


@query(f"""{_RASTER_SQL}, s as (select cast(i // 50 as int) as row, cast(i % 50 as int) as col, cast((i // 50) * 3 - 5 as int) as s_row, cast((i % 50) * 2 + 7 as int) as s_col from range(2000) t(i))
select s.row, s.col, coalesce(d.value, -1.0e0) as value from s left join d on d.row = s.s_row and d.col = s.s_col""")
def linesample_gather(spark, sf):
    samples = spark.range(2000).selectExpr("cast(id div 50 as int) as row", "cast(id % 50 as int) as col", "cast((id div 50) * 3 - 5 as int) as s_row", "cast((id % 50) * 2 + 7 as int) as s_col")
    return grid.gather_lines(samples, _raster(spark, sf), ["value"], -1.0)


_FINE_SQL = "t as (select cast(i // 60 as int) as row, cast(i % 60 as int) as col, -11.95e0 + (i % 60) * 0.5e0 as lon, 10.05e0 - (i // 60) * 0.5e0 as lat from range(2400) t(i))"


@query(f"{_RASTER_SQL}, {_FINE_SQL} select t.row, t.col, value from t left join d on d.row = cast(trunc(50.0e0 - lat) as int) and d.col = cast(trunc(lon + 50.0e0) as int)")
def quick_grid(spark, sf):
    return grid.quick_grid(_raster(spark, sf), RASTER, FINE, ["value"])


# interpolation


@query(f"{_RASTER_SQL}, {_FINE_SQL} select t.row, t.col, value from t join d on d.row = cast(round_even(49.5e0 - lat, 0) as int) and d.col = cast(round_even(lon + 49.5e0, 0) as int)")
def gradient_nearest_area(spark, sf):
    return gradient.resample_gradient(_raster(spark, sf), RASTER, FINE, ["value"], "nearest")


@query(f"""{_RASTER_SQL}, {_FINE_SQL}, f as (select row, col, 49.5e0 - lat as sy, lon + 49.5e0 as sx from t),
g as (select row, col, cast(floor(sy) as int) + i as r, cast(floor(sx) as int) + j as c, (case when i = 1 then sy - floor(sy) else 1 - (sy - floor(sy)) end) * (case when j = 1 then sx - floor(sx) else 1 - (sx - floor(sx)) end) as w
  from f, (values (0), (1)) a(i), (values (0), (1)) b(j))
select g.row, g.col, round(sum(w * value), 6) as value from g join d on d.row = g.r and d.col = g.c where w > 0 group by g.row, g.col having abs(sum(w) - 1) < 1e-9""")
def gradient_bilinear_area(spark, sf):
    out = gradient.resample_gradient(_raster(spark, sf), RASTER, FINE, ["value"], "bilinear").where("value is not null")
    return out.withColumn("value", _r(F.col("value")))


@query(f"""with s as ({SWATH_SQL}), w as (select row, col, lon, lag(lon) over (partition by row order by col) as b, lead(lon) over (partition by row order by col) as a, lat, lag(lat) over (partition by col order by row) as u, lead(lat) over (partition by col order by row) as d from s)
select row, col, round(case when b is null then a - lon when a is null then lon - b else (a - b) / 2 end, 6) as lon_col, round(case when u is null then d - lat when d is null then lat - u else (d - u) / 2 end, 6) as lat_row from w""")
def coordinate_gradients(spark, sf):
    out = gradient.coordinate_gradients(events_swath(spark, sf), ["lon", "lat"])
    return out.select("row", "col", _r(F.col("lon_col")).alias("lon_col"), _r(F.col("lat_row")).alias("lat_row"))


_SWATH_AREA = AreaSpec.make("+proj=longlat +datum=WGS84", 20, 12, (-92, 15, -82, 21), "inside the swath")


# on a swath that is linear in row and column one Newton step ends at the pixel's place: row and column by Cramer's rule
@query(f"""with s as ({SWATH_SQL}), t as (select cast(i // 20 as int) as row, cast(i % 20 as int) as col, -91.75e0 + (i % 20) * 0.5e0 as lon, 20.75e0 - (i // 20) * 0.5e0 as lat from range(240) t(i)),
f as (select row, col, ((lon + 95) * 0.05e0 - (lat - 15) * 0.01e0) / (0.4e0 * 0.05e0 + 0.02e0 * 0.01e0) as c, ((lat - 15) * 0.4e0 + (lon + 95) * 0.02e0) / (0.4e0 * 0.05e0 + 0.02e0 * 0.01e0) as r from t),
m as (select max(row) as r1 from s), g as (select f.row, f.col, cast(floor(r) as int) + i as sr, cast(floor(c) as int) + j as sc, (case when i = 1 then r - floor(r) else 1 - (r - floor(r)) end) * (case when j = 1 then c - floor(c) else 1 - (c - floor(c)) end) as w from f, m, (values (0), (1)) a(i), (values (0), (1)) b(j) where r between 0 and r1 and c between 0 and 49)
select g.row, g.col, round(sum(w * value), 3) as value from g join s on s.row = g.sr and s.col = g.sc where w > 1e-9 group by g.row, g.col having count(value) = count(*) and abs(sum(w) - 1) < 1e-6""")
def gradient_bilinear_swath(spark, sf):
    swath_ = events_swath(spark, sf)
    indices = gradient.swath_indices(swath_, _SWATH_AREA, 60_000.0)
    # a hair's breadth from a whole index is the index
    snap = lambda c: F.when(F.abs(F.col(c) - F.rint(c)) < 1e-7, F.rint(c)).otherwise(F.col(c))
    out = gradient.take_bilinear(indices.withColumns({"sx": snap("sx"), "sy": snap("sy")}), swath_, ["value"])
    return out.where("value is not null").withColumn("value", _r(F.col("value"), 3))


# on a grid-like source, the quadrants of a target are the corners of its grid square
@query(f"""{_RASTER_SQL}, t as (select cast(i // 20 as int) as row, cast(i % 20 as int) as col, -9.8e0 + (i % 20) as lon, 9.7e0 - (i // 20) as lat from range(400) t(i)),
f as (select row, col, 49.5e0 - lat as sy, lon + 49.5e0 as sx from t),
g as (select row, col, cast(floor(sy) as int) + i as r, cast(floor(sx) as int) + j as c, (case when i = 1 then sy - floor(sy) else 1 - (sy - floor(sy)) end) * (case when j = 1 then sx - floor(sx) else 1 - (sx - floor(sx)) end) as w from f, (values (0), (1)) a(i), (values (0), (1)) b(j))
select g.row, g.col, round(sum(w * value), 4) as value from g join d on d.row = g.r and d.col = g.c group by g.row, g.col having count(value) = 4""")
def resample_bilinear(spark, sf):
    source = area_grid(spark, RASTER, xy=False).join(_raster(spark, sf), ["row", "col"])
    target = AreaSpec.make(RASTER.crs, 20, 20, (-10.3, -9.8, 9.7, 10.2))
    out = bilinear.resample_bilinear(source, target, 250_000.0, ["value"], k=16)
    return out.where("value is not null").withColumn("value", _r(F.col("value"), 4))


# elliptical weighted averaging

_EWA_SQL = f"""with s as ({SWATH_SQL}), x as (select *, row // 10 as scan, (lon + 95.75e0) / 0.5e0 as gc, (65.75e0 - lat) / 0.5e0 as gr from s),
b as (select scan, min(row) as r0, max(row) as r1 from x group by scan),
m as (select x.scan, col, max(case when row = r0 + (r1 - r0 + 1) // 2 then gc end) as mu, max(case when row = r0 + (r1 - r0 + 1) // 2 then gr end) as mv, max(case when row = r0 then gc end) as fu, max(case when row = r0 then gr end) as fv, max(case when row = r1 then gc end) as lu, max(case when row = r1 then gr end) as lv, max(r1 - r0) as n from x join b on x.scan = b.scan group by x.scan, col),
e as (select scan, col, (lead(mu) over w - lag(mu) over w) / 2 as ux, (lead(mv) over w - lag(mv) over w) / 2 as vx, (lu - fu) / greatest(n, 1) as uy, (lv - fv) / greatest(n, 1) as vy from m window w as (partition by scan order by col)),
q as (select scan, col, (vx * vx + vy * vy) * f as a, -(ux * vx + uy * vy) * 2 * f as b, (ux * ux + uy * uy) * f as c from (select *, 1 / greatest((ux * vy - uy * vx) * (ux * vy - uy * vx), 1e-8) as f from e)),
d as (select *, least(sqrt(c * k), 10.0e0) as ud, least(sqrt(a * k), 10.0e0) as vd from (select *, 4 / greatest(4 * a * c - b * b, 1e-8) as k from q)),
z as (select scan, col, case when col = 0 then lead(a) over w when col = 49 then lag(a) over w else a end as a, case when col = 0 then lead(b) over w when col = 49 then lag(b) over w else b end as b, case when col = 0 then lead(c) over w when col = 49 then lag(c) over w else c end as c,
  case when col = 0 then lead(ud) over w when col = 49 then lag(ud) over w else ud end as ud, case when col = 0 then lead(vd) over w when col = 49 then lag(vd) over w else vd end as vd from d window w as (partition by scan order by col)),
u as (select x.row as srow, x.col as scol, gc, gr, value, a, b, c, unnest(range(greatest(cast(trunc(gc - ud) as int), 0), least(cast(trunc(gc + ud) as int), 63) + 1)) as u, ud, vd from x join z on x.scan = z.scan and x.col = z.col where gc + ud >= 0 and gr + vd >= 0 and gc - ud < 64 and gr - vd < 104),
v as (select *, unnest(range(greatest(cast(trunc(gr - vd) as int), 0), least(cast(trunc(gr + vd) as int), 103) + 1)) as v from u),
h as (select *, exp(least(floor(q * 10000), 9999) * (ln(0.01e0) / 9999)) as w from (select *, a * (u - gc) * (u - gc) + b * (u - gc) * (v - gr) + c * (v - gr) * (v - gr) as q from v) where q >= 0 and q < 1)"""


def _ewa(spark, sf, **more):
    return ewa.resample_ewa(events_swath(spark, sf), EWA, ["value"], 10, **more)


@query(f"{_EWA_SQL} select cast(v as int) as row, cast(u as int) as col, round(sum(w * value) / sum(w), 4) as value from h where value is not null group by all having sum(w) >= 0.01")
def ewa_mean(spark, sf):
    return _ewa(spark, sf).withColumn("value", _r(F.col("value"), 4))


@query(f"""{_EWA_SQL}, k as (select v, u, value, max(w) over (partition by v, u) as m, row_number() over (partition by v, u order by w desc, srow, scol) as i from h where value is not null)
select cast(v as int) as row, cast(u as int) as col, value from k where i = 1 and m >= 0.01""")
def ewa_max_weight(spark, sf):
    return _ewa(spark, sf, maximum_weight_mode=True)


# swaths, areas, polygons


@query(f"""with s as ({SWATH_SQL}), x as (select row // 4 as row, col // 5 as col, avg(cos(radians(lat)) * cos(radians(lon))) as x, avg(cos(radians(lat)) * sin(radians(lon))) as y, avg(sin(radians(lat))) as z, avg(value) as value from s group by row // 4, col // 5)
select cast(row as int) as row, cast(col as int) as col, round(degrees(atan2(y, x)), 6) as lon, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) as lat, round(value, 6) as value from x""")
def swath_aggregate(spark, sf):
    out = swath.aggregate(events_swath(spark, sf), 4, 5)
    return out.select("row", "col", *[_r(F.col(c)).alias(c) for c in ("lon", "lat", "value")])


@query(f"with s as ({SWATH_SQL}), a as (select * from s where row < 7), b as (select * from s where row between 10 and 14) select row, col, value from a union all select cast(row - 10 + 7 as int) as row, col, value from b")
def swath_concat(spark, sf):
    s = events_swath(spark, sf).select("row", "col", "value")
    return swath.concatenate(s.where("row < 7"), s.where("row between 10 and 14").withColumn("row", F.col("row") - 10))


@query(f"""{P}, xy as (select 6378137.0e0 * radians(lon) as x, -6378137.0e0 * ln(tan(pi() / 4 - radians(lat) / 2) / pow((1 - {_E} * sin(radians(lat))) / (1 + {_E} * sin(radians(lat))), {_E} / 2)) as y from p)
select round(min(x), 2) as x_min, round(min(y), 2) as y_min, round(max(x), 2) as x_max, round(max(y), 2) as y_max from xy""")
def domain_extent(spark, sf):
    out = swath.extent(events_points(spark, sf), MERC.crs)
    return out.select(*[_r(F.col(c), 2).alias(c) for c in out.columns])


@query(f"""with s as ({SWATH_SQL}), m as (select max(row) as h, 49 as w from s where col = 49), e as (select case when row = 0 then col when col = w then w + row when row = h then w + h + (w - col) when col = 0 then 2 * w + h + (h - row) end as i, lon, lat from s, m) select cast(i as int) as i, round(lon, 6) as lon, round(lat, 6) as lat from e where i is not null""")
def swath_outline(spark, sf):
    out = swath.outline(events_swath(spark, sf))
    return out.select("i", _r(F.col("lon")).alias("lon"), _r(F.col("lat")).alias("lat"))


@query("""select cast(i // 60 as int) as row, cast(i % 60 as int) as col, round(-177.0e0 + (i % 60) * 6.0e0, 6) as x, round(87.0e0 - (i // 60) * 6.0e0, 6) as y, round(-177.0e0 + (i % 60) * 6.0e0, 6) as lon, round(87.0e0 - (i // 60) * 6.0e0, 6) as lat from range(1800) t(i)""")
def area_scan(spark, sf):
    out = area_grid(spark, GLOBE)
    return out.select("row", "col", *[_r(F.col(c)).alias(c) for c in ("x", "y", "lon", "lat")])


@query("""select cast(i // 40 as int) as row, cast(i % 40 as int) as col, round(degrees((-19500000.0e0 + (i % 40) * 1000000.0e0) / 6371228.0e0), 6) as lon, round(degrees(pi() / 2 - 2 * atan(exp(-(19500000.0e0 - (i // 40) * 1000000.0e0) / 6371228.0e0))), 6) as lat from range(1600) t(i)""")
def area_scan_mercator(spark, sf):
    area = AreaSpec.make("+proj=merc +R=6371228", 40, 40, (-20e6, -20e6, 20e6, 20e6))
    out = area_grid(spark, area, xy=False)
    return out.select("row", "col", *[_r(F.col(c)).alias(c) for c in ("lon", "lat")])


@query("""select cast(i // 10 as int) as row, cast(i % 10 as int) as col, round(5.0e0 + (i % 10) * 10.0e0, 6) as lon, round(case when i // 10 < 4 then 85.0e0 - (i // 10) * 10.0e0 else 25.0e0 - (i // 10 - 4) * 10.0e0 end, 6) as lat from range(70) t(i)""")
def stacked_area(spark, sf):
    crs = "+proj=longlat +datum=WGS84"
    parts = AreaSpec.make(crs, 10, 2, (0, 70, 100, 90)), AreaSpec.make(crs, 10, 2, (0, 50, 100, 70)), AreaSpec.make(crs, 10, 3, (0, 0, 100, 30))
    stack = StackedArea.of(*parts)
    assert [a.height for a in stack.areas] == [4, 3]
    out = area_grid(spark, stack, xy=False)
    return out.select("row", "col", _r(F.col("lon")).alias("lon"), _r(F.col("lat")).alias("lat"))


# squares of degrees: the integral of their great-circle edges, by the angle at which an edge's great circle is seen from the pole
@query(f"""{P}, c as (select pt_id, lon, lat * 0.5e0 as lat, 3.0e0 as w from p),
t as (select pt_id, radians(w) as w, radians(lat) as lo, radians(lat + w) as hi from c)
select pt_id, round(2 * atan2(tan(w / 2) * (sin(hi)), 1) - 2 * atan2(tan(w / 2) * sin(lo), 1), 8) as area from t""")
def polygon_areas(spark, sf):
    # clockwise from the lower left
    lon, lat = F.col("lon"), F.col("lat") * 0.5
    point = lambda a, b: F.struct(F.radians(a).alias("lon"), F.radians(b).alias("lat"))
    ring = F.array(point(lon, lat), point(lon, lat + 3.0), point(lon + 3.0, lat + 3.0), point(lon + 3.0, lat))
    rows = events_points(spark, sf).select("pt_id", ring.alias("ring"))
    return rows.select("pt_id", _r(polygon_area_column(F.col("ring")), 8).alias("area"))


def _boxes(spark):
    """Squares of four degrees in rows: the first ten overlap in a chain, the others stand alone."""
    point = lambda a, b: F.struct(F.radians(a).alias("lon"), F.radians(b).alias("lat"))
    lon = F.when(F.col("id") < 10, F.col("id") * 3.0).otherwise((F.col("id") - 10) * 6.0)
    lat = F.when(F.col("id") < 10, F.lit(0.0)).otherwise(F.lit(20.0))
    ring = F.array(point(lon, lat), point(lon, lat + 4.0), point(lon + 4.0, lat + 4.0), point(lon + 4.0, lat))
    return spark.range(20).select("id", ring.alias("points"))


@query("""select a, a + 1 as b from range(9) t(a)""")
def polygon_overlap_pairs(spark, sf):
    return polygons.overlapping_pairs(_boxes(spark))


@query('select i as id, case when i < 10 then 0 else i end as "group" from range(20) t(i)')
def polygon_overlap_groups(spark, sf):
    return polygons.overlap_groups(_boxes(spark))


@query(f"""{_RASTER_SQL} select row // 5 as row, col // 4 as col, round(avg(value), 6) as value from d where row < 5 * (select (max(row) + 1) // 5 from d) group by row // 5, col // 4""")
def block_means(spark, sf):
    data = _raster(spark, sf)
    height = (data.agg(F.coalesce(F.max("row"), F.lit(-1))).first()[0] + 1) // 5 * 5
    source = AreaSpec.make(RASTER.crs, 100, height, RASTER.extent) if height else RASTER
    target = AreaSpec.make(RASTER.crs, 25, source.height // 5, RASTER.extent)

    def mean(block, source, own):
        # the window is a pixel wider where the tile ends inside the source
        r0, c0 = (int(round(v)) for v in (np.array(source.array_coordinates(own.extent[0], own.extent[3]))[::-1] + 0.5))
        part = block[r0 : r0 + own.height * 5, c0 : c0 + own.width * 4]
        return part.reshape(own.height, 5, own.width, 4).mean((1, 3))

    out = blocks.resample_blocks(mean, data.where(F.col("row") < source.height), source, target, tile=10)
    return out.select("row", "col", _r(F.col("value")).alias("value"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: mean value of events by Mercator cell."""
    return bucket_stats(spark, sf_dir)
