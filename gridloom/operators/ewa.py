"""Elliptical weighted averaging: each swath pixel spreads over the cells of its footprint.

Per scan, windows give the ellipse of every column; pixels are exploded into the
cells within it and one aggregation sums weights and weighted values, with
partial sums before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.filters import legal
from gridloom.plans.area import AreaSpec


def ll2cr(swath: DataFrame, area: AreaSpec) -> DataFrame:
    """The swath with fractional ``gc`` and ``gr`` (column and row of the grid); missing off the earth."""
    gc, gr = area.array_coordinates_lonlat(F.col("lon"), F.col("lat"))
    ok = F.col("lon").between(-180.0, 180.0) & F.col("lat").between(-90.0, 90.0)
    real = lambda c: F.when(ok & ~F.isnan(c) & (F.abs(c) < 1e30), c)
    return swath.withColumns({"gc": real(gc), "gr": real(gr)})


def points_in_grid(placed: DataFrame, area: AreaSpec) -> int:
    """How many pixels of ``ll2cr`` lie on the grid, one cell around it included."""
    near = F.col("gc").between(-1, area.width + 1) & F.col("gr").between(-1, area.height + 1)
    return placed.select(F.count_if(near)).first()[0]


def ll2cr_dynamic(swath: DataFrame, crs, cell: tuple[float, float], antimeridian: bool = True) -> tuple[DataFrame, AreaSpec]:
    """Origin and size of the grid from the data, then its coordinates.

    Where the data span three quarters of the way around and more, negative x
    count from the other side.
    """
    x, y = crs.forward(F.col("lon"), F.col("lat"))
    placed = legal(swath).select(x.alias("x"), y.alias("y")).where("not isnan(x) and not isnan(y)")
    way = 360.0 if crs.geographic else 2 * math.pi * crs.a
    shifted = F.when(F.col("x") < 0, F.col("x") + way).otherwise(F.col("x"))
    b = placed.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min(shifted).alias("s0"), F.max(shifted).alias("s1")).first()
    if b.x0 is None:
        raise ValueError("no location on earth")
    low, high = (b.s0, b.s1) if antimeridian and b.x1 - b.x0 >= 0.75 * way else (b.x0, b.x1)
    cx, cy = abs(cell[0]), abs(cell[1])
    width, height = int((high - low) / cx + 1.5), int((b.y1 - b.y0) / cy + 1.5)
    area = AreaSpec.make(crs, width, height, (low - cx / 2, b.y1 + cy / 2 - height * cy, low - cx / 2 + width * cx, b.y1 + cy / 2))
    out = ll2cr(swath, area)
    if low != b.x0:
        out = out.withColumn("gc", F.when(F.col("gc") < -0.5, F.col("gc") + way / cx).otherwise(F.col("gc")))
    return out, area


def ellipses(placed: DataFrame, rows_per_scan: int, count: int = 10000, weight_min: float = 0.01, distance_max: float = 1.0, delta_max: float = 10.0) -> DataFrame:
    """``scan, col, ea, eb, ec, ef, udel, vdel``: the quadratic form of every column's footprint and its half width and height.

    Across, differences between the neighbours on the middle row; down, first to
    last row of the scan. The outermost columns take over their neighbours'.
    """
    qmax = distance_max**2
    scan = F.expr(f"cast(row div {rows_per_scan} as int)") if rows_per_scan else F.lit(0)
    rows = placed.withColumn("scan", scan)
    span = rows.groupBy("scan").agg(F.min("row").alias("first"), F.max("row").alias("last"))
    rows = rows.join(span, "scan")
    middle = F.col("first") + F.expr("(last - first + 1) div 2")
    at = lambda c, where: F.max(F.when(where, F.col(c)))
    first, last, mid = F.col("row") == F.col("first"), F.col("row") == F.col("last"), F.col("row") == middle
    cols = rows.groupBy("scan", "col").agg(
        at("gc", mid).alias("mu"), at("gr", mid).alias("mv"), at("gc", first).alias("fu"), at("gr", first).alias("fv"), at("gc", last).alias("lu"), at("gr", last).alias("lv"), F.first("first").alias("a"), F.first("last").alias("b")
    )
    w = Window.partitionBy("scan").orderBy("col")
    down = F.greatest(F.col("b") - F.col("a"), F.lit(1)).cast("double")
    ux, vx = ((F.lead(c).over(w) - F.lag(c).over(w)) / 2 * distance_max for c in ("mu", "mv"))
    uy, vy = ((F.col(l) - F.col(f)) / down * distance_max for f, l in (("fu", "lu"), ("fv", "lv")))
    cols = cols.withColumns({"ux": ux, "vx": vx, "uy": uy, "vy": vy})
    det = F.col("ux") * F.col("vy") - F.col("uy") * F.col("vx")
    f = F.lit(qmax) / F.greatest(det * det, F.lit(1e-8))
    a = (F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")) * f
    b = -(F.col("ux") * F.col("vx") + F.col("uy") * F.col("vy")) * 2 * f
    c = (F.col("ux") * F.col("ux") + F.col("uy") * F.col("uy")) * f
    cols = cols.withColumns({"ea": a, "eb": b, "ec": c})
    d = F.lit(4 * qmax) / F.greatest(F.col("ea") * F.col("ec") * 4 - F.col("eb") * F.col("eb"), F.lit(1e-8))
    cap = lambda v: F.least(F.sqrt(v * d), F.lit(float(delta_max)))
    cols = cols.withColumns({"udel": cap(F.col("ec")), "vdel": cap(F.col("ea"))})
    names = ["ea", "eb", "ec", "udel", "vdel"]
    edge = lambda n: F.when(F.lag("col").over(w).isNull(), F.lead(n).over(w)).when(F.lead("col").over(w).isNull(), F.lag(n).over(w)).otherwise(F.col(n))
    empty = {"ea": 0.0, "eb": 0.0, "ec": 0.0, "udel": float(delta_max), "vdel": float(delta_max)}
    return cols.select("scan", "col", *[F.coalesce(edge(n), F.lit(empty[n])).alias(n) for n in names])


def weight(q: Column, count: int, weight_min: float, distance_max: float) -> Column:
    """exp(-alpha q), constant within ``count`` steps from zero to the edge, where it is ``weight_min``."""
    if count < 2 or weight_min <= 0 or distance_max <= 0:
        raise ValueError("count must be 2 at least, weight_min and distance_max positive")
    qmax = distance_max**2
    step = F.least(F.floor(q * (count / qmax)), F.lit(count - 1))
    return F.exp(step * (math.log(weight_min) / (count - 1)))


def fornav(
    placed: DataFrame, area: AreaSpec, values: list[str], rows_per_scan: int, weight_count: int = 10000, weight_min: float = 0.01, weight_distance_max: float = 1.0, weight_delta_max: float = 10.0, weight_sum_min: float = -1.0, maximum_weight_mode: bool = False
) -> DataFrame:
    """``row, col`` and values of the grid cells that gather weight enough, from a swath placed by ``ll2cr``.

    In maximum-weight mode a cell takes the value of its heaviest pixel (the
    first in scan order, of equals) instead of the mean. Missing values and
    places spread nothing.
    """
    least = weight_min if weight_sum_min == -1 else weight_sum_min
    least = 1e-8 if least <= 0 else least
    shape = ellipses(placed, rows_per_scan, weight_count, weight_min, weight_distance_max, weight_delta_max)
    scan = F.expr(f"cast(row div {rows_per_scan} as int)") if rows_per_scan else F.lit(0)
    value = [F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")).alias(f"v_{v}") for v in values]
    pixels = placed.where("gc is not null and gr is not null").select(scan.alias("scan"), "row", "col", "gc", "gr", *value)
    pixels = pixels.join(shape, ["scan", "col"])
    low = lambda c, d: F.greatest((F.col(c) - F.col(d)).cast("int"), F.lit(0))
    high = lambda c, d, n: F.least((F.col(c) + F.col(d)).cast("int"), F.lit(n - 1))
    hits = (F.col("gc") + F.col("udel") >= 0) & (F.col("gr") + F.col("vdel") >= 0) & (F.col("gc") - F.col("udel") < area.width) & (F.col("gr") - F.col("vdel") < area.height)
    near = pixels.where(hits).withColumns({"u1": low("gc", "udel"), "u2": high("gc", "udel", area.width), "v1": low("gr", "vdel"), "v2": high("gr", "vdel", area.height)})
    near = near.where("u1 <= u2 and v1 <= v2")
    across = near.withColumn("u", F.explode(F.sequence("u1", "u2")))
    cells = across.withColumn("v", F.explode(F.sequence("v1", "v2")))
    du, dv = F.col("u") - F.col("gc"), F.col("v") - F.col("gr")
    q = F.col("ea") * du * du + F.col("eb") * du * dv + F.col("ec") * dv * dv
    cells = cells.withColumn("q", q).where((F.col("q") >= 0) & (F.col("q") < weight_distance_max**2))
    cells = cells.withColumn("w", weight(F.col("q"), weight_count, weight_min, weight_distance_max))
    out = cells.groupBy(F.col("v").alias("t_row"), F.col("u").alias("t_col"))
    aggs = []
    for v in values:
        seen = F.when(F.col(f"v_{v}").isNotNull(), F.col("w"))
        if maximum_weight_mode:
            key = F.when(F.col(f"v_{v}").isNotNull(), F.struct("w", (-F.col("row")).alias("r"), (-F.col("col")).alias("c")))
            aggs.append(F.when(F.max(seen) >= least, F.max_by(f"v_{v}", key)).alias(v))
        else:
            aggs.append(F.when(F.sum(seen) >= least, F.sum(F.col("w") * F.col(f"v_{v}")) / F.sum(seen)).alias(v))
    found = out.agg(*aggs).select(F.col("t_row").alias("row"), F.col("t_col").alias("col"), *values)
    return found.dropna(how="all", subset=values)


def as_integer(value: Column, kind: str) -> Column:
    """A result as ``byte``, ``short`` or ``int``: half a unit away from zero, then saturated."""
    bound = {"byte": 7, "short": 15, "int": 31}[kind]
    away = F.when(value < 0, F.ceil(value - 0.5)).otherwise(F.floor(value + 0.5))
    return F.least(F.greatest(away, F.lit(-(1 << bound))), F.lit((1 << bound) - 1)).cast(kind)


def resample_ewa(swath: DataFrame, area: AreaSpec, values: list[str], rows_per_scan: int, **options) -> DataFrame:
    """``fornav`` of a swath (row, col, lon, lat, values); ``rows_per_scan`` 0 takes all rows as one scan."""
    return fornav(ll2cr(swath, area), area, values, rows_per_scan, **options)
