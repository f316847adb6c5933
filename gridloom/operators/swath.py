"""Swaths as tables: joining, coarsening, outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.errors import DimensionError
from gridloom.functions.mathx import geocentric_xyz, geographic


def concatenate(first: DataFrame, second: DataFrame, crs=None, other_crs=None) -> DataFrame:
    """The rows of ``second`` below those of ``first``."""
    if set(first.columns) != set(second.columns):
        raise DimensionError("swaths of different columns")
    if crs is not None and other_crs is not None and crs != other_crs:
        raise ValueError("swaths of different systems")
    last = first.agg(F.coalesce(F.max("row"), F.lit(-1)).alias("_last"))
    moved = second.crossJoin(F.broadcast(last)).withColumn("row", (F.col("row") + F.col("_last") + 1).cast(first.schema["row"].dataType)).drop("_last")
    return first.unionByName(moved)


def aggregate(swath: DataFrame, y: int, x: int) -> DataFrame:
    """Locations (and ``value`` means, if there are) of blocks of ``y`` rows and ``x`` columns, averaged in space."""
    px, py, pz = geocentric_xyz(F.col("lon"), F.col("lat"))
    values = [c for c in swath.columns if c not in ("row", "col", "lon", "lat")]
    by = swath.groupBy(F.expr(f"cast(row div {y} as int)").alias("row"), F.expr(f"cast(col div {x} as int)").alias("col"))
    mean = by.agg(F.avg(px).alias("_x"), F.avg(py).alias("_y"), F.avg(pz).alias("_z"), *[F.avg(c).alias(c) for c in values])
    lon, lat = geographic(F.col("_x"), F.col("_y"), F.col("_z"))
    return mean.select("row", "col", lon.alias("lon"), lat.alias("lat"), *values)


def extent(points: DataFrame, crs) -> DataFrame:
    """One row ``x_min, y_min, x_max, y_max`` of the points in a projection."""
    x, y = crs.forward(F.col("lon"), F.col("lat"))
    placed = points.select(x.alias("x"), y.alias("y")).where("not isnan(x) and not isnan(y)")
    return placed.agg(F.min("x").alias("x_min"), F.min("y").alias("y_min"), F.max("x").alias("x_max"), F.max("y").alias("y_max"))


def outline(swath: DataFrame, every: int = 1) -> DataFrame:
    """``i, lon, lat`` of the edge pixels, clockwise from the first: top, right, bottom, left; every ``every``-th and the corners."""
    size = swath.agg(F.max("row").alias("_r"), F.max("col").alias("_c"))
    rows = swath.crossJoin(F.broadcast(size))  # one row
    r, c, h, w = F.col("row"), F.col("col"), F.col("_r"), F.col("_c")
    at = F.when(r == 0, c).when(c == w, w + r).when(r == h, w + h + (w - c)).when(c == 0, 2 * w + h + (h - r))
    corner = r.isin(0) & c.isin(0) | (r == 0) & (c == w) | (r == h) & (c == w) | (r == h) & (c == 0)
    return rows.withColumn("i", at).where(F.col("i").isNotNull() & (corner | (F.col("i") % every == 0))).select("i", "lon", "lat")
