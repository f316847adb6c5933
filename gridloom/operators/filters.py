"""Filters on location: legal degrees, boundary reduction, masks, slices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.mathx import EARTH_RADIUS
from gridloom.plans.area import AreaSpec


def legal(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows whose degrees are on earth; NaN compares as larger and goes."""
    return df.where(F.col(lon).between(-180.0, 180.0) & F.col(lat).between(-90.0, 90.0))


def boundary_predicate(sides: list[tuple[np.ndarray, np.ndarray]], radius: float, lon: str = "lon", lat: str = "lat") -> Column | None:
    """A box of degrees around a closed boundary, ``radius`` metres wider; None where no box helps.

    The sum of the turns in longitude tells a pole inside: then all longitudes
    from a latitude on are kept. The bounds are literals, so the scan prunes row
    groups by them. The box only ever admits too much.
    """
    lons, lats = (np.concatenate([s[k] for s in sides]) for k in range(2))
    if not (np.isfinite(lons).all() and np.isfinite(lats).all()) or (np.abs(lons) > 180).any() or (np.abs(lats) > 90).any():
        return None
    wide = np.degrees(radius / EARTH_RADIUS)
    step = np.diff(np.append(lons, lons[0]))
    turn = np.where(np.abs(step) > 180, step - 360 * np.sign(step), step).sum()
    low, high = lats.min() - wide, lats.max() + wide
    at = F.col(lat)
    if round(turn) == -360:
        return at >= float(low)
    if round(turn) == 360:
        return at <= float(high)
    if round(turn) != 0:
        return None
    if max(abs(low), abs(high)) >= 89.9:
        return at.between(float(low), float(high))
    # meridians draw together towards the poles, and great-circle edges bulge: widen by the worst latitude
    buffer = wide / np.cos(np.radians(max(abs(low), abs(high))))
    run = lons[0] + np.concatenate([[0], np.cumsum(np.where(np.abs(step) > 180, step - 360 * np.sign(step), step))[:-1]])
    west, east = run.min() - buffer, run.max() + buffer
    band = at.between(float(low), float(high))
    if east - west >= 360:
        return band
    if west < -180:
        return band & ((F.col(lon) >= float(west + 360)) | (F.col(lon) <= float(east)))
    if east > 180:
        return band & ((F.col(lon) >= float(west)) | (F.col(lon) <= float(east - 360)))
    return band & F.col(lon).between(float(west), float(east))


def reduce_to_area(df: DataFrame, area: AreaSpec, radius: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows that may lie within ``radius`` metres of the area: a superset filter that reaches the scan."""
    found = boundary_predicate(area.sides_lonlat(), radius, lon, lat)
    if found is None:
        return df
    # a boundary of pixel centres: half a pixel more, and the bulge of a step between two of them
    step = max(_largest_step(area), 1.0)
    return df.where(boundary_predicate(area.sides_lonlat(), radius + step, lon, lat))


def _largest_step(area: AreaSpec) -> float:
    lon, lat = area.boundary_lonlat()
    lon, lat = np.radians(np.append(lon, lon[0])), np.radians(np.append(lat, lat[0]))
    xyz = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1) * EARTH_RADIUS
    return float(np.nanmax(np.linalg.norm(np.diff(xyz, axis=0), axis=1)))


def grid_filter(points: DataFrame, mask: DataFrame, area: AreaSpec, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points whose pixel is in ``mask`` (row, col, of the true pixels).

    Pixels are found by cutting the fraction off towards zero, so locations up to
    a pixel above or left of the grid belong to its first row or column.
    """
    x, y = area.crs.forward(F.col(lon), F.col(lat))
    off_x, off_y = area.pixel_offset
    col, row = (x / area.pixel_size_x) + off_x, F.lit(off_y) - (y / area.pixel_size_y)
    near = (F.col("_c") > -1) & (F.col("_c") < area.width) & (F.col("_r") > -1) & (F.col("_r") < area.height)
    placed = points.withColumns({"_c": col, "_r": row}).where("not isnan(_c) and not isnan(_r)").where(near)
    placed = placed.withColumns({"_c": F.col("_c").cast("int"), "_r": F.col("_r").cast("int")})
    true = mask.select(F.col("row").alias("_r"), F.col("col").alias("_c"))
    return placed.join(true, ["_r", "_c"], "left_semi").select(*points.columns)


def slice_pixels(pixels: DataFrame, rows: slice, cols: slice) -> DataFrame:
    """Pixels of a slice, counted anew from its corner; the bounds reach the scan."""
    out = pixels
    for name, s in (("row", rows), ("col", cols)):
        start, step = s.start or 0, s.step or 1
        out = out.where(F.col(name) >= start)
        if s.stop is not None:
            out = out.where(F.col(name) < s.stop)
        if step != 1:
            out = out.where((F.col(name) - start) % step == 0)
        out = out.withColumn(name, F.floor((F.col(name) - start) / step).cast("int"))
    return out


def crop_to_area(pixels: DataFrame, source: AreaSpec, target: AreaSpec) -> tuple[DataFrame, AreaSpec]:
    """The source pixels that cover the target, and their area."""
    cols, rows = source.slices_over(target)
    return slice_pixels(pixels, rows, cols), source.subset(rows, cols)


def in_corners(df: DataFrame, area: AreaSpec, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rows inside the great-circle quadrangle of the area's corners."""
    return df.where(area.contains_lonlat(F.col(lon), F.col(lat)))


def swath_slices(swath: DataFrame, area: AreaSpec, tile: int = 512, radius: float = 0.0) -> DataFrame:
    """``tile_row, row_min, row_max, col_min, col_max`` of swath tiles that may meet the area.

    One aggregation makes a zone map of degrees by tile; tiles whose box does not
    meet the area's are pruned without a look at their pixels.
    """
    tiles = legal(swath).groupBy(F.floor(F.col("row") / tile).cast("int").alias("tile_row"), F.floor(F.col("col") / tile).cast("int").alias("tile_col"))
    boxes = tiles.agg(*[f(c).alias(f"{c}_{n}") for c in ("lon", "lat", "row", "col") for n, f in (("min", F.min), ("max", F.max))])
    lons, lats = area.boundary_lonlat()
    wide = float(np.degrees((radius + _largest_step(area)) / EARTH_RADIUS))
    low, high = float(np.nanmin(lats)) - wide, float(np.nanmax(lats)) + wide
    meets = (F.col("lat_max") >= low) & (F.col("lat_min") <= high)
    if np.isfinite(lons).all() and np.ptp(lons) < 180 and max(abs(low), abs(high)) < 89:
        side = wide / float(np.cos(np.radians(max(abs(low), abs(high)))))
        wraps = F.col("lon_max") - F.col("lon_min") > 180
        meets = meets & (wraps | ((F.col("lon_max") >= float(lons.min()) - side) & (F.col("lon_min") <= float(lons.max()) + side)))
    return boxes.where(meets).select("tile_row", "tile_col", "row_min", "row_max", "col_min", "col_max")
