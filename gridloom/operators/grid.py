"""Index gathers: linesamples and the quick grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.knn import knn_join
from gridloom.plans.area import AreaSpec
from gridloom.sources.scans import area_grid


def gather_lines(samples: DataFrame, data: DataFrame, values: list[str], fill: float | None = None) -> DataFrame:
    """``row, col`` and the values at ``s_row, s_col`` of ``samples``; outside the data missing, or ``fill``."""
    side = data.select(F.col("row").alias("s_row"), F.col("col").alias("s_col"), *values)
    out = samples.join(side, ["s_row", "s_col"], "left").select("row", "col", *values)
    return out if fill is None else out.fillna(fill, subset=values)


def quick_samples(target: DataFrame, source: AreaSpec) -> DataFrame:
    """``row, col, s_row, s_col``: the source pixel of every target location, its fraction cut off towards zero."""
    x, y = source.crs.forward(F.col("lon"), F.col("lat"))
    off_x, off_y = source.pixel_offset
    col, row = x / source.pixel_size_x + off_x, F.lit(off_y) - y / source.pixel_size_y
    cut = lambda v: F.when(~F.isnan(v) & (F.abs(v) < 2**31), v).cast("int")
    return target.select("row", "col", cut(row).alias("s_row"), cut(col).alias("s_col"))


def quick_grid(data: DataFrame, source: AreaSpec, target: DataFrame | AreaSpec, values: list[str], fill: float | None = None) -> DataFrame:
    """The source pixel under every target location."""
    if isinstance(target, AreaSpec):
        target = area_grid(data.sparkSession, target, xy=False)
    return gather_lines(quick_samples(target, source), data, values, fill)


def nearest_samples(source: DataFrame, target: DataFrame, radius: float) -> DataFrame:
    """``row, col, s_row, s_col`` of the nearest source; targets without one keep missing indices."""
    edges = knn_join(source, target, radius)
    found = edges.select(F.col("t_row").alias("row"), F.col("t_col").alias("col"), "s_row", "s_col")
    return target.select("row", "col").join(found, ["row", "col"], "left")
