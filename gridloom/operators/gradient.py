"""Interpolation by fractional source indices.

Where the source is an area, the index of a target is a formula: the array
coordinates of its location. Where it is a swath, the nearest pixel is the seed
and one Newton step on the swath's own coordinate gradients gives the fraction.
Both end in gathers of one or four source pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.filters import crop_to_area
from gridloom.operators.knn import gather, knn_join
from gridloom.plans.area import AreaSpec
from gridloom.sources.scans import area_grid

METHODS = ("bilinear", "nearest", "nn", "nearest_neighbour")


def area_indices(spark, source: AreaSpec, target) -> DataFrame:
    """``row, col, sx, sy``: fractional column and row of the source under each target pixel, or row of a target swath."""
    grid = area_grid(spark, target, xy=False) if isinstance(target, AreaSpec) else target.select("row", "col", "lon", "lat")
    sx, sy = source.array_coordinates_lonlat(F.col("lon"), F.col("lat"))
    out = grid.select("row", "col", F.nanvl(sx, F.lit(None).cast("double")).alias("sx"), F.nanvl(sy, F.lit(None).cast("double")).alias("sy"))
    return out.where(F.col("sx").between(0, source.width - 1) & F.col("sy").between(0, source.height - 1))


def swath_indices(source: DataFrame, target: AreaSpec, radius: float) -> DataFrame:
    """The same for a swath source (row, col, lon, lat), in the target's projection."""
    x, y = target.crs.forward(F.col("lon"), F.col("lat"))
    places = source.select("row", "col", "lon", "lat", x.alias("px"), y.alias("py"))
    steps = coordinate_gradients(places, ["px", "py"])
    edges = knn_join(source, area_grid(source.sparkSession, target, xy=False), radius, 1)
    rows = gather(edges, steps, ["row", "col"], ["px", "py", "px_row", "px_col", "py_row", "py_col"])
    tx, ty = target.xy_of(F.col("t_col"), F.col("t_row"))
    dx, dy = tx - F.col("px"), ty - F.col("py")
    det = F.col("px_col") * F.col("py_row") - F.col("py_col") * F.col("px_row")
    dc = F.try_divide(dx * F.col("py_row") - dy * F.col("px_row"), det)
    dr = F.try_divide(dy * F.col("px_col") - dx * F.col("py_col"), det)
    close = (F.abs(dc) < 1) & (F.abs(dr) < 1)
    size = source.agg(F.max("col").alias("last_col"), F.max("row").alias("last_row"))
    out = rows.where(close).select(F.col("t_row").alias("row"), F.col("t_col").alias("col"), (F.col("s_col") + dc).alias("sx"), (F.col("s_row") + dr).alias("sy"))
    out = out.join(F.broadcast(size))  # one row
    return out.where("sx between 0 and last_col and sy between 0 and last_row").select("row", "col", "sx", "sy")


def coordinate_gradients(swath: DataFrame, columns: list[str]) -> DataFrame:
    """The swath with ``<c>_row`` and ``<c>_col``: central differences down and across, one-sided at the edges."""
    out = swath
    for axis, other in (("row", "col"), ("col", "row")):
        w = Window.partitionBy(other).orderBy(axis)
        for c in columns:
            before, after = F.lag(c).over(w), F.lead(c).over(w)
            out = out.withColumn(f"{c}_{axis}", F.when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before).otherwise((after - before) / 2))
    return out


def take_nearest(indices: DataFrame, data: DataFrame, values: list[str]) -> DataFrame:
    """Values at the rounded indices, halves to even."""
    at = indices.select("row", "col", F.rint("sy").cast("int").alias("s_row"), F.rint("sx").cast("int").alias("s_col"))
    side = data.select(F.col("row").alias("s_row"), F.col("col").alias("s_col"), *values)
    return at.join(side, ["s_row", "s_col"]).select("row", "col", *values)


def take_bilinear(indices: DataFrame, data: DataFrame, values: list[str]) -> DataFrame:
    """Values between the four pixels around the indices; missing where one of weight is missing or absent."""
    r0, c0 = F.floor("sy").cast("int"), F.floor("sx").cast("int")
    fr, fc = F.col("sy") - F.floor("sy"), F.col("sx") - F.floor("sx")
    parts = F.array(
        *[
            F.struct((r0 + i).alias("s_row"), (c0 + j).alias("s_col"), ((fr if i else 1 - fr) * (fc if j else 1 - fc)).alias("w"))
            for i in (0, 1)
            for j in (0, 1)
        ]
    )
    rows = indices.select("row", "col", F.explode(F.filter(parts, lambda p: p["w"] > 0)).alias("p")).select("row", "col", "p.*")
    side = data.select(F.col("row").alias("s_row"), F.col("col").alias("s_col"), *[F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")).alias(v) for v in values])
    joined = rows.join(side, ["s_row", "s_col"])
    aggs = [F.when(F.abs(F.sum(F.when(F.col(v).isNotNull(), F.col("w"))) - 1) < 1e-9, F.sum(F.col("w") * F.col(v))).alias(v) for v in values]
    return joined.groupBy("row", "col").agg(*aggs)


def resample_gradient(data: DataFrame, source, target: AreaSpec, values: list[str], method: str = "bilinear", radius: float | None = None) -> DataFrame:
    """``row, col`` and values of the target pixels that the source reaches.

    ``source`` is the area of ``data`` (row, col, values), or None where ``data``
    is a swath with lon and lat; a target that is no area needs a source area.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if source is not None:
        indices = area_indices(data.sparkSession, source, target)
    elif isinstance(target, AreaSpec):
        if radius is None:
            raise ValueError("a swath source needs a radius")
        indices = swath_indices(data, target, radius)
    else:
        raise NotImplementedError("swath to swath")
    out = take_bilinear(indices, data, values) if method == "bilinear" else take_nearest(indices, data, values)
    return out


def resample_cropped(data: DataFrame, source: AreaSpec, target: AreaSpec, values: list[str], method: str = "bilinear") -> DataFrame:
    """The same after cutting the source down to the target: only its pixels are read."""
    cropped, area = crop_to_area(data, source, target)
    return resample_gradient(cropped, area, target, values, method)
