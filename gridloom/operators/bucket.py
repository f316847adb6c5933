"""Bucket statistics: points summed up by the grid cell they fall into.

Everything is projection arithmetic in generated code and one hash aggregation
with partial sums before the shuffle; results are sparse, a row for each cell
that has a point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.plans.area import AreaSpec


def with_cells(points: DataFrame, area: AreaSpec, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``points`` with the ``row`` and ``col`` of their cell; points off the grid or without a place are left out."""
    x, y = area.crs.forward(F.col(lon), F.col(lat))
    llx, _, _, ury = area.extent
    placed = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull() & ~F.isnan(lon) & ~F.isnan(lat))
    placed = placed.withColumns({"_x": x, "_y": y}).where("not isnan(_x) and not isnan(_y) and _x is not null and _y is not null")
    col, row = F.floor((F.col("_x") - llx) / area.pixel_size_x), F.floor((F.lit(ury) - F.col("_y")) / area.pixel_size_y)
    placed = placed.withColumns({"col": col, "row": row}).drop("_x", "_y")
    inside = F.col("col").between(0, area.width - 1) & F.col("row").between(0, area.height - 1)
    return placed.where(inside).withColumns({"col": F.col("col").cast("int"), "row": F.col("row").cast("int")})


def clean(value: str, missing: float | None = None) -> Column:
    """``value`` with NaN and the ``missing`` sentinel as NULL."""
    out = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return out if missing is None else F.when(out != missing, out)


def count() -> Column:
    """Points of the cell, those without a value among them."""
    return F.count("*").alias("n")


def total(value: str, skipna: bool = True, fill: float | None = None, empty: float = 0.0, missing: float | None = None) -> Column:
    """Sum; a cell whose sum is zero gets ``empty``, one with a missing value gets ``fill`` unless ``skipna``."""
    v = clean(value, missing)
    out = F.sum(F.coalesce(v, F.lit(0.0)))
    out = F.when(out == 0, F.lit(float(empty))).otherwise(out)
    return out if skipna else F.when(F.count_if(v.isNull()) == 0, out).otherwise(F.lit(fill).cast("double"))


def minimum(value: str, missing: float | None = None) -> Column:
    """Least value; missing ones never count."""
    return F.min(clean(value, missing))


def maximum(value: str, nan_policy: str = "skip", missing: float | None = None) -> Column:
    """Largest value; with policy ``propagate`` a missing value makes the cell missing, with ``skip`` it does not count."""
    out = F.max(clean(value, missing))
    return out if nan_policy == "skip" else F.when(F.count_if(clean(value, missing).isNull()) == 0, out)


def absolute_maximum(value: str, missing: float | None = None) -> Column:
    """The value of largest magnitude, with its sign; of equal ones the positive."""
    low, high = F.min(clean(value, missing)), F.max(clean(value, missing))
    return F.when(-low > high, low).otherwise(high)


def average(value: str, skipna: bool = True, fill: float | None = None, missing: float | None = None) -> Column:
    """Mean of the values; cells without one, or with a missing one unless ``skipna``, get ``fill``."""
    v = clean(value, missing)
    out = F.avg(v)
    out = out if skipna else F.when(F.count_if(v.isNull()) == 0, out)
    return out if fill is None else F.coalesce(out, F.lit(float(fill)))


def bucket(points: DataFrame, area: AreaSpec, lon: str = "lon", lat: str = "lat", **stats: Column) -> DataFrame:
    """``row, col`` and the named statistics of every cell that has a point, in one pass."""
    return with_cells(points, area, lon, lat).groupBy("row", "col").agg(*[c.alias(n) for n, c in stats.items()])


def fractions(points: DataFrame, area: AreaSpec, category: str, categories: list | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """``row, col, category, fraction``: shares of the cell's points, zero shares left out.

    Without ``categories`` all that occur are counted; points of other or no
    category count in the denominator. Long format: the number of categories
    does not shape the plan.
    """
    cells = with_cells(points.withColumn("_category", F.col(category)), area, lon, lat)
    by = cells.groupBy("row", "col", F.col("_category").alias("category")).agg(F.count("*").alias("c"))
    all_ = by.groupBy("row", "col").agg(F.sum("c").alias("n"))
    kept = by.where("category is not null")
    if categories is not None:
        kept = kept.where(F.col("category").isin(list(categories)))
    return kept.join(all_, ["row", "col"]).select("row", "col", "category", (F.col("c") / F.col("n")).alias("fraction"))
