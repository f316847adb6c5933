"""Generated scans: coordinate tables of areas, and geolocated views of plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.area import AreaSpec, StackedArea


def area_grid(spark: SparkSession, area: AreaSpec | StackedArea, lonlat: bool = True, xy: bool = True) -> DataFrame:
    """``row, col`` and, as asked, ``x, y`` and ``lon, lat`` of every pixel centre.

    Made from a range, so it splits into any number of tasks and no coordinate
    is stored; pixels without a place on earth have missing degrees.
    """
    if isinstance(area, StackedArea):
        parts, base = [], 0
        for one in area.areas:
            parts.append(area_grid(spark, one, lonlat, xy).withColumn("row", (F.col("row") + base).cast("int")))
            base += one.height
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    cells = spark.range(area.size).select(F.expr(f"cast(id div {area.width} as int)").alias("row"), F.expr(f"cast(id % {area.width} as int)").alias("col"))
    x, y = area.xy_of(F.col("col"), F.col("row"))
    lon, lat = area.crs.inverse(x, y)
    columns = [F.col("row"), F.col("col")]
    if xy:
        columns += [x.alias("x"), y.alias("y")]
    if not lonlat:
        return cells.select(*columns)
    lon, lat = _missing(lon).alias("lon"), _missing(lat).alias("lat")
    if area.crs.geographic:
        return cells.select(*columns, lon, lat)
    # filters on degrees would be pushed below the formulas, and the formulas with them, once a mention; explode() keeps them above
    return cells.select(*columns, F.explode(F.array(F.struct(lon, lat))).alias("_p")).select("row", "col", *(["x", "y"] if xy else []), "_p.lon", "_p.lat")


def _missing(value: Column) -> Column:
    """Null for NaN."""
    return F.nanvl(value, F.lit(None).cast("double"))


def densify(cells: DataFrame, area: AreaSpec, fill: dict[str, float] | float | None = None) -> DataFrame:
    """A row for every pixel: sparse ``cells`` (row, col, values) with gaps missing or filled."""
    out = area_grid(cells.sparkSession, area, lonlat=False, xy=False).join(cells, ["row", "col"], "left")
    return out if fill is None else out.fillna(fill)


def events_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points: ``pt_id, lon, lat, value, category, ts``; every seventh value is missing."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("pt_id"),
        (((F.col("event_id") * 7919) % 36000).cast("double") / 100.0 - 180.0).alias("lon"),
        (((F.col("event_id") * 104729) % 17000).cast("double") / 100.0 - 85.0).alias("lat"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
        F.col("event_type").alias("category"),
        "ts",
    )


POINTS_SQL = """select event_id as pt_id,
  cast((event_id * 7919) % 36000 as double) / 100.0e0 - 180.0e0 as lon,
  cast((event_id * 104729) % 17000 as double) / 100.0e0 - 85.0e0 as lat,
  case when event_id % 7 <> 0 then value end as value, event_type as category, ts from events"""


def events_swath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a smooth swath 50 wide: ``row, col, lon, lat, value``."""
    row, col = F.expr("cast(event_id div 50 as int)"), F.expr("cast(event_id % 50 as int)")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        row.alias("row"),
        col.alias("col"),
        (F.lit(-95.0) + col * 0.4 + (row % 1000) * 0.01).alias("lon"),
        (F.lit(15.0) + (row % 1000) * 0.05 - col * 0.02).alias("lat"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
    )


SWATH_SQL = """select cast(event_id // 50 as int) as row, cast(event_id % 50 as int) as col,
  -95.0e0 + (event_id % 50) * 0.4e0 + ((event_id // 50) % 1000) * 0.01e0 as lon,
  15.0e0 + ((event_id // 50) % 1000) * 0.05e0 - (event_id % 50) * 0.02e0 as lat,
  case when event_id % 7 <> 0 then value end as value from events"""
