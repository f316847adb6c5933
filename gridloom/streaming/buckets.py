"""Bucket statistics of an unbounded stream of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.bucket import with_cells
from gridloom.plans.area import AreaSpec


def windowed_buckets(points: DataFrame, area: AreaSpec, window: str, late: str, ts: str = "ts", **stats: Column) -> DataFrame:
    """Statistics by time window and cell; state older than the watermark ``late`` is dropped.

    Works on batch and streaming tables with ``lon``, ``lat`` and ``ts``.
    """
    cells = with_cells(points.withWatermark(ts, late), area)
    found = cells.groupBy(F.window(ts, window), "row", "col").agg(*[c.alias(n) for n, c in stats.items()])
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "row", "col", *stats)


def gather_stream(pixels: DataFrame, edges: DataFrame, values: list[str]) -> DataFrame:
    """Micro-batches of pixels through a persisted neighbour table: a stream-static equi-join."""
    side = pixels.select(F.col("row").alias("s_row"), F.col("col").alias("s_col"), *[c for c in pixels.columns if c not in ("row", "col")])
    return side.join(edges, ["s_row", "s_col"]).select(F.col("t_row").alias("row"), F.col("t_col").alias("col"), *values)
