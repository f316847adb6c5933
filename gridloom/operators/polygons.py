"""Polygon tables: set operations on pairs, and merging what overlaps.

A polygon is ``ARRAY<STRUCT<lon, lat>>`` in radians, clockwise. Boolean
operations walk outlines, control flow that columns cannot express; they run in
Arrow-batched functions, a pair a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.sphere import SphericalPolygon

POINTS = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))


def _polygon(points) -> SphericalPolygon | None:
    ring = np.array([(p["lon"], p["lat"]) for p in points]) if points is not None else np.empty((0, 2))
    return SphericalPolygon(ring) if len(ring) >= 3 else None


def _pairwise(a: pd.Series, b: pd.Series, what: str) -> list:
    out = []
    for x, y in zip(a, b):
        p, q = _polygon(x), _polygon(y)
        found = getattr(p, what)(q) if p is not None and q is not None else None
        out.append(None if found is None else [{"lon": float(u), "lat": float(v)} for u, v in found.vertices])
    return out


@F.pandas_udf(POINTS)
def polygon_union(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_pairwise(a, b, "union"))


@F.pandas_udf(POINTS)
def polygon_intersection(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_pairwise(a, b, "intersection"))


def overlapping_pairs(polygons: DataFrame, key: str = "id", points: str = "points", tile: float = 10.0) -> DataFrame:
    """``a, b`` (a < b) of polygons with a common part.

    Polygons meet in tiles of ``tile`` degrees that their boxes touch; only those
    that meet are intersected.
    """
    deg = lambda f, c: F.degrees(f(F.transform(points, lambda p: p[c])))
    boxes = polygons.select(key, points, *[deg(f, c).alias(f"{c}_{n}") for c in ("lon", "lat") for n, f in (("min", F.array_min), ("max", F.array_max))])
    # a box across the date line or around a pole spans all longitudes; edges bulge, so boxes are a tile wider
    wraps = F.col("lon_max") - F.col("lon_min") > 180
    west, east = F.when(wraps, F.lit(-180.0)).otherwise(F.col("lon_min")), F.when(wraps, F.lit(180.0)).otherwise(F.col("lon_max"))
    span = lambda lo, hi: F.sequence(F.floor(lo / tile).cast("int") - 1, F.floor(hi / tile).cast("int") + 1)
    tiles = boxes.select(key, points, F.explode(span(west, east)).alias("_i"), F.col("lat_min"), F.col("lat_max"))
    tiles = tiles.select(key, points, F.pmod("_i", F.lit(int(360 / tile))).alias("_i"), F.explode(span(F.col("lat_min"), F.col("lat_max"))).alias("_j")).dropDuplicates([key, "_i", "_j"])
    a, b = tiles.alias("a"), tiles.alias("b")
    met = a.join(b, (F.col("a._i") == F.col("b._i")) & (F.col("a._j") == F.col("b._j")) & (F.col(f"a.{key}") < F.col(f"b.{key}")))
    pairs = met.select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), F.col(f"a.{points}").alias("p"), F.col(f"b.{points}").alias("q")).dropDuplicates(["a", "b"])
    return pairs.where(polygon_intersection("p", "q").isNotNull()).select("a", "b")


def overlap_groups(polygons: DataFrame, key: str = "id", points: str = "points") -> DataFrame:
    """``key, group``: the least key of all polygons connected by overlaps.

    Labels spread along the pairs, and each round a label is replaced by its own
    label's, so a chain of any length takes a few rounds. A driver-side loop
    over label tables that ends when a round changes nothing; each round is
    checkpointed where the session has a checkpoint folder.
    """
    pairs = overlapping_pairs(polygons, key, points)
    both = _cut(pairs.union(pairs.select("b", "a")))
    labels = polygons.select(F.col(key).alias("n"), F.col(key).alias("group"))
    while True:
        near = both.join(labels, both.b == labels.n).groupBy("a").agg(F.min("group").alias("near"))
        after = labels.join(near, labels.n == near.a, "left").select("n", F.least("group", F.coalesce("near", "group")).alias("group"))
        own = after.select(F.col("n").alias("m"), F.col("group").alias("far"))
        after = _cut(after.join(own, after.group == own.m).select("n", F.least("group", "far").alias("group")))
        moved = after.join(labels.withColumnRenamed("group", "old"), "n").where("group <> old").limit(1).count()
        labels = after
        if not moved:
            break
    return labels.select(F.col("n").alias(key), "group")


def _cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist()


def merge_overlapping(polygons: dict) -> dict:
    """Driver-side merging of a few polygons: overlapping ones become one, under the tuple of their keys."""
    left = {k if isinstance(k, tuple) else (k,): p for k, p in polygons.items()}
    while True:
        keys = list(left)
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                joint = left[a].union(left[b])
                if joint is not None:
                    del left[a], left[b]
                    left[tuple(sorted((*a, *b)))] = joint
                    break
            else:
                continue
            break
        else:
            return {k[0] if len(k) == 1 else k: p for k, p in left.items()}
