"""Bounded-radius nearest neighbours as an equi-join on cells of space.

Source and target become points on a sphere; space is cut into cubes whose edge
is the radius, so all neighbours of a target are in its own cube or one of the
26 around it. The smaller side lists the cubes around its points and meets the
other by cube number - a hash join that Spark can shuffle, broadcast or, at
dense cubes, split - and the exact distance decides. Where such cubes hold many
sources, each target looks only as far as its nearest ones may be, in smaller
cubes. The result is a table of edges that any number of data sets can be
gathered through.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.mathx import EARTH_RADIUS, geocentric_xyz
from gridloom.operators.filters import legal, reduce_to_area
from gridloom.plans.area import AreaSpec
from gridloom.sources.scans import area_grid


#: Source points that a cube may hold, as its points see it, before smaller cubes are used; and ``k`` times as many on top.
CROWD, CROWD_K = 16, 4
#: Cubes of this edge at least keep their three numbers within 21 bits each.
LEAST_EDGE = 6.2


def _points(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    x, y, z = geocentric_xyz(F.col("lon"), F.col("lat"))
    return legal(df).select(*[F.col(k).alias(f"{prefix}{k}") for k in keys], x.alias(f"{prefix}x"), y.alias(f"{prefix}y"), z.alias(f"{prefix}z"))


def _at(prefix: str, axis: str, edge: float, level: Column | int) -> Column:
    """A coordinate in edges of the cubes of a level; each level halves the edge."""
    scale = F.lit(float(1 << level)) if isinstance(level, int) else F.expr(f"shiftleft(1L, {prefix}level)").cast("double")
    return F.col(f"{prefix}{axis}") * scale / edge


def _number(prefix: str, edge: float, level: Column | int) -> Column:
    """The number of a point's cube: neighbours along an axis are a constant apart."""
    x, y, z = (F.floor(_at(prefix, c, edge, level)).cast("long") + (1 << 20) for c in "xyz")
    return (x * (1 << 21) + y) * (1 << 21) + z


def _steps() -> list[tuple[int, int, int, int]]:
    return [(((a << 21) + b << 21) + c, a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]


def _dist2() -> Column:
    out = F.lit(0.0)
    for c in "xyz":
        out = out + (F.col(f"s_{c}") - F.col(f"t_{c}")) * (F.col(f"s_{c}") - F.col(f"t_{c}"))
    return out


def _crowds(points: DataFrame, edge: float, level: int, k: int) -> float:
    """How many times too many points meet in the cubes of a level; 1 or less if they are few."""
    n = F.col("n").cast("double")
    found = points.groupBy(_number("s_", edge, level).alias("cube")).agg(F.count("*").alias("n")).agg(F.sum(n), F.sum(n * n), F.max(n)).first()
    return max(found[1] / found[0], found[2] / 32) / (CROWD + CROWD_K * k) if found[0] else 0.0


def _depth(places: DataFrame, edge: float, k: int) -> int:
    """The level whose cubes hold few places each, or the last there is."""
    level, last = 0, max(0, math.floor(math.log2(edge / LEAST_EDGE)))
    while level < last:
        over = _crowds(places, edge, level, k)
        if over <= 1:
            break
        # on a surface the cubes of the next level hold a quarter
        level = min(last, level + max(1, int(math.log(over, 4))))
    return level


def _nearest(pairs: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def _crowded_join(s: DataFrame, t: DataFrame, radius: float, edge: float, k: int, s_keys: list[str], t_keys: list[str]) -> DataFrame:
    """The edges of ``knn_join`` where the cubes as wide as the radius hold many sources.

    Of sources at one place only the ``k`` least keys can be among the nearest,
    and targets at one place have the same neighbours. Each place takes the
    smallest cube around it that holds ``k`` sources: the ``k``-th distance in
    there is how far it has to look. Then it meets the cubes that this ball
    touches, of the smallest level whose edge is no less. So a target meets some
    multiple of ``k`` sources however many lie within the radius.
    """
    at = ["t_x", "t_y", "t_z"]
    s = _nearest(s, ["s_x", "s_y", "s_z"], s_keys, k).drop("rank")
    depth = _depth(s.select("s_x", "s_y", "s_z").distinct(), edge, k)
    levels = lambda prefix: F.explode(F.array(*[F.struct(F.lit(j).alias("level"), _number(prefix, edge, j).alias("cube")) for j in range(depth + 1)])).alias("_c")
    listed = s.select("*", levels("s_")).select(*s_keys, "s_x", "s_y", "s_z", F.col("_c.level").alias("level"), F.col("_c.cube").alias("cube"))
    enough = listed.groupBy("level", "cube").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("level", "cube", F.lit(True).alias("enough"))
    own = t.select(*at).distinct().select("*", levels("t_")).select(*at, F.col("_c.level").alias("level"), F.col("_c.cube").alias("cube"))
    own = own.join(enough, ["level", "cube"], "left")
    own = own.groupBy(*at).agg(F.max(F.when(F.col("enough"), F.struct("level", "cube"))).alias("_c")).select(*at, "_c.level", "_c.cube")
    # all of such a cube's sources, or one row without any
    inside = own.join(listed.select("level", "cube", "s_x", "s_y", "s_z"), ["level", "cube"], "left").select(*at, F.sqrt(_dist2()).alias("dist"))
    if k == 1:
        reach = inside.groupBy(*at).agg(F.min("dist").alias("reach"))
    else:
        reach = _nearest(inside, at, ["dist"], k).where((F.col("rank") == k) | F.col("dist").isNull()).select(*at, F.col("dist").alias("reach"))
    reach = reach.select(*at, F.least(F.coalesce("reach", F.lit(float(radius))), F.lit(float(radius))).alias("reach"))
    level = F.lit(0)
    for j in range(1, depth + 1):
        level = level + (F.col("reach") * (1 + 1e-6) <= edge / (1 << j)).cast("int")
    ball = reach.withColumn("t_level", level)
    ball = ball.select("*", _number("t_", edge, F.col("t_level")).alias("cube"), *[(_at("t_", c, edge, F.col("t_level")) - F.floor(_at("t_", c, edge, F.col("t_level")))).alias(f"in_{c}") for c in "xyz"], (F.col("reach") * F.expr("shiftleft(1L, t_level)").cast("double") / edge * (1 + 1e-9) + 1e-9).alias("r"))
    gap = lambda c, d: F.lit(0.0) if d == 0 else F.pow(F.col(f"in_{c}") if d < 0 else 1 - F.col(f"in_{c}"), F.lit(2.0))
    touched = [F.when(gap("x", a) + gap("y", b) + gap("z", c) <= F.col("r") * F.col("r"), F.col("cube") + F.lit(step).cast("long")) for step, a, b, c in _steps()]
    ball = ball.select(*at, "reach", F.col("t_level").alias("level"), F.explode(F.array_compact(F.array(*touched))).alias("cube"))
    pairs = ball.join(listed, ["level", "cube"]).select("*", _dist2().alias("dist2")).where(F.col("dist2") < float(radius) ** 2)
    pairs = pairs.select(*at, "reach", *s_keys, F.sqrt("dist2").alias("dist")).where(F.col("dist") <= F.col("reach")).drop("reach")
    if k == 1:
        best = pairs.groupBy(*at).agg(F.min(F.struct("dist", *s_keys)).alias("b")).select(*at, F.lit(1).alias("rank"), *[F.col(f"b.{c}").alias(c) for c in s_keys], F.col("b.dist").alias("dist"))
    else:
        best = _nearest(pairs, at, ["dist", *s_keys], k)
    return t.join(best, at).select(*t_keys, "rank", *s_keys, "dist")


def knn_join(source: DataFrame, target: DataFrame, radius: float, k: int = 1, source_keys: list[str] | None = None, target_keys: list[str] | None = None, around: str = "target") -> DataFrame:
    """Edges ``(t_<key>..., rank, s_<key>..., dist)`` of each target's ``k`` nearest sources within ``radius`` metres.

    ``around`` names the side whose points list the cubes around them: the
    smaller one. Distances are chords on the sphere; ties go by the source keys.
    Targets without a neighbour have no edge. Locations off the earth or missing
    take no part. The sources are counted by cube first: where many share one,
    smaller cubes are used (see ``_crowded_join``), with the same edges.
    """
    if radius <= 0 or k < 1:
        raise ValueError("radius and k must be positive")
    source_keys, target_keys = source_keys or ["row", "col"], target_keys or ["row", "col"]
    edge = max(float(radius), 100.0) * (1 + 1e-6)
    s, t = _points(source, source_keys, "s_"), _points(target, target_keys, "t_")
    t_keys, s_keys = [f"t_{c}" for c in target_keys], [f"s_{c}" for c in source_keys]
    if _crowds(s, edge, 0, k) > 1:
        return _crowded_join(s, t, radius, edge, k, s_keys, t_keys)
    s, t = s.withColumn("cube", _number("s_", edge, 0)), t.withColumn("cube", _number("t_", edge, 0))
    near = F.explode(F.array(*[F.col("cube") + F.lit(step).cast("long") for step, *_ in _steps()]))
    s, t = (s.withColumn("cube", near), t) if around == "source" else (s, t.withColumn("cube", near))
    pairs = t.join(s, "cube").withColumn("dist2", _dist2()).where(F.col("dist2") < float(radius) ** 2)
    pairs = pairs.select(*t_keys, *s_keys, F.sqrt("dist2").alias("dist"))
    if k == 1:
        best = pairs.groupBy(*t_keys).agg(F.min(F.struct("dist", *s_keys)).alias("b"))
        return best.select(*t_keys, F.lit(1).alias("rank"), *[F.col(f"b.{c}").alias(c) for c in s_keys], F.col("b.dist").alias("dist"))
    return _nearest(pairs, t_keys, ["dist", *s_keys], k).select(*t_keys, "rank", *s_keys, "dist")


def smaller_side(source: DataFrame, target: AreaSpec) -> str:
    """Which of a source table and an area's pixels are fewer; counts no more rows than the area has pixels."""
    return "source" if source.select(F.lit(1)).limit(target.size + 1).count() <= target.size else "target"


def neighbours(source: DataFrame, target: AreaSpec, radius: float, k: int = 1, source_keys: list[str] | None = None, reduce_data: bool = True) -> DataFrame:
    """The edges from the pixels of an area; sources far from it are filtered at the scan."""
    if reduce_data:
        source = reduce_to_area(source, target, radius)
    around = smaller_side(source, target)
    return knn_join(source, area_grid(source.sparkSession, target, xy=False), radius, k, source_keys, around=around)


def gather(edges: DataFrame, data: DataFrame, source_keys: list[str], values: list[str]) -> DataFrame:
    """The edges with ``data``'s values: one equi-join, whatever made the edges."""
    side = data.select(*[F.col(c).alias(f"s_{c}") for c in source_keys], *values)
    return edges.join(side, [f"s_{c}" for c in source_keys])


def nearest(source: DataFrame, target: DataFrame | AreaSpec, radius: float, values: list[str], source_keys: list[str] | None = None, target_keys: list[str] | None = None, around: str = "target", keep_all: bool = False) -> DataFrame:
    """Each target's values at its nearest source within ``radius``; types are kept.

    ``keep_all`` adds the targets without one, their values missing. A source
    whose value is missing is a neighbour like any other.
    """
    source_keys, target_keys = source_keys or ["row", "col"], target_keys or ["row", "col"]
    if isinstance(target, AreaSpec):
        area, target = target, area_grid(source.sparkSession, target, xy=False)
        source = reduce_to_area(source, area, radius)
        around = smaller_side(source, area)
    edges = knn_join(source, target, radius, 1, source_keys, target_keys, around)
    found = gather(edges, source, source_keys, values)
    out = found.select(*[F.col(f"t_{c}").alias(c) for c in target_keys], *values)
    return target.select(*target_keys).join(out, target_keys, "left") if keep_all else out


def weighted(edges: DataFrame, data: DataFrame, weight: Callable[[Column], Column], values: list[str], source_keys: list[str] | None = None, target_keys: list[str] | None = None, uncertainty: bool = False) -> DataFrame:
    """Weighted means over the edges: ``weight`` maps the distance column to a weight column.

    Missing values and their weights do not count. With ``uncertainty``, also
    ``<value>_stddev`` (weighted, of more than one neighbour) and ``<value>_n``.
    All sums are taken in one aggregation.
    """
    source_keys, target_keys = source_keys or ["row", "col"], target_keys or ["row", "col"]
    rows = gather(edges, data, source_keys, values).withColumn("w", weight(F.col("dist")))
    aggs, out = [], [F.col(f"t_{c}").alias(c) for c in target_keys]
    for v in values:
        w = F.when(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")), F.col("w"))
        x = F.coalesce(F.nanvl(F.col(v).cast("double"), F.lit(0.0)), F.lit(0.0))
        aggs += [F.sum(w).alias(f"{v}_1"), F.sum(w * x).alias(f"{v}_x"), F.sum(w * x * x).alias(f"{v}_xx"), F.sum(w * w).alias(f"{v}_2"), F.count(w).alias(f"{v}_n")]
        mean = F.try_divide(F.col(f"{v}_x"), F.col(f"{v}_1"))
        out.append(mean.alias(v))
        if uncertainty:
            v1, v2 = F.col(f"{v}_1"), F.col(f"{v}_2")
            spread = F.greatest(F.col(f"{v}_xx") - F.col(f"{v}_x") * mean, F.lit(0.0))
            out += [F.when(F.col(f"{v}_n") > 1, F.sqrt(F.try_divide(v1, v1 * v1 - v2) * spread)).alias(f"{v}_stddev"), F.col(f"{v}_n").alias(f"{v}_n")]
    return rows.groupBy(*[f"t_{c}" for c in target_keys]).agg(*aggs).select(*out)


def gauss(sigma: float) -> Callable[[Column], Column]:
    """The weight exp(-d^2 / sigma^2)."""
    return lambda d: F.exp(-(d * d) / float(sigma) ** 2)


def resample_gauss(source: DataFrame, target: DataFrame | AreaSpec, radius: float, sigma: float, values: list[str], k: int = 8, uncertainty: bool = False, **keys) -> DataFrame:
    return resample_custom(source, target, radius, gauss(sigma), values, k, uncertainty, **keys)


def resample_custom(source: DataFrame, target: DataFrame | AreaSpec, radius: float, weight: Callable[[Column], Column], values: list[str], k: int = 8, uncertainty: bool = False, source_keys: list[str] | None = None, target_keys: list[str] | None = None) -> DataFrame:
    """Weighted means of the ``k`` nearest sources within ``radius``; ``weight`` is a function of the distance column."""
    if not callable(weight):
        raise TypeError("weight must be a function of the distance")
    if isinstance(target, AreaSpec):
        edges = neighbours(source, target, radius, k, source_keys)
    else:
        edges = knn_join(source, target, radius, k, source_keys, target_keys)
    return weighted(edges, source, weight, values, source_keys, target_keys, uncertainty)


def save_edges(edges: DataFrame, path: str) -> None:
    """Keeps a neighbour table for other data on the same geometries."""
    edges.write.mode("overwrite").parquet(path)


def load_edges(spark, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except Exception as error:
        raise OSError(f"no neighbour table at {path}") from error


def default_radius(*resolutions: float) -> float:
    """The larger geocentric resolution, or 10 km if none is known."""
    known = [r for r in resolutions if r is not None and math.isfinite(r) and r > 0]
    return max(known) if known else 10_000.0
