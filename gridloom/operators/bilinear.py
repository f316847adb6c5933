"""Bilinear interpolation from irregular sources: the nearest source in each quadrant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.knn import gather, knn_join
from gridloom.operators.filters import reduce_to_area
from gridloom.plans.area import AreaSpec
from gridloom.sources.scans import area_grid

CORNERS = ("ul", "ur", "ll", "lr")


def corners(source: DataFrame, target: AreaSpec, radius: float, k: int = 32, source_keys: list[str] | None = None) -> DataFrame:
    """Per target pixel its place ``x, y`` and, for each quadrant around it, the nearest of the ``k`` nearest sources: ``<corner>`` struct (keys, x, y)."""
    keys = source_keys or ["row", "col"]
    grid = area_grid(source.sparkSession, target)
    near = reduce_to_area(source, target, radius)
    edges = knn_join(near, grid, radius, k, keys)
    x, y = target.crs.forward(F.col("lon"), F.col("lat"))
    places = near.select(*keys, x.alias("sx"), y.alias("sy"))
    rows = gather(edges, places, keys, ["sx", "sy"])
    tx, ty = target.xy_of(F.col("t_col"), F.col("t_row"))
    dx, dy = F.col("sx") - tx, F.col("sy") - ty
    what = F.struct(*[F.col(f"s_{c}").alias(c) for c in keys], F.col("sx").alias("x"), F.col("sy").alias("y"))
    quadrant = {"ul": (dx < 0) & (dy > 0), "ur": (dx > 0) & (dy > 0), "ll": (dx < 0) & (dy < 0), "lr": (dx > 0) & (dy < 0)}
    best = rows.groupBy("t_row", "t_col").agg(*[F.min_by(F.when(q, what), F.when(q, F.col("rank"))).alias(n) for n, q in quadrant.items()])
    tx, ty = target.xy_of(F.col("t_col"), F.col("t_row"))
    return best.select(F.col("t_row").alias("row"), F.col("t_col").alias("col"), tx.alias("x"), ty.alias("y"), *CORNERS)


def _within(v: Column) -> Column:
    return F.when((v >= 0) & (v <= 1), v)


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """A projection of its own, so that what follows refers to columns and not to their formulas."""
    return df.withColumns(columns)


def _quadratic(df: DataFrame, name: str, a: Column, b: Column, c: Column) -> DataFrame:
    """``name``: the root between 0 and 1 of a quadratic; of two, the one of the positive square root."""
    df = _step(df, _a=a, _b=b, _c=c)
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    df = _step(df, _r=F.sqrt(F.greatest(b * b - a * c * 4, F.lit(0.0))), _real=b * b - a * c * 4 >= 0)
    curved = F.abs(a) >= 1e-30
    df = _step(
        df,
        _x=F.when(~curved, F.try_divide(-c, b)).when(F.col("_real"), F.try_divide(-b + F.col("_r"), a * 2)),
        _y=F.when(curved & F.col("_real"), F.try_divide(-b - F.col("_r"), a * 2)),
    )
    return _step(df, **{name: F.coalesce(_within(F.col("_x")), _within(F.col("_y")))})


def _other(df: DataFrame, name: str, f: Column, one: tuple, two: tuple) -> DataFrame:
    """``name``: the second share, given the first along two edges; by one coordinate, else by the other."""
    for k, (v1, v2, v3, v4, at) in enumerate((one, two)):
        df = _step(df, **{f"_l{k}": v1 + (v3 - v1) * f, f"_h{k}": v2 + (v4 - v2) * f})
        df = _step(df, **{f"_q{k}": F.try_divide(at - F.col(f"_l{k}"), F.col(f"_h{k}") - F.col(f"_l{k}"))})
    return _step(df, **{name: F.coalesce(_within(F.col("_q0")), _within(F.col("_q1")))})


def with_shares(df: DataFrame) -> DataFrame:
    """Adds ``t`` down and ``s`` across (0 to 1) of a place ``x, y`` within the four corners.

    Tried in order: the irregular quadrangle (a quadratic in ``t``), one with
    parallel uprights (a quadratic in ``s``), the parallelogram; missing if none
    gives shares.
    """
    columns = df.columns
    df = df.select("*", *[F.col(f"{n}.{c}").alias(f"{c}{i}") for i, n in enumerate(CORNERS, 1) for c in "xy"])
    x, y = F.col("x"), F.col("y")
    (x1, y1), (x2, y2), (x3, y3), (x4, y4) = ((F.col(f"x{i}"), F.col(f"y{i}")) for i in (1, 2, 3, 4))
    a = (x3 - x1) * (y4 - y2) - (y3 - y1) * (x4 - x2)
    b = y * (x4 - x2 - x3 + x1) - x * (y4 - y2 - y3 + y1) + x3 * y2 - y3 * x2 + x1 * y4 - y1 * x4 + (y1 * x2 - x1 * y2) * 2
    c = y * (x2 - x1) - x * (y2 - y1) + x1 * y2 - y1 * x2
    df = _other(_quadratic(df, "t1", a, b, c), "s1", F.col("t1"), (y1, y2, y3, y4, y), (x1, x2, x3, x4, x))
    a = (x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3)
    b = y * (x4 - x3 - x2 + x1) - x * (y4 - y3 - y2 + y1) + x2 * y3 - y2 * x3 + x1 * y4 - y1 * x4 + (y1 * x3 - x1 * y3) * 2
    c = y * (x3 - x1) - x * (y3 - y1) + x1 * y3 - y1 * x3
    df = _other(_quadratic(df, "s2", a, b, c), "t2", F.col("s2"), (y1, y3, y2, y4, y), (x1, x3, x2, x4, x))
    df = _step(df, _d=(x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1))
    df = _step(df, s3=F.try_divide((x - x1) * (y3 - y1) - (y - y1) * (x3 - x1), F.col("_d")), t3=F.try_divide((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1), F.col("_d")))
    df = _step(df, s3=_within(F.col("s3")), t3=_within(F.col("t3")))
    both = [F.col(f"t{i}").isNotNull() & F.col(f"s{i}").isNotNull() for i in (1, 2, 3)]
    pick = lambda n: F.when(both[0], F.col(f"{n}1")).when(both[1], F.col(f"{n}2")).when(both[2], F.col(f"{n}3"))
    return _step(df, t=pick("t"), s=pick("s")).select(*columns, "t", "s")


def weights(source: DataFrame, target: AreaSpec, radius: float, k: int = 32, source_keys: list[str] | None = None) -> DataFrame:
    """The reusable table ``row, col, t, s, ul, ur, ll, lr`` of pixels that have shares; a sink and source like any other."""
    found = corners(source, target, radius, k, source_keys).dropna(subset=list(CORNERS))
    solved = with_shares(found)
    # a filter on t or s would be pushed down step by step, and the formulas with it; what explode() makes stays above
    kept = F.when(F.col("t").isNotNull() & F.col("s").isNotNull(), F.struct("row", "col", "t", "s", *CORNERS))
    return solved.select(F.explode(F.array(kept)).alias("w")).where("w is not null").select("w.*")


def blend(table: DataFrame, data: DataFrame, values: list[str], source_keys: list[str] | None = None, limit: bool = False) -> DataFrame:
    """Values of the target pixels; missing where a corner's value is missing.

    The four corners become rows, meet the data in one equi-join and are summed
    up again. With ``limit``, results outside the data's range (by more than
    1e-6) are missing.
    """
    keys = source_keys or ["row", "col"]
    t, s = F.col("t"), F.col("s")
    share = {"ul": (1 - s) * (1 - t), "ur": s * (1 - t), "ll": (1 - s) * t, "lr": s * t}
    parts = F.array(*[F.struct(*[F.col(f"{n}.{c}").alias(f"s_{c}") for c in keys], w.alias("w")) for n, w in share.items()])
    rows = table.select(F.col("row").alias("t_row"), F.col("col").alias("t_col"), F.explode(parts).alias("p")).select("t_row", "t_col", "p.*")
    side = data.select(*[F.col(c).alias(f"s_{c}") for c in keys], *[F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")).alias(v) for v in values])
    joined = rows.join(side, [f"s_{c}" for c in keys])
    out = joined.groupBy("t_row", "t_col").agg(*[F.when(F.count(v) == 4, F.sum(F.col("w") * F.col(v))).alias(v) for v in values])
    out = out.select(F.col("t_row").alias("row"), F.col("t_col").alias("col"), *values)
    if limit:
        bounds = side.agg(*[f(v).alias(f"{n}_{v}") for v in values for n, f in (("lo", F.min), ("hi", F.max))])
        out = out.join(F.broadcast(bounds))  # one row
        out = out.select("row", "col", *[F.when(F.col(v).between(F.col(f"lo_{v}") - 1e-6, F.col(f"hi_{v}") + 1e-6), F.col(v)).alias(v) for v in values])
    return out


def resample_bilinear(source: DataFrame, target: AreaSpec, radius: float, values: list[str], k: int = 32, source_keys: list[str] | None = None, limit: bool = False) -> DataFrame:
    """``row, col`` and interpolated values of the pixels with a source in every quadrant."""
    return blend(weights(source, target, radius, k, source_keys), source, values, source_keys, limit)
