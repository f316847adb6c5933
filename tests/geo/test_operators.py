import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.errors import DimensionError
from gridloom.functions.mathx import EARTH_RADIUS, geocentric_xyz
from gridloom.functions.sphere import Arc, SphericalPolygon, convex_area, polygon_area_column, signed_angle, unit, vincenty
from gridloom.operators import bilinear, blocks, bucket, ewa, filters, gradient, grid, knn, polygons, swath
from gridloom.plans import registry
from gridloom.plans.area import AreaSpec
from gridloom.sources.scans import area_grid, densify
from gridloom.streaming.buckets import gather_stream, windowed_buckets

STERE = "+proj=stere +a=6378144 +b=6356759 +lat_0=50 +lat_ts=50 +lon_0=8"
AREA_D = AreaSpec.make(STERE, 800, 800, (-1370912.72, -909968.64, 1029087.28, 1490031.36))
EUROL = AreaSpec.make("+proj=stere +ellps=WGS84 +lat_0=90 +lat_ts=60 +lon_0=0", 2560, 2048, (-3780000, -7644000, 3900000, -1500000))
LL = "+proj=longlat +datum=WGS84"


@pytest.fixture(scope="module")
def sw(spark):
    return spark.range(500).selectExpr("cast(id div 10 as int) as row", "cast(id % 10 as int) as col", "3.0D + id % 10 as lon", "75.0D - id div 10 as lat", "cast((id div 10) * (id % 10) as double) as value").cache()


@pytest.fixture(scope="module")
def three(spark):
    source = spark.createDataFrame([(1, 11.280789, 56.011037, 1.0), (2, 12.649354, 55.629675, 2.0), (3, 12.080402, 55.641535, 3.0)], "i int, lon double, lat double, value double")
    return source, spark.createDataFrame([(0, 12.562036, 55.715613)], "t int, lon double, lat double")


# buckets


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame([(25.0, 60.0, 2.0, 2), (25.0, 60.00001, 11.0, 4), (25.0, 60.2, 5.0, 2), (25.0, 60.3, None, 2)], "lon double, lat double, value double, kind int")


def test_bucket_indices(four):
    found = {(r.col, r.row): r.n for r in bucket.bucket(four, EUROL, n=bucket.count()).collect()}
    assert found == {(1710, 465): 2, (1707, 459): 1, (1705, 455): 1}


def test_bucket_statistics(spark, four):
    r = {(x.col, x.row): x for x in bucket.bucket(four, EUROL, total=bucket.total("value"), strict=bucket.total("value", False, -1.0), low=bucket.minimum("value"), high=bucket.maximum("value"), mean=bucket.average("value"), filled=bucket.average("value", fill=-1)).collect()}
    a, b, c = r[1710, 465], r[1707, 459], r[1705, 455]
    assert (a.total, a.low, a.high, a.mean) == (13, 2, 11, 6.5) and (b.low, b.high, b.mean) == (5, 5, 5)
    assert (c.total, c.strict, c.low, c.high, c.mean, c.filled) == (0, -1, None, None, None, -1)
    signed = four.withColumn("value", F.when(F.col("value") == 11, -11.0).otherwise(F.col("value")))
    assert sorted(x.m for x in bucket.bucket(signed, EUROL, m=bucket.absolute_maximum("value")).collect() if x.m is not None) == [-11, 5]
    nan = four.withColumn("value", F.when(F.col("value") == 11, float("nan")).otherwise(F.col("value")))
    r = {(x.col, x.row): x for x in bucket.bucket(nan, EUROL, skip=bucket.maximum("value"), strict=bucket.maximum("value", "propagate"), mean=bucket.average("value", skipna=False)).collect()}
    assert (r[1710, 465].skip, r[1710, 465].strict, r[1710, 465].mean) == (2, None, None)


def test_fractions(four):
    found = {(r.col, r.category): r.fraction for r in bucket.fractions(four, EUROL, "kind").collect()}
    assert found == {(1710, 2): 0.5, (1710, 4): 0.5, (1707, 2): 1.0, (1705, 2): 1.0}
    assert {r.category for r in bucket.fractions(four, EUROL, "kind", [4, 9]).collect()} == {4}


def test_sums_are_kept(spark):
    points = spark.range(5000).selectExpr("(id * 37 % 3600) / 10D - 180 as lon", "(id * 91 % 1700) / 10D - 85 as lat", "cast(id as double) as value")
    area = AreaSpec.make(LL, 36, 17, (-180, -85, 180, 85))
    inside = points.where("lat > -85").agg(F.sum("value")).first()[0]
    cells = bucket.bucket(points, area, total=bucket.total("value"))
    assert cells.agg(F.sum("total")).first()[0] == inside and densify(cells, area, 0.0).count() == area.size


# neighbours


def test_nearest_golden(sw):
    found = knn.nearest(sw, AREA_D, 50_000, ["value"])
    assert found.agg(F.sum("value")).first()[0] == 15874591.0


def test_three_points(three):
    source, target = three
    keys = dict(source_keys=["i"], target_keys=["t"])
    assert knn.nearest(source, target, 100_000, ["value"], ["i"], ["t"]).first().value == 2
    assert np.isclose(knn.resample_gauss(source, target, 50_000, 25_000, ["value"], **keys).first().value, 2.2020729, atol=1e-5)
    r = knn.resample_gauss(source, target, 100_000, 25_000, ["value"], uncertainty=True, **keys).first()
    assert np.allclose((r.value, r.value_stddev, r.value_n), (2.20206560694, 0.707115076173, 3), atol=1e-5)
    assert np.isclose(knn.resample_custom(source, target, 50_000, lambda d: 1 - d / 100_000.0, ["value"], **keys).first().value, 2.4356757, atol=1e-5)
    r = knn.resample_custom(source, target, 100_000, lambda d: 1 - d / 100_000.0, ["value"], uncertainty=True, **keys).first()
    assert np.allclose((r.value, r.value_stddev, r.value_n), (2.32193149, 0.81817972, 3), atol=1e-5)
    with pytest.raises(TypeError):
        knn.resample_custom(source, target, 1e5, 3, ["value"], **keys)


def test_far_source_gives_nothing(spark, sw):
    assert knn.nearest(sw.withColumn("lon", F.col("lon") + 162), AREA_D, 50_000, ["value"]).count() == 0


@pytest.mark.parametrize("k,radius,around", [(1, 300_000, "target"), (5, 300_000, "source"), (3, 2_000_000, "target")])
def test_join_against_brute_force(spark, k, radius, around):
    rng = np.random.default_rng(k)
    s, t = (np.stack([rng.uniform(-180, 180, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))], 1) for n in (1500, 200))
    s[:3], t[:3] = [[179.9, 10], [0, 90], [5, 5]], [[-179.9, 10], [90, 89.9], [5, 5]]
    frames = [spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)] + [(9999, None, 1.0), (9998, 400.0, 1.0)], "i int, lon double, lat double") for x in (s, t)]
    got = {(r.t_i, r["rank"]): r.s_i for r in knn.knn_join(*frames, radius, k, ["i"], ["i"], around).collect()}
    a, b = (np.stack(geocentric_xyz(x[:, 0], x[:, 1]), 1) for x in (s, t))
    want = {}
    for j, p in enumerate(b):
        d = np.linalg.norm(a - p, axis=1)
        for n, i in enumerate([i for i in np.argsort(d, kind="stable") if d[i] < radius][:k]):
            want[j, n + 1] = i
    assert got == want


def _joined_rows(node) -> int:
    """The most rows that any join of an executed plan put out."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        below = [node.executedPlan()]
    elif kind.endswith("QueryStageExec"):
        below = [node.plan()]
    else:
        below = [node.children().apply(i) for i in range(node.children().size())]
    return max([node.metrics().apply("numOutputRows").value() if "Join" in kind else 0, *map(_joined_rows, below)])


@pytest.mark.parametrize("k", [1, 4])
def test_crowds_against_brute_force(spark, k):
    """Many sources within the radius, at distinct places and at one: right edges, from far fewer pairs than there are."""
    rng = np.random.default_rng(7)
    near, spot = np.stack([rng.normal(12, 0.2, 2000), rng.normal(55, 0.2, 2000)], 1), np.repeat([[100.0, 20.0]], 1000, 0)
    far = np.stack([rng.uniform(-180, 180, 300), rng.uniform(-80, 80, 300)], 1)
    s = np.concatenate([near, spot, far])
    t = np.concatenate([near + 0.001, spot, far[:50] + 0.1, [[100.5, 20.5], [13.5, 56]]])
    t[:, 0] = np.where(t[:, 0] > 180, t[:, 0] - 360, t[:, 0])
    frames = [spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "i int, lon double, lat double") for x in (s, t)]
    edges = knn.knn_join(*frames, 300_000, k, ["i"], ["i"])
    got = {(r.t_i, r["rank"]): r.s_i for r in edges.collect()}
    a, b = (np.stack(geocentric_xyz(x[:, 0], x[:, 1]), 1) for x in (s, t))
    want = {}
    for j, p in enumerate(b):
        d = np.linalg.norm(a - p, axis=1)
        for n, i in enumerate([i for i in np.argsort(d, kind="stable")[:k] if d[i] < 300_000]):
            want[j, n + 1] = i
    assert got == want
    assert _joined_rows(edges._jdf.queryExecution().executedPlan()) < 400_000  # 5 million pairs lie within the radius


def test_edges_survive_a_file(spark, sw, tmp_path):
    area = AreaSpec.make(STERE, 40, 40, AREA_D.extent)
    edges = knn.neighbours(sw, area, 50_000, 2)
    knn.save_edges(edges, str(tmp_path / "edges"))
    back = knn.load_edges(spark, str(tmp_path / "edges"))
    one, two = (knn.weighted(e, sw, knn.gauss(30_000), ["value"]).orderBy("row", "col").collect() for e in (edges, back))
    assert one == two and len(one) > 100
    with pytest.raises(OSError):
        knn.load_edges(spark, str(tmp_path / "none"))


# filters


def test_reduction_is_a_superset(spark, sw):
    for area in (AREA_D, AreaSpec.make("+proj=laea +lat_0=-90 +a=6371228", 50, 50, (-5326849.0625,) * 2 + (5326849.0625,) * 2), AreaSpec.make(LL, 20, 20, (170, -10, 190, 10)), AreaSpec.make("+proj=stere +lat_0=90 +lat_ts=60", 30, 30, (-4e6,) * 2 + (4e6,) * 2)):
        points = spark.range(20_000).selectExpr("id as i", "(id * 7919 % 36000) / 100D - 180 as lon", "(id * 104729 % 18000) / 100D - 90 as lat")
        kept = {r.i for r in filters.reduce_to_area(points, area, 100_000).select("i").collect()}
        near = {r.s_i for r in knn.knn_join(points, area_grid(spark, area, xy=False), 100_000, 3, ["i"]).select("s_i").collect()}
        assert near <= kept and len(kept) < 20_000
    assert filters.boundary_predicate([(np.array([0, 500.0]), np.array([0, 0.0]))], 1) is None


def test_slices_and_masks(spark):
    pixels = spark.range(100).selectExpr("cast(id div 10 as int) as row", "cast(id % 10 as int) as col", "id as value")
    part = filters.slice_pixels(pixels, slice(2, 8, 2), slice(1, None, 3))
    assert sorted((r.row, r.col, r.value) for r in part.collect()) == [(i, j, (2 + 2 * i) * 10 + 1 + 3 * j) for i in range(3) for j in range(3)]
    area = AreaSpec.make(LL, 10, 10, (0, 0, 10, 10))
    points = spark.createDataFrame([(0.5, 9.5), (-0.5, 9.5), (-1.5, 9.5), (5.5, 5.5), (9.9, 0.1)], "lon double, lat double")
    mask = spark.createDataFrame([(0, 0), (9, 9)], "row int, col int")
    assert sorted(r.lon for r in filters.grid_filter(points, mask, area).collect()) == [-0.5, 0.5, 9.9]
    assert filters.in_corners(points, area).count() == 2 or filters.in_corners(points, area).count() == 3
    wide = spark.range(4000).selectExpr("cast(id div 40 as int) as row", "cast(id % 40 as int) as col", "id % 40 as lon", "(id div 40) / 2D as lat")
    tiles = filters.swath_slices(wide, AreaSpec.make(LL, 5, 5, (3, 3, 8, 8)), tile=10)
    assert {(r.tile_row, r.tile_col) for r in tiles.collect()} >= {(0, 0), (1, 0)} and tiles.count() < 40


# index gathers and interpolation


def test_linesample(spark):
    data = spark.range(1600).selectExpr("cast(id div 40 as int) as row", "cast(id % 40 as int) as col", "(id div 40) * (id % 40) as value")
    samples = spark.createDataFrame([(0, 0, 1, 25), (0, 1, 2, 26), (1, 0, 3, 27), (1, 1, 4, 28), (2, 0, 99, 0)], "row int, col int, s_row int, s_col int")
    assert {(r.row, r.col): r.value for r in grid.gather_lines(samples, data, ["value"], 0).collect()} == {(0, 0): 25, (0, 1): 52, (1, 0): 81, (1, 1): 112, (2, 0): 0}


def test_nearest_samples_keep_all_targets(sw, spark):
    target = spark.createDataFrame([(0, 0, 3.0, 75.0), (0, 1, 100.0, 0.0)], "row int, col int, lon double, lat double")
    assert {(r.col, r.s_row, r.s_col) for r in grid.nearest_samples(sw, target, 10_000).collect()} == {(0, 0, 0), (1, None, None)}


def test_bilinear_shares(spark):
    def solve(ul, ur, ll, lr, x, y):
        row = spark.range(1).select(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), *[F.struct(F.lit(float(p[0])).alias("x"), F.lit(float(p[1])).alias("y")).alias(n) for n, p in zip(bilinear.CORNERS, (ul, ur, ll, lr))])
        return tuple(bilinear.with_shares(row).select("t", "s").first())

    assert np.allclose(solve((-1, 1), (1, 2), (-2, -1), (2, -4), 0, 0), (0.375, 0.5))
    assert np.allclose(solve((-1, 1), (1, 1), (-1, -1), (1, -1), 0, 0), (0.5, 0.5))
    assert np.allclose(solve((-1, 1), (1, 2), (-1, -1), (1, -2), 0, 0), (0.5, 0.5), atol=0.2)
    assert solve((-1, 1), (1, 1), (-1, -1), (1, -1), 5, 0) == (None, None)


@pytest.fixture(scope="module")
def hundred(spark):
    return spark.range(10_000).selectExpr("cast(id div 100 as int) as row", "cast(id % 100 as int) as col", "-25D + (id % 100) * 65 / 99D as lon", "45D + (id div 100) * 30 / 99D as lat", "1D as value")


def test_bilinear_golden(hundred):
    area = AreaSpec.make(STERE, 4, 4, AREA_D.extent)
    table = bilinear.weights(hundred, area, 50e5).collect()
    at = {(r.row, r.col): r for r in table}
    assert len(at) == 12 and all(r.row < 3 for r in table)
    assert np.allclose((at[1, 1].t, at[1, 1].s), (0.730659147133, 0.310314173004), atol=1e-6)
    assert [r.value for r in bilinear.resample_bilinear(hundred, area, 50e5, ["value"], limit=True).collect()] == pytest.approx([1] * 12)


def test_gradient_golden(spark):
    geos = AreaSpec.make("+proj=geos +ellps=WGS84 +h=35785831 +lon_0=0", 100, 100, (5550000, 5550000, -5550000, -5550000))
    target = AreaSpec.make(3035, 5, 5, (2426378.0132, 1528101.2618, 6293974.6215, 5446513.5222))
    data = area_grid(spark, geos, lonlat=False, xy=False).withColumn("value", F.col("row") * 100.0 + F.col("col"))
    out = {(r.row, r.col): r.value for r in gradient.resample_gradient(data, geos, target, ["value"]).collect()}
    near = {(r.row, r.col): r.value for r in gradient.resample_gradient(data, geos, target, ["value"], "nn").collect()}
    lon, lat = target.lonlat_of(*np.meshgrid(np.arange(5.0), np.arange(5.0)))
    col, row = geos.array_coordinates_lonlat(lon, lat)
    assert np.allclose([[out[r, c] for c in range(5)] for r in range(5)], row * 100 + col, atol=1e-5)
    assert np.array_equal([[near[r, c] for c in range(5)] for r in range(5)], np.rint(row) * 100 + np.rint(col))
    with pytest.raises(ValueError):
        gradient.resample_gradient(data, geos, target, ["value"], "cubic")
    with pytest.raises(NotImplementedError):
        gradient.resample_gradient(data, None, data, ["value"])


def test_gradient_from_swath(sw):
    area = AreaSpec.make(LL, 8, 30, (3.4, 40.2, 11.4, 70.2))
    out = {(r.row, r.col): r.value for r in gradient.resample_gradient(sw, None, area, ["value"], radius=80_000).collect()}
    lon, lat = area.lonlat_of(*np.meshgrid(np.arange(8.0), np.arange(30.0)))
    want = (75 - lat) * (lon - 3)
    assert len(out) == 240 and all(abs(out[r, c] - want[r, c]) < 1e-6 for r, c in out)


# elliptical weighted averaging


@pytest.mark.parametrize("rows_per_scan,cells", [(10, 13817), (0, 13913)])
def test_ewa_golden(spark, rows_per_scan, cells):
    area = AreaSpec.make("+proj=lcc +datum=WGS84 +lon_0=-95 +lat_0=25 +lat_1=25", 100, 200, (-100000, -150000, 100000, 150000))
    s = spark.range(5000).selectExpr("cast(id div 50 as int) as row", "cast(id % 50 as int) as col", "-95D + (id % 50) * 20 / 49D as lon", "15D + (id div 50) * 15 / 99D as lat", "case when id div 50 <> 70 then 1D end as value")
    out = ewa.resample_ewa(s, area, ["value"], rows_per_scan, weight_delta_max=40).collect()
    assert len(out) == cells and np.allclose([r.value for r in out], 1)


def test_ewa_parts(spark):
    s = spark.range(400).selectExpr("cast(id div 20 as int) as row", "cast(id % 20 as int) as col", "(id % 20) * 0.3D as lon", "(id div 20) * 0.3D as lat", "cast(id as double) as value")
    area = AreaSpec.make(LL, 12, 12, (0, 0, 6, 6))
    assert ewa.points_in_grid(ewa.ll2cr(s, area), area) == 400
    placed, own = ewa.ll2cr_dynamic(s, area.crs, (0.5, 0.5))
    assert own.shape == (12, 12) and placed.agg(F.min("gc"), F.min("gr")).first()[0] == 0
    heavy = ewa.fornav(ewa.ll2cr(s, area), area, ["value"], 10, maximum_weight_mode=True)
    assert all(r.value == int(r.value) for r in heavy.collect())
    with pytest.raises(ValueError):
        ewa.weight(F.lit(0.5), 1, 0.01, 1.0)
    ints = spark.createDataFrame([(126.6,), (500.0,), (-1.5,), (-500.0,), (0.4,)], "v double").select(ewa.as_integer(F.col("v"), "byte").alias("b"))
    assert [r.b for r in ints.collect()] == [127, 127, -2, -128, 0]


# swaths, polygons, blocks


def test_swath_tables(spark, sw):
    both = swath.concatenate(sw.limit(0).unionByName(sw.where("row < 2")), sw.where("row < 3"))
    assert both.agg(F.max("row")).first()[0] == 4 and both.count() == 50
    with pytest.raises(DimensionError):
        swath.concatenate(sw, sw.drop("value"))
    small = swath.aggregate(sw, 5, 2)
    assert small.count() == 50 and np.allclose(small.where("row = 0 and col = 0").select("lon", "lat").first(), (3.5, 73), atol=0.01)
    ring = [(r.lon, r.lat) for r in swath.outline(sw, 10).orderBy("i").collect()]
    assert ring[0] == (3, 75) and (12, 26) in ring and len(ring) < 40


RAD = np.pi / 180


def test_polygons():
    area = lambda *p: SphericalPolygon(np.array(p) * RAD).area()
    assert np.isclose(area((1, 3), (2, 4), (3, 3), (4, 2), (3, 1), (2, 2)), 0.00121732523118)
    assert np.isclose(area((0, 89), (-90, 89), (180, 89), (90, 89)), 0.000609265770322)
    assert np.isclose(area((90, 0), (0, 0), (0, 90)), np.pi / 2)
    square = lambda lon, lat, n: SphericalPolygon(np.array([(lon, lat), (lon, lat + n), (lon + n, lat + n), (lon + n, lat)]) * RAD)
    a, b, inside, far = square(0, 0, 10), square(5, 5, 10), square(2, 2, 2), square(50, 0, 5)
    both, joint = a.intersection(b), a.union(b)
    assert np.isclose(both.area() + joint.area(), a.area() + b.area()) and np.isclose(convex_area(a.vertices), a.area())
    assert a.union(inside) is a and a.intersection(inside) is inside and a.union(far) is None and a.intersection(far) is None
    assert np.isclose(a.inverse().area(), 4 * np.pi - a.area()) and a.to_wkt().startswith("POLYGON ((0 0")
    merged = polygons.merge_overlapping({1: a, 2: far, 3: b})
    assert set(merged) == {2, (1, 3)} and np.isclose(merged[1, 3].area(), joint.area())


def test_arcs():
    p = lambda *v: np.array(v) * RAD
    a, b = Arc(p(0, 0), p(20, 0)), Arc(p(10, -10), p(10, 10))
    assert np.allclose(a.intersection(b), p(10, 0)) and a.intersects(b) and not a.intersects(Arc(p(30, -10), p(30, 10)))
    point, arc = a.next_intersection([Arc(p(15, -5), p(15, 5)), b])
    assert arc is b and np.allclose(point, p(10, 0)) and np.isclose(abs(a.angle(Arc(p(0, 0), p(0, 10)))), np.pi / 2)
    assert np.isclose(a.angle(Arc(p(0, 0), p(0, 10))), -a.angle(Arc(p(0, 0), p(0, -10))))
    with pytest.raises(ValueError):
        a.angle(b)
    with pytest.raises(ValueError):
        Arc(p(0, 100), p(0, 0))
    assert np.isclose(float(vincenty(0.0, 0.0, 0.0, 1e-9)) / RAD, 1e-9) and signed_angle(unit(0.0, 0.5), unit(0.0, 0.0), unit(0.5, 0.0)) != 0


def test_polygon_columns(spark):
    ring = np.array([(0, 0), (0, 10), (10, 10), (10, 0)]) * RAD
    other = ring + np.array([5, 5]) * RAD
    rows = spark.createDataFrame([([tuple(map(float, p)) for p in ring], [tuple(map(float, p)) for p in other], None)], "p array<struct<lon:double,lat:double>>, q array<struct<lon:double,lat:double>>, r array<struct<lon:double,lat:double>>")
    r = rows.select(polygon_area_column(F.col("p")).alias("a"), polygons.polygon_union("p", "q").alias("u"), polygons.polygon_intersection("p", "q").alias("i"), polygons.polygon_union("p", "r").alias("n")).first()
    area = lambda v: SphericalPolygon(np.array([(x.lon, x.lat) for x in v])).area()
    assert np.isclose(r.a, SphericalPolygon(ring).area()) and r.n is None and np.isclose(area(r.u) + area(r.i), 2 * r.a, rtol=0.05)


def test_a_long_chain_is_one_group(spark):
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    rows = [(i, [((x + 0.8 * i) * RAD, y * RAD) for x, y in ring]) for i in range(50)] + [(99, [(x * RAD, (y + 40) * RAD) for x, y in ring])]
    table = spark.createDataFrame(rows, "id int, points array<struct<lon:double,lat:double>>")
    assert {r.id: r.group for r in polygons.overlap_groups(table).collect()} == {**dict.fromkeys(range(50), 0), 99: 99}


def test_blocks(spark):
    source, target = (AreaSpec.make(LL, n, n, (0, 0, 10, 10)) for n in (40, 10))
    data = area_grid(spark, source, lonlat=False, xy=False).withColumn("value", (F.col("row") + F.col("col")).cast("double"))
    pick = lambda block, s, t: block[np.ix_(*[np.arange(n) * 4 for n in t.shape])]
    out = blocks.resample_blocks(pick, data, source, target, tile=10)
    assert {(r.row, r.col): r.value for r in out.collect()} == {(r, c): 4.0 * (r + c) for r in range(10) for c in range(10)}
    assert blocks.resample_blocks(pick, data, source, AreaSpec.make(LL, 5, 5, (50, 50, 60, 60))).count() == 0


# planning


def test_registry(spark, sw, tmp_path):
    assert registry.names() == ["bilinear", "ewa", "gauss", "gradient", "nearest"]
    with pytest.raises(ValueError):
        registry.register("nearest", registry.Nearest)
    registry.register("mine", registry.Nearest)
    registry.unregister("mine")
    with pytest.raises(KeyError):
        registry.create(sw, AREA_D, "mine")
    area = AreaSpec.make(STERE, 20, 20, AREA_D.extent)
    one = registry.create(sw, area, radius=50_000).precompute(str(tmp_path / "lut"))
    assert one.resample(sw, ["value"]).count() == knn.nearest(sw, area, 50_000, ["value"]).count() > 0
    assert one.hash() != registry.create(sw, area, radius=60_000).hash()
    data = area_grid(spark, area, lonlat=False, xy=False).withColumn("value", F.lit(1.0))
    assert registry.create(area, area, "gradient", spark=spark).resample(data, ["value"]).count() == 400
    assert registry.create(sw, area, "gauss", radius=50_000, sigma=20_000).resample(sw, ["value"]).count() > 0
    small = AreaSpec.make(LL, 10, 10, (4, 40, 11, 60))
    assert registry.create(sw, small, "ewa", rows_per_scan=10).resample(sw, ["value"]).count() > 50
    assert registry.create(sw, small, "bilinear", radius=300_000).resample(sw, ["value"]).count() > 50


def test_options_and_cache(tmp_path):
    calls = []

    def make(n):
        calls.append(n)
        return slice(0, n), n

    with registry.options(cache_dir=str(tmp_path), cache_geometry_slices=True):
        assert registry.cached_json("s", make, 5) == registry.cached_json("s", make, 5) == (slice(0, 5), 5)
    registry.cached_json("s", make, 5)
    assert calls == [5, 5] and registry.option("tile") == 256
    with pytest.raises(KeyError):
        with registry.options(nothing=1):
            pass


# streams


def test_stream(spark, tmp_path):
    rows = spark.range(300).selectExpr("(id * 13 % 360) - 180D as lon", "(id * 7 % 160) - 80D as lat", "cast(id as double) as value", "timestamp_seconds(1700000000 + id * 60) as ts")
    rows.write.parquet(str(tmp_path / "in"))
    area = AreaSpec.make(LL, 4, 2, (-180, -90, 180, 90))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    found = windowed_buckets(stream, area, "1 hour", "10 minutes", n=bucket.count(), total=bucket.total("value"))
    run = found.writeStream.format("memory").queryName("buckets").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    want = windowed_buckets(rows, area, "1 hour", "10 minutes", n=bucket.count(), total=bucket.total("value"))
    assert sorted(map(tuple, spark.table("buckets").collect())) == sorted(map(tuple, want.collect()))


def test_stream_through_edges(spark, sw, tmp_path):
    area = AreaSpec.make(STERE, 20, 20, AREA_D.extent)
    edges = knn.neighbours(sw, area, 50_000)
    sw.select("row", "col", "value").write.parquet(str(tmp_path / "px"))
    stream = spark.readStream.schema("row int, col int, value double").parquet(str(tmp_path / "px"))
    run = gather_stream(stream, edges, ["value"]).writeStream.format("memory").queryName("through").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("through").collect())) == sorted(map(tuple, knn.nearest(sw, area, 50_000, ["value"]).collect()))


def test_earth_radius():
    assert EARTH_RADIUS == 6370997.0
