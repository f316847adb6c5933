import numpy as np
import pytest

from gridloom.errors import AreaNotFound, IncompatibleAreas
from gridloom.plans.area import AreaSpec, StackedArea, check_slice_orientation, concatenate_areas, enclose_areas, geostationary_disk, swath_resolution
from gridloom.plans.create import DynamicArea, create_area, from_area_of_interest, from_circle, from_epsg, from_ul_corner, optimal_area
from gridloom.sources.area_files import area_from_cf, area_from_transform, area_list_rst, convert_to_yaml, dump_area, dump_legacy, load_area, parse_areas, parse_legacy

LL = "+proj=longlat +datum=WGS84"
EASE = AreaSpec.make("+proj=laea +lat_0=-90 +lon_0=0 +a=6371228", 425, 425, (-5326849.0625, -5326849.0625, 5326849.0625, 5326849.0625), "ease_sh", "Antarctic EASE grid")

YAML = """
ease_sh:
  description: Antarctic EASE grid
  projection: {a: 6371228.0, lat_0: -90, lon_0: 0, proj: laea, units: m}
  shape: {height: 425, width: 425}
  area_extent:
    lower_left_xy: [-5326849.0625, -5326849.0625]
    upper_right_xy: [5326849.0625, 5326849.0625]
    units: m
circle:
  description: by centre and radius
  projection: {proj: laea, lat_0: -90, a: 6371228.0}
  center: [0, 0]
  radius: {dx: 5326.8490625, dy: 5326.8490625, units: km}
  resolution: 25067.525
open:
  projection: {proj: merc}
  resolution: 1000
"""
REGION = """
# a comment
REGION: ease_sh {
    NAME:    Antarctic EASE grid
    PCS_ID:  ease_sh
    PCS_DEF: proj=laea, lat_0=-90, lon_0=0, a=6371228.0, units=m
    XSIZE:   425
    YSIZE:   425
    AREA_EXTENT: (-5326849.0625,-5326849.0625,5326849.0625,5326849.0625)
};
"""


def test_files(tmp_path):
    one, circle, open_ = parse_areas(YAML)
    assert one == EASE and circle.shape == (425, 425) and np.allclose(circle.extent, EASE.extent) and isinstance(open_, DynamicArea)
    assert load_area(YAML, "ease_sh") == EASE and parse_legacy(REGION) == [EASE]
    assert load_area([YAML, "ease_sh: {shape: {height: 10}}"], "ease_sh").shape == (10, 425)
    with pytest.raises(AreaNotFound):
        load_area(YAML, "nowhere")
    assert load_area(dump_area(EASE)) == EASE and parse_legacy(dump_legacy(EASE)) == [EASE]
    (tmp_path / "areas.cfg").write_text(REGION)
    convert_to_yaml(str(tmp_path / "areas.cfg"), str(tmp_path / "areas.yaml"))
    assert load_area(str(tmp_path / "areas.yaml")) == EASE and EASE.to_yaml() == dump_area(EASE)
    assert "ease_sh" in area_list_rst(REGION)


def test_create():
    base = dict(shape=(425, 425), projection=EASE.crs)
    res, half = EASE.pixel_size_x, 5326849.0625
    p = EASE.crs
    assert create_area("a", p, area_extent=EASE.extent, shape=(425, 425)) == EASE
    assert create_area("a", p, area_extent=EASE.extent, resolution=res) == EASE
    assert create_area("a", p, center=(0, 0), radius=half, resolution=res) == EASE == from_circle("a", p, (0, 0), half, resolution=res)
    assert from_area_of_interest("a", p, (425, 425), (0, 0), res) == EASE
    assert from_ul_corner("a", p, (425, 425), (-half, half), res) == EASE
    assert create_area("a", p, center=(0, 0), upper_left_extent=(-half, half), resolution=res) == EASE
    assert create_area("a", LL, center=(10, 20), radius=5, resolution=0.5).extent == (5, 15, 15, 25)
    assert np.allclose(create_area("a", p, center={"x": 0, "y": -90, "units": "degrees"}, radius=half, resolution=res).extent, EASE.extent, atol=1e-3)
    assert isinstance(create_area("a", **base), DynamicArea)
    with pytest.raises(ValueError, match="CONFLICTING DATA"):
        create_area("a", p, area_extent=EASE.extent, radius=1000, resolution=res)
    assert from_epsg(4326, 1).shape == (180, 360)


def test_cf_and_transform():
    mapping = {"grid_mapping_name": "geostationary", "perspective_point_height": 35785831.0, "semi_major_axis": 6378137.0, "semi_minor_axis": 6356752.3, "longitude_of_projection_origin": 0.0, "sweep_angle_axis": "y"}
    step = 0.01
    area = area_from_cf(mapping, {"first": -0.05 + step / 2, "last": 0.05 - step / 2, "n": 10, "units": "rad"}, {"first": 0.05 - step / 2, "last": -0.05 + step / 2, "n": 10, "units": "rad"})
    assert area.shape == (10, 10) and np.allclose(area.extent, np.array([-1, -1, 1, 1]) * 0.05 * 35785831)
    assert area_from_transform((0, 10, 0, 100, 0, -10), 5, 7, "EPSG:32633").extent == (0, 30, 50, 100)
    with pytest.raises(ValueError):
        area_from_transform((0, 10, 1, 100, 0, -10), 5, 7, 4326)
    with pytest.raises(ValueError):
        area_from_cf({"grid_mapping_name": "none"}, {}, {})


def test_parts():
    area = AreaSpec.make(LL, 10, 20, (0, 0, 10, 20))
    part = area[2:6, 3:9:2]
    assert part.shape == (4, 3) and part.extent == (3, 14, 9, 18)
    top, low = area[:8, :], area[8:, :]
    assert concatenate_areas(top, low) == area == concatenate_areas(low, top) and enclose_areas(top, low) == area
    with pytest.raises(IncompatibleAreas):
        concatenate_areas(top, area[9:, :])
    assert StackedArea.of(top, low).squeeze() == area and StackedArea.of(top, area[9:, :]).height == 19
    assert area.slices_over(AreaSpec.make(LL, 2, 2, (2, 3, 4, 5))) == (slice(2, 4), slice(15, 17))
    cols, rows = area.slices_over(AreaSpec.make("+proj=merc +datum=WGS84", 4, 4, (3e5, 3e5, 6e5, 6e5)), divisible_by=4)
    assert (cols.stop - cols.start) % 4 == 0 and cols.start <= 2 and cols.stop >= 6
    with pytest.raises(IncompatibleAreas):
        area.crop_around(AreaSpec.make(LL, 2, 2, (50, 3, 54, 5)))
    assert area.aggregate(2, 2).resolution == (2, 2) and check_slice_orientation(slice(5, 1)) == slice(5, 1, -1)
    assert area.digest() == AreaSpec.make(LL, 10, 20, (0, 0, 10, 20)).digest() != part.digest()


def test_overlap():
    a, b, c = (AreaSpec.make(LL, 10, 10, e) for e in ((0, 0, 10, 10), (5, 5, 15, 15), (50, 0, 60, 10)))
    assert a.overlaps(b) and not a.overlaps(c) and 0.15 < a.overlap_rate(b) < 0.4
    assert a.contains_lonlat(5.0, 5.0) and not a.contains_lonlat(30.0, 5.0)


def test_geostationary():
    full = AreaSpec.make("+proj=geos +a=6378169 +b=6356584 +h=35785831 +lon_0=0", 3712, 3712, (-5568742.4,) * 2 + (5568742.4,) * 2)
    x, y = geostationary_disk(full)
    lon, lat = full.crs.inverse(x, y)
    assert np.isfinite(lon).all() and np.abs(lon).max() > 70 and len(x) == 50
    sides = full.sides_lonlat()
    assert len(sides) == 4 and all(np.isfinite(s[0]).all() for s in sides) and full.is_geostationary
    assert 2900 < full.geocentric_resolution() < 9000  # the limb stretches the histogram


def test_from_data(spark):
    points = spark.createDataFrame([(10.0, 50.0), (20.0, 60.0), (500.0, 0.0)], "lon double, lat double")
    area = create_area("d", LL, resolution=1.0).freeze(points)
    assert area.extent == (10, 50, 20, 60) and area.shape == (10, 10)
    area = create_area("d", LL, shape=(11, 11)).freeze(points)
    assert np.allclose(area.extent, (9.5, 49.5, 20.5, 60.5))
    across = spark.createDataFrame([(179.0, 10.0), (-178.0, 20.0)], "lon double, lat double")
    dynamic = create_area("d", LL, resolution=1.0)
    assert dynamic.freeze(across).extent[0] == -178
    assert dynamic.freeze(across, antimeridian_mode="modify_extents").extent == (179, 10, 182, 20)
    moved = dynamic.freeze(across, antimeridian_mode="modify_crs")
    assert moved.extent == (-1, 10, 2, 20) and np.allclose(moved.array_coordinates_lonlat(np.array([-178.0]), np.array([10.0])), ([2.5], [9.5]))
    assert dynamic.freeze(across, antimeridian_mode="global_extents").extent[::2] == (-180, 180)
    with pytest.raises(ValueError):
        dynamic.freeze(points.where("lon > 900"))
    swath = spark.range(2000).selectExpr("cast(id div 40 as int) as row", "cast(id % 40 as int) as col", "10 + (id % 40) * 0.05 + (id div 40) * 0.02 as lon", "40 + (id div 40) * 0.05 as lat")
    best = optimal_area(swath)
    col, row = best.array_coordinates_lonlat(*np.array([(r.lon, r.lat) for r in swath.collect()]).T)
    assert (col >= -1).all() and (col <= best.width).all() and (row >= -1).all() and (row <= best.height).all()
    assert 8000 < swath_resolution(swath) < 10000 and swath_resolution(swath, resolution=500) == 1000
    with pytest.raises(RuntimeError):
        swath_resolution(points)
