import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions.crs import Crs, format_proj, parse_proj, transform
from gridloom.functions.mathx import fwhm_to_sigma, round_to_resolution, wrap_longitude
from gridloom.plans.area import AreaSpec

DEFINITIONS = [
    ("+proj=longlat +datum=WGS84", 12, 34),
    ("+proj=longlat +pm=180", 170, 34),
    ("+proj=merc +datum=WGS84", 20, 30),
    ("+proj=merc +lat_ts=30 +ellps=bessel +lon_0=10", 20, -30),
    ("+proj=stere +lat_0=90 +lat_ts=60 +lon_0=14 +ellps=bessel", 25, 60),
    ("+proj=stere +lat_0=-90 +lat_ts=-71", 25, -60),
    ("+proj=stere +a=6378144 +b=6356759 +lat_0=50 +lat_ts=50 +lon_0=8", 5, 48),
    (3035, 15, 45),
    ("+proj=laea +lat_0=-90 +a=6371228", 15, -45),
    ("+proj=laea +lat_0=90 +datum=WGS84 +units=km", 15, 45),
    ("+proj=lcc +lat_0=25 +lat_1=25 +lon_0=-95 +a=6371200 +b=6371200", -90, 30),
    ("+proj=lcc +lat_1=-30 +lat_2=-50 +lat_0=-40 +lon_0=10", 13, -35),
    ("+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96", -90, 30),
    ("+proj=geos +h=35785831 +lon_0=0", 10, 20),
    ("+proj=geos +h=35785831 +sweep=x +lon_0=-75", -60, -20),
    ("EPSG:32633", 16, 52),
    ("EPSG:32733", 16, -52),
    ("+proj=tmerc +lat_0=49 +lon_0=-2 +k_0=0.9996 +x_0=400000 +y_0=-100000 +ellps=airy", -1, 52),
    ("+proj=omerc +alpha=9 +lonc=13.8 +lat_0=0 +R=6370997", 14, 30),
    ("+proj=omerc +alpha=30 +lonc=13.8 +lat_0=40 +ellps=WGS84 +no_uoff", 14, 45),
    ("+proj=ob_tran +o_proj=eqc +o_lat_p=30 +o_lon_p=10 +lon_0=-10 +R=6371228", 14, 45),
    ("+proj=ob_tran +o_proj=longlat +o_lat_p=39.25 +lon_0=18", 14, 45),
    ("+proj=eqc +lat_ts=20 +R=6371000", 14, 45),
]


@pytest.mark.parametrize("definition,lon,lat", DEFINITIONS)
def test_inverse_undoes_forward_in_both_worlds(spark, definition, lon, lat):
    crs = Crs.of(definition)
    x, y = crs.forward(lon, lat)
    assert np.allclose(crs.inverse(x, y), (lon, lat), atol=1e-7)
    row = spark.createDataFrame([(float(lon), float(lat))], "lon double, lat double").select(*[c.alias(n) for c, n in zip(crs.forward(F.col("lon"), F.col("lat")), "xy")])
    back = row.select(*[c.alias(n) for c, n in zip(crs.inverse(F.col("x"), F.col("y")), "ab")]).first()
    assert np.allclose(row.first(), (x, y), rtol=1e-12, atol=1e-7) and np.allclose(back, (lon, lat), atol=1e-7)


@pytest.mark.parametrize("definition", [d[0] for d in DEFINITIONS])
def test_formulas_stay_small(spark, definition):
    """Neighbour joins copy a place several times; a formula that doubles in every step of an iteration cannot be planned."""
    crs = Crs.of(definition)
    for made in (crs.forward(F.col("a"), F.col("b")), crs.inverse(F.col("a"), F.col("b"))):
        assert sum(str(c).count("(") for c in made) < 800, max(len(str(c)) for c in made)


def test_published_values():
    # Snyder's numerical examples and well-known coordinates
    assert np.allclose(Crs.of(32633).forward(16, 52), (568649.7, 5761510.3), atol=0.1)
    assert np.allclose(Crs.of("+proj=lcc +lat_1=33 +lat_2=45 +lat_0=23 +lon_0=-96 +ellps=clrk66").forward(-75, 35), (1894410.9, 1564649.5), atol=0.1)
    assert np.allclose(Crs.of("+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +ellps=clrk66").forward(-75, 35), (1885472.7, 1535925.0), atol=0.1)
    assert np.allclose(Crs.of("+proj=merc +lon_0=-180 +ellps=clrk66").forward(-75, 35), (11688673.7, 4139145.6), atol=0.1)
    assert np.allclose(Crs.of("+proj=stere +lat_0=40 +lon_0=-100 +k_0=0.9999 +ellps=clrk66").forward(-90, 30), (971630.8, -1063049.3), atol=0.1)
    assert np.allclose(Crs.of("+proj=laea +lat_0=40 +lon_0=-100 +ellps=clrk66").forward(-110, 30), (-965932.1, -1056814.9), atol=0.1)


def test_off_the_map_is_missing():
    geos = Crs.of("+proj=geos +h=35785831 +lon_0=0")
    assert np.isnan(geos.forward(170.0, 0.0)).all() and np.isnan(geos.inverse(5.5e6, 5.5e6)).all()
    assert np.isnan(Crs.of("+proj=laea +lat_0=90 +R=6371228").inverse(2e7, 0)).any()


def test_definitions():
    text = "+proj=stere +a=6378144 +lat_0=50 +lon_0=8"
    assert parse_proj(format_proj(parse_proj(text))) == parse_proj(text)
    assert Crs.of({"proj": "longlat", "ellps": "WGS84"}).same_as(Crs.of(4326)) and Crs.of("+init=EPSG:3035") == Crs.of(3035)
    assert Crs.of("+proj=laea +lat_0=90 +units=km").units == "km" and Crs.of(4326).geographic
    for bad in ("+proj=nothing", "+lat_0=3", "EPSG:999999", "+proj=merc +ellps=flat"):
        with pytest.raises(ValueError):
            Crs.of(bad)
    assert np.allclose(transform(Crs.of(4326), Crs.of(3857), 20.0, 30.0), Crs.of(3857).forward(20.0, 30.0))


def test_small_functions():
    assert np.allclose(round_to_resolution(np.array([5.5, 4.2, 5.6]), 2), [6, 4, 6]) and np.isclose(round_to_resolution(5.5, 1.7), 5.1)
    assert np.allclose(wrap_longitude(np.array([-180.0, 180, 190, -190, 540])), [-180, -180, -170, 170, -180])
    assert np.isclose(fwhm_to_sigma(41627.730557884883), 25000)


def test_pixel_grid():
    area = AreaSpec.make("+proj=stere +a=6378144 +b=6356759 +lat_0=50 +lat_ts=50 +lon_0=8", 800, 800, (-1370912.72, -909968.64, 1029087.28, 1490031.36))
    assert np.allclose(area.upper_left, (-1369412.72, 1488531.36)) and np.isclose(area.pixel_size_x, 3000)
    lon, lat = area.lonlat_of(np.array([0.0, 799]), np.array([0.0, 799]))
    assert np.allclose(area.array_coordinates_lonlat(lon, lat), ([0, 799], [0, 799]), atol=1e-6)
    assert area.index_of_lonlat(float(lon[1]), float(lat[1])) == (799, 799)
    with pytest.raises(ValueError):
        area.index_of_lonlat(-100, 0)
