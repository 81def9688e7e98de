import math

import pytest
from pyspark.sql import functions as F

from surfacewx.functions import (
    distance_m,
    latitude_band,
    observation_key,
    or_empty,
    round_half_up_x10,
    signed_fixed,
    station_id_of,
    station_key,
    station_label,
)


def _one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_distance_same_point_is_zero(spark):
    assert _one(spark, distance_m(29.76, -95.37, 12.0, 29.76, -95.37, 12.0)) == 0.0


def test_distance_height_only(spark):
    assert _one(spark, distance_m(10.0, 20.0, 0.0, 10.0, 20.0, 100.0)) == pytest.approx(100.0, abs=1e-9)


def test_distance_antipodal(spark):
    d = _one(spark, distance_m(0.0, 0.0, 0.0, 0.0, 180.0, 0.0))
    assert d == pytest.approx(math.pi * 6371000.0, rel=1e-12)


def test_distance_across_antimeridian(spark):
    d = _one(spark, distance_m(0.0, 179.9, 0.0, 0.0, -179.9, 0.0))
    # 0.2 degrees of the equator, not 359.8
    assert d == pytest.approx(math.radians(0.2) * 6371000.0, rel=1e-9)


def test_distance_symmetric_and_null(spark):
    a = _one(spark, distance_m(29.0, -95.0, 10.0, 31.5, -97.25, 250.0))
    b = _one(spark, distance_m(31.5, -97.25, 250.0, 29.0, -95.0, 10.0))
    assert a == pytest.approx(b, rel=1e-15)
    assert _one(spark, distance_m(F.lit(None).cast("double"), 0.0, 0.0, 1.0, 1.0, 1.0)) is None


def test_latitude_band_is_necessary(spark):
    # every point within the radius lies inside the band
    df = spark.range(0, 2000).select(
        (F.lit(20.0) + F.col("id") * 0.01).alias("lat"), (F.lit(-100.0) + (F.col("id") % 37) * 0.3).alias("lon")
    )
    r = 600000.0
    within = df.filter(distance_m(29.761993, -95.366302, 12.0, F.col("lat"), F.col("lon"), 12.0) <= r)
    outside_band = within.filter(~latitude_band(F.col("lat"), 29.761993, r))
    assert within.count() > 0
    assert outside_band.count() == 0


@pytest.mark.parametrize(
    "path,obs_id,station",
    [
        ("A-B-2008.gz", "A-B-2008", "A-B"),
        ("A-B-2008", "A-B-2008", "A-B"),
        ("/x/y/A-B-2008.txt.gz", "A-B-2008.txt", "A-B"),
        ("file:/data/722430-12960-2008.gz", "722430-12960-2008", "722430-12960"),
        ("README", "README", None),
    ],
)
def test_keys(spark, path, obs_id, station):
    row = spark.createDataFrame([(path,)], "p string").select(
        observation_key("p").alias("o"), station_key(observation_key("p")).alias("s")
    ).first()
    assert row.o == obs_id
    assert row.s == station


def test_station_id_of(spark):
    assert _one(spark, station_id_of(F.lit("A12345"), F.lit("00012"))) == "A12345-00012"


def test_round_half_up(spark):
    vals = [(2.45,), (-2.45,), (0.05,), (-0.05,), (27.8,)]
    got = [r.x for r in spark.createDataFrame(vals, "v double").select(round_half_up_x10("v").alias("x")).collect()]
    assert got == [25, -24, 1, 0, 278]  # ties go towards +infinity


def test_signed_formats_and_null_guard(spark):
    df = spark.createDataFrame([(29.98, -95.36, 29.0), (None, None, None), (-0.5, 5.0, -12.3)], "a double, b double, c double")
    rows = df.select(
        signed_fixed("a", "%+07.3f").alias("a"), signed_fixed("b", "%+08.3f").alias("b"), signed_fixed("c", "%+07.1f").alias("c")
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("+29.980", "-095.360", "+0029.0"),
        ("", "", ""),
        ("-00.500", "+005.000", "-0012.3"),
    ]


def test_or_empty(spark):
    df = spark.createDataFrame([(None,), ("x",)], "s string")
    assert [r.x for r in df.select(or_empty("s").alias("x")).collect()] == ["", "x"]


def test_station_label(spark):
    df = spark.sql(
        "SELECT 'A-B' AS station_id, 'NAME' AS station_name, CAST(NULL AS STRING) AS country, 'TX' AS state,"
        " CAST(NULL AS STRING) AS icao, 29.98D AS latitude, -95.36D AS longitude, CAST(NULL AS DOUBLE) AS elevation,"
        " DATE'1970-01-01' AS begin, DATE'2018-05-01' AS end"
    )
    assert df.select(station_label().alias("l")).first().l == "A-B: NAME,,TX,, (29.98,-95.36,), [19700101-20180501]"


@pytest.mark.parametrize(
    "lat0,lon0,radius",
    [(29.761993, -95.366302, 600000.0), (0.0, 179.5, 300000.0), (-45.0, -179.9, 1000000.0), (60.0, 10.0, 2000000.0), (80.0, 0.0, 1500000.0)],
)
def test_longitude_band_is_necessary(spark, lat0, lon0, radius):
    from surfacewx.functions.geo import longitude_band

    # a dense grid around the centre, across the antimeridian where relevant
    df = spark.range(0, 40000).select(
        (F.lit(lat0 - 25.0) + (F.col("id") % 200) * 0.25).alias("lat"),
        (F.pmod(F.lit(lon0 + 180.0 - 100.0) + (F.col("id") / 200).cast("int") * 1.0, F.lit(360.0)) - 180.0).alias("lon"),
    ).filter((F.col("lat") >= -90) & (F.col("lat") <= 90))
    within = df.filter(distance_m(lat0, lon0, 0.0, F.col("lat"), F.col("lon"), 0.0) <= radius)
    band = longitude_band(F.col("lon"), lat0, lon0, radius)
    assert within.count() > 0
    if band is None:
        assert lat0 + math.degrees(radius / 6371000.0) >= 90 or lat0 - math.degrees(radius / 6371000.0) <= -90
    else:
        assert within.filter(~band).count() == 0
        assert df.filter(band).count() < df.count()  # it does prune


@pytest.mark.parametrize("lat0,lon0,radius", [(29.761993, -95.366302, 600000.0), (0.0, 179.5, 300000.0), (-45.0, -179.9, 1000000.0), (60.0, 10.0, 2000000.0)])
def test_longitude_band_keeps_points_on_the_circle(spark, lat0, lon0, radius):
    from surfacewx.functions.geo import longitude_band

    R = 6371000.0
    d = radius * (1 - 1e-9) / R
    p0, l0 = math.radians(lat0), math.radians(lon0)
    pts = []
    for b in range(0, 3600):
        t = math.radians(b / 10)
        p = math.asin(math.sin(p0) * math.cos(d) + math.cos(p0) * math.sin(d) * math.cos(t))
        lam = l0 + math.atan2(math.sin(t) * math.sin(d) * math.cos(p0), math.cos(d) - math.sin(p0) * math.sin(p))
        lon = (math.degrees(lam) + 540.0) % 360.0 - 180.0
        pts.append((math.degrees(p), lon))
    df = spark.createDataFrame(pts, "lat double, lon double")
    within = df.filter(distance_m(lat0, lon0, 0.0, F.col("lat"), F.col("lon"), 0.0) <= radius)
    assert within.count() > 3000
    assert within.filter(~longitude_band(F.col("lon"), lat0, lon0, radius)).count() == 0
    assert within.filter(~latitude_band(F.col("lat"), lat0, radius)).count() == 0
