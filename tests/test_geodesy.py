import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geodesy as g

#: Points of four places, geographic and projected.
GOLDENS = [
    (26918, -75.73890, 35.39590, 432899.901, 3917198.926), (26915, -95.63490, 28.38690, 241810.975, 3142886.229), (26910, -122.34990, 35.79190, 558745.916, 3961062.442), (26908, -137.43590, 57.61290, 354484.054, 6388227.166),
    (3631, -75.73890, 35.39590, 905770.005, 187445.080), (3673, -95.63490, 28.38690, 929761.899, 4066097.205), (3495, -122.34990, 35.79190, 1697216.653, 556165.351), (3468, -137.43590, 57.61290, 593515.511, 649604.259),
]


@pytest.mark.parametrize("epsg, lon, lat, east, north", GOLDENS)
def test_projections(spark, epsg, lon, lat, east, north):
    df = spark.createDataFrame([(lon, lat)], "lon double, lat double")
    e, n = df.select(*g.PROJECTIONS[epsg].forward(F.col("lon"), F.col("lat"))).first()
    assert abs(e - east) < 0.03 and abs(n - north) < 0.03


@pytest.mark.parametrize("frame", ["ITRF2008", "ITRF2014"])
def test_frames_there_and_back(spark, frame):
    df = spark.createDataFrame([(-75.7, 35.4, 10.5), (-137.4, 57.6, -3.0), (0.0, 0.0, 0.0)], "x double, y double, z double")
    xyz = g.to_cartesian(F.col("x"), F.col("y"), F.col("z"))
    there = g.frame_shift(*xyz, frame, True)
    moved = df.select("x", "y", "z", *[c.alias(n) for c, n in zip(xyz, ("a", "b", "c"))], *[c.alias(n) for c, n in zip(there, ("p", "q", "r"))])
    back = g.from_cartesian(*g.frame_shift(F.col("p"), F.col("q"), F.col("r"), frame, False))
    for row in moved.select("*", *[c.alias(f"back_{n}") for c, n in zip(back, "xyz")]).collect():
        assert 0.3 < math.dist((row.a, row.b, row.c), (row.p, row.q, row.r)) < 4
        assert abs(row.back_x - row.x) < 1e-9 and abs(row.back_y - row.y) < 1e-9 and abs(row.back_z - row.z) < 1e-4


def test_rates_count_from_the_epoch():
    h = g.TO_NAD83["ITRF2008"]
    assert h.at(None) == h.at(1997.0) and abs(h.at(2007.0)[0][0] - (0.99343 + 0.0079)) < 1e-12
