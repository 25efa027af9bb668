"""F15 of the third round: what a task holds follows boxes and k, not points times the places around them."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from larder.functions.measure import haversine_km
from larder.operators import near
from tests.test_near import plain, run, same, towns

KM = ("lat", "lon", "plat", "plon")


def frames(spark, points, places):
    p = spark.createDataFrame(points, "point_id long, lat double, lon double")
    return p, spark.createDataFrame([(int(i), float(a), float(b)) for i, a, b in places], "place_id long, plat double, plon double")


def test_only_the_nearest_of_a_spot_become_rows(spark):
    rng = np.random.default_rng(5)
    places = np.column_stack([np.arange(4000), rng.uniform(45, 47, 4000), rng.uniform(5, 7, 4000)])
    spots = np.column_stack([rng.uniform(45.2, 46.8, 50), rng.uniform(5.2, 6.8, 50)])
    points = [(100 * i + k, float(a), float(b)) for i, (a, b) in enumerate(spots) for k in range(20)]  # 20 points a spot
    asked = spark.sparkContext.accumulator(0)

    def km(lat, lon, plat, plon):
        asked.add(1)
        a = np.sin(np.radians(plat - lat) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(plat)) * np.sin(np.radians(plon - lon) / 2) ** 2
        return float(round(2 * 6371.0 * np.arcsin(np.sqrt(a)), 6))

    p, s = frames(spark, points, places)
    got = {}
    for r in near.nearest(p, s, F.udf(km, DoubleType())(*KM), 8, 300.0).orderBy("point_id", "rank").collect():
        got.setdefault(r.point_id, []).append((r.place_id, r.km))
    same(got, plain(points, places, 8, 300.0))
    assert asked.value < 3 * 50 * 8 * 2  # before: every point asked for each of the some hundred places that it met


def test_points_given_more_than_once(spark):
    places = np.array([[k, 0.01 * k, 0.0] for k in range(30)] + [[1, 0.01, 0.0]])
    p, s = frames(spark, [(1, 0.0, 0.0), (1, -0.0, 0.0), (2, 0.0, 0.0), (3, float("nan"), 0.0), (None, 0.0, 0.0)] + [(4, 0.0, 0.0)] * 20, places)
    got = {}
    for r in near.nearest(p, s, haversine_km(*[F.col(c) for c in KM]), 5, 300.0).orderBy("point_id", "rank").collect():
        got.setdefault(r.point_id, []).append((r.rank, r.place_id))
    at = lambda *ids: list(enumerate(ids, 1))
    assert got == {None: at(0, 1, 1, 2, 3), 1: at(0, 0, 1, 1, 1), 2: at(0, 1, 1, 2, 3), 4: at(0, 0, 0, 0, 0)}


@pytest.mark.parametrize(("levels", "many", "crowd"), [(4, 1, 1), (0, 1, 1), (3, 10**9, 5)])
def test_boxes_of_any_size_give_the_same(spark, monkeypatch, levels, many, crowd):
    for name, value in (("LEVELS", levels), ("MANY", many), ("CROWD", crowd)):
        monkeypatch.setattr(near, name, value)
    spots = towns(320, 6)
    places = np.column_stack([np.arange(len(spots)), spots])
    points = [(k, min(float(a), 90.0), float(b)) for k, (a, b) in enumerate(spots[::9])]
    same(run(spark, points, places, 4, 120.0)[0], plain(points, places, 4, 120.0))
