import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.functions.measure import haversine_km
from larder.operators import near



def plain(points, places, k, radius):
    out = {}
    for i, lat, lon in points:
        if lat is None:
            continue
        a = np.sin(np.radians(places[:, 1] - lat) / 2) ** 2 + math.cos(math.radians(lat)) * np.cos(np.radians(places[:, 1])) * np.sin(np.radians(places[:, 2] - lon) / 2) ** 2
        km = 2 * 6371.0 * np.arcsin(np.sqrt(a))
        order = np.lexsort((places[:, 0], km.round(6)))
        out[i] = [(int(places[j, 0]), round(km[j], 6)) for j in order[:k] if km[j] <= radius]
    return {i: v for i, v in out.items() if v}


def same(got, want):
    assert {i: [j for j, _ in v] for i, v in got.items()} == {i: [j for j, _ in v] for i, v in want.items()}
    assert all(abs(a - b) < 1e-5 for i in want for (_, a), (_, b) in zip(got[i], want[i], strict=True))


def run(spark, points, places, k, radius):
    p = spark.createDataFrame(points, "point_id long, lat double, lon double")
    s = spark.createDataFrame([(int(i), float(a), float(b)) for i, a, b in places], "place_id long, plat double, plon double")
    got = {}
    for r in near.nearest(p, s, F.round(haversine_km(*[F.col(c) for c in ("lat", "lon", "plat", "plon")]), 6), k, radius).orderBy("point_id", "rank").collect():
        got.setdefault(r.point_id, []).append((r.place_id, round(r.km, 6)))
    return got, near.candidates(p, s, k, radius).count()


def towns(n, seed):
    """Places spread thinly, in a dense town, at one spot, around the date line and the poles."""
    rng = np.random.default_rng(seed)
    thin = np.stack([rng.uniform(40, 50, n // 4), rng.uniform(0, 12, n // 4)], 1)
    town = np.array([45.0, 5.0]) + rng.normal(0, 0.01, (n // 2, 2))
    line = np.stack([rng.uniform(-1, 1, n // 8), np.where(rng.random(n // 8) < 0.5, 179.9, -179.9) + rng.normal(0, 0.05, n // 8)], 1)
    pole = np.stack([rng.uniform(88, 90, n // 8), rng.uniform(-180, 180, n // 8)], 1)
    return np.concatenate([thin, town, line, pole, np.repeat([[46.5, 9.0]], 40, axis=0)])


def test_nearest_are_those_of_all_pairs(spark):
    spots = towns(1600, 1)
    places = np.column_stack([np.arange(len(spots)), spots])
    rng = np.random.default_rng(2)
    where = np.concatenate([spots[rng.integers(0, len(spots), 120)] + rng.normal(0, 0.02, (120, 2)), [[45.0, 5.3], [45.0, 4.6], [90.0, 0.0], [89.9, -170.0], [0.0, 180.0], [0.0, -180.0], [-60.0, 20.0], [46.5, 9.0]]])
    points = [(k, min(float(a), 90.0), float(b)) for k, (a, b) in enumerate(where)] + [(999, None, 1.0), (998, 1.0, None)]
    for k, radius in ((8, 300.0), (3, 25.0), (60, 2000.0)):
        got, _ = run(spark, points, places, k, radius)
        same(got, plain([p for p in points if None not in p], places, k, radius))


@pytest.mark.parametrize("n", [2000, 32000])
def test_candidates_follow_k_and_not_the_density(spark, n):
    spots = towns(n, 3)
    places = np.column_stack([np.arange(len(spots)), spots])
    edge = [(k, 45.0 + 0.4 * math.sin(k), 5.0 + 0.4 * math.cos(k)) for k in range(60)]  # the country around the town
    inside = [(100 + k, 45.0 + 0.01 * math.sin(k), 5.0 + 0.01 * math.cos(k)) for k in range(60)]
    got, met = run(spark, edge + inside, places, 8, 300.0)
    same(got, plain(edge + inside, places, 8, 300.0))
    assert met < 120 * 8 * 64  # at either density; all pairs inside the radius: 120 times more than half the places


def test_nothing_near(spark):
    assert run(spark, [(1, 0.0, 0.0)], np.array([[1, 50.0, 50.0]]), 8, 100.0) == ({}, 0)
    assert run(spark, [], np.array([[1, 50.0, 50.0]]), 8, 100.0)[0] == {} and run(spark, [(1, 0.0, 0.0)], np.zeros((0, 3)), 8, 100.0)[0] == {}
