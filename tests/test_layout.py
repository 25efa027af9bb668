import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.functions.measure import haversine_km
from larder.sources import layout


def scan_metrics(df, metric):
    """A metric summed over the file scans of a plan that has run."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    plan = plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.getClass().getSimpleName() else plan
    leaves = plan.collectLeaves()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        while not leaf.metrics().contains(metric) and "QueryStage" in leaf.getClass().getSimpleName():
            leaf = leaf.plan().collectLeaves().apply(0)
        if leaf.metrics().contains(metric):
            total += leaf.metrics().apply(metric).value()
    return total


@pytest.fixture(scope="module")
def prices(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("prices") / "p")
    rows = spark.range(4000).select(F.concat(F.lit("M"), F.col("id") % 10).alias("country"), F.when(F.col("id") % 3 == 0, "*").when(F.col("id") % 3 == 1, "rome").otherwise("bari").alias("city"), F.col("id").alias("key"), (F.col("id") / 7).alias("price"))
    layout.write_prices(rows, path)
    return path, rows


def test_one_market_reads_its_files(spark, prices):
    path, rows = prices
    got = layout.read_prices(spark, path, "M3", "rome")
    assert sorted(map(tuple, got.select("key", "price").collect())) == sorted(map(tuple, rows.where("country = 'M3' and city in ('*', 'rome')").select("key", "price").collect()))
    said = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(country" in said and "(country" in said and "PushedFilters: [In(city" in said
    assert scan_metrics(got, "numFiles") == 1 and scan_metrics(spark.read.parquet(path), "numFiles") == 10


def test_markets_known_at_run_time_prune_files_too(spark, prices):
    path, rows = prices
    markets = spark.createDataFrame([("M1", "x"), ("M7", "y"), ("none", "z")], "country string, name string").where("name < 'z'")
    got = layout.read_markets(spark, path, markets)
    assert got.count() == rows.where("country in ('M1', 'M7')").count()
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString() and scan_metrics(got, "numFiles") == 2


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stores") / "s")
    rng = np.random.default_rng(5)
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(np.degrees(np.arcsin(rng.uniform(-1, 1, 60_000))), rng.uniform(-180, 180, 60_000), strict=True))] + [(70_000, None, 1.0), (70_001, 90.0, 180.0), (70_002, -90.0, -180.0)]
    df = spark.createDataFrame(rows, "place_id long, plat double, plon double")
    layout.write_stores(df, path, group_bytes=1 << 14)
    return path, df


@pytest.mark.parametrize("lat, lon", [(45.0, 9.0), (0.0, 180.0), (10.0, -179.5), (89.5, 20.0), (-90.0, 0.0), (60.0, 0.0)])
def test_a_circle_is_exact_and_reads_what_is_near(spark, stores, lat, lon):
    path, df = stores
    km, read = haversine_km(F.lit(lat), F.lit(lon), F.col("plat"), F.col("plon")), []
    for radius in (2000.0, 200.0):
        got = layout.stores_within(spark, path, lat, lon, radius)
        assert sorted(r.place_id for r in got.collect()) == sorted(r.place_id for r in df.where(km <= radius).collect())
        read.append(scan_metrics(got, "numOutputRows"))
    assert read[1] < read[0] < 60_000 and read[1] < 12_000


def test_ranges_hold_the_keys_of_their_circle(spark):
    rng = np.random.default_rng(6)
    spots = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 3000), rng.uniform(-180, 180, 3000), strict=True)], "plat double, plon double")
    keyed = [(r.plat, r.plon, r.k) for r in spots.select("*", layout.curve_key(F.col("plat"), F.col("plon")).alias("k")).collect()]
    for circle in ((45.0, 9.0, 500.0), (-80.0, 170.0, 1500.0), (0.0, 0.0, 30.0)):
        for most in (1, 4, 64):
            ranges = layout.curve_ranges([circle], most)
            assert len(ranges) <= most and all(a <= b for a, b in ranges)
            inside = [k for a, b, k in keyed if any(s <= a <= n and w <= b <= e for s, w, n, e in layout.boxes(*circle))]
            assert all(any(low <= k <= high for low, high in ranges) for k in inside)
