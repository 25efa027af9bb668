import pytest
from pyspark.sql import functions as F

from larder.sources import connector
from larder.sources.tables import PRICE, PROVIDERS, load_prices


@pytest.fixture(scope="module")
def prices(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("connector")
    rows = [(f"rice {k}", "Grains", "kg", 1.0, k / 10, "EUR", ("*", "Rome", "Bari")[k % 3], ("Italy", "France", "Côte d'Or")[k % 7 % 3], 0.8, k) for k in range(210)] + [("none", None, None, None, None, None, None, "Italy", None, None)]
    df = spark.createDataFrame(rows, PRICE)
    for kind in ("parquet", "csv", "json"):
        df.repartition("country").write.partitionBy("country").format(kind).option("header", True).save(str(base / kind))
    connector.register(spark)
    return base, df


def plain(df):
    return sorted(map(tuple, df.select("ingredient", "price", "city", "country", "ord").collect()), key=str)


@pytest.mark.parametrize("kind", ["parquet", "csv", "json"])
def test_a_table_is_read_whole(spark, prices, kind):
    base, df = prices
    got = spark.read.format(connector.NAME).option("kind", kind).load(str(base / kind))
    want = df.fillna("", ["category", "unit", "currency", "city"]) if kind == "csv" else df
    assert plain(got.fillna("", ["city"])) == plain(want.fillna("", ["city"])) and got.rdd.getNumPartitions() == 3


def test_filters_choose_partitions_and_go_into_files(spark, prices):
    base, df = prices
    read = lambda: spark.read.format(connector.NAME).load(str(base / "parquet"))
    for test, parts in (("country = 'France'", 1), ("country in ('Italy', 'Mars')", 1), ("country = 'Côte d''Or' and price > 3.5 and city = 'Rome'", 1), ("price <= 0.4", 3), ("country = 'Mars'", 1), ("country > 'D' and ingredient like '%7'", 3), ("price is null", 3)):
        got = read().where(test)
        assert plain(got) == plain(df.where(test)) and got.rdd.getNumPartitions() == parts, test
    plan = read().where("country = 'France' and price > 3.5")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter (" not in plan  # both tests went into the scan, nothing is left for Spark
    assert spark.read.format(connector.NAME).load().count() == 0


def test_readers_keep_what_files_answer():
    reader = connector.PriceReader({"path": ""}, None)
    left = list(reader.pushFilters([connector.EqualTo(("country",), "France"), connector.GreaterThan(("country",), "A"), connector.LessThan(("price",), 3.0), connector.LessThan(("city",), "M")]))
    assert [type(f).__name__ for f in left] == ["GreaterThan", "LessThan"] and [f.column for f in reader.filters] == ["country", "price"]


def test_a_stream_reads_each_file_once(spark, prices, tmp_path):
    _, df = prices
    place, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.format(connector.NAME).load(place)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()

    import pyarrow.parquet as pq

    names = [f for f in df.columns if f != "country"]
    for number, country in enumerate(("Italy", "France", "Italy")):
        folder = tmp_path / "in" / f"country={country}"
        folder.mkdir(parents=True, exist_ok=True)
        pq.write_table(df.where(F.col("ord") % 3 == number).select(names).toArrow(), folder / f"{number:05d}.parquet")
        run()
    assert spark.read.parquet(out).count() == df.where("ord is not null").count()


def test_the_registry_reads_it_beside_others(spark, prices):
    base, df = prices
    got = load_prices(spark, [("connector", str(base / "parquet")), ("connector", '{"path": "%s", "kind": "json"}' % (base / "json")), ("connector", "{}")])
    assert got.count() == df.where("price > 0").select("ingredient", "city", "country").distinct().count()


def test_every_connector_is_empty_without_a_place_and_reads_the_one_it_is_given(spark, prices):
    base, _ = prices
    for name in ("external_api", "web_import", "csv_import", "scraper", "open_food_facts", "tesco", "carrefour", "walmart", "kroger"):
        assert PROVIDERS[name](spark, "").isEmpty()
        assert PROVIDERS[name](spark, str(base / "parquet")).where("country = 'France'").count() == 60
