"""Small cases of the name, recency, record and payload operators: empty, null, short and odd input."""

import datetime as dt

from pyspark.sql import functions as F

from larder.functions import records
from larder.operators import names
from larder.sources import payloads
from larder.streaming.recency import cache_hits, settled


def test_containing_finds_every_pair(spark):
    wholes, parts = ["cold widget", "ab", "a", "", None, "aaaa", "été café"], ["widget", "b", "a", "", None, "aaa", "ld w", "é c", "zzz"]
    got = names.containing(spark.createDataFrame([(w,) for w in wholes], "whole string"), spark.createDataFrame([(p,) for p in parts], "part string"))
    assert sorted(map(tuple, got.collect())) == sorted((w, p) for w in wholes if w for p in parts if p and p in w)


def test_first_price_prefers_the_same_name(spark):
    prices = spark.createDataFrame([("oil", 1.0, 5), ("olive oil", 2.0, 1), ("rice", 3.0, 2)], "name string, price double, ord int")
    asked = spark.createDataFrame([("oil",), ("virgin olive oil",), ("ri",), ("salt",), ("",), (None,)], "name string")
    assert {r.name: r.price for r in names.first_price(asked, prices).collect()} == {"oil": 1.0, "virgin olive oil": 2.0, "ri": 3.0}


def test_best_recipe_scores(spark):
    dishes = spark.createDataFrame([("Bean Chili", "x", "dinner"), ("spicy bean chili pot", "x", "lunch"), ("chili", "x", "lunch"), ("pot of bean and chili", "it", "lunch"), ("", "x", "y")], "dish string, cuisine string, meal string")
    recipes = spark.createDataFrame([(1, "bean chili", 1.0, "it", "dinner"), (2, "chili", 1.0, "x", "dinner"), (3, "hot bean chili", 0.9, "q", "q")], "recipe int, name string, weight double, cuisine string, meal string")
    got = {r.dish: (r.recipe, r.score) for r in names.best_recipe(dishes, recipes).collect()}
    # "bean chili" itself: 1000 and the meal; inside a longer dish: 650; "chili" is recipe 2: 1000 and the cuisine.
    assert got == {"Bean Chili": (1, 1060.0), "spicy bean chili pot": (1, 650.0), "chili": (2, 1200.0)}
    # "pot of bean and chili" has four words and shares two of the three needed; "chili" alone is one word.


def test_caches_and_bursts(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = spark.createDataFrame([("a", 1, at(0), True), ("a", 2, at(600), False), ("a", 3, at(601), False), ("b", 4, at(5), False), ("a", 5, at(5000), False)], "key string, id long, at timestamp, put boolean")
    assert {r.id: r.hit for r in cache_hits(rows, 600).collect()} == {2: True, 3: False, 4: False, 5: False}
    assert sorted(r.id for r in settled(rows.drop("put"), 600).collect()) == [3, 4, 5]
    assert cache_hits(rows.limit(0), 600).collect() == [] == settled(rows.drop("put").limit(0), 600).collect()


def test_records(spark):
    one = spark.range(1)
    got = one.select(
        records.interpolate(F.lit("{a} and {b}"), F.create_map(F.lit("a"), F.lit("x"))).alias("text"), records.steps(F.lit("Wash. Cut it.\r\n\nok\nFry it well")).alias("steps"),
        records.edited_line(F.lit("rice")).alias("line"), records.money(F.lit(1234.5), F.lit("EUR")).alias("money"), records.money(F.lit(2.0), F.lit("CHF")).alias("other"),
        records.locale(F.lit(None).cast("string"), F.lit("IT"), F.lit(None).cast("string")).alias("locale"), records.first_language(F.array(F.lit("pt-BR"), F.lit("IT-it"))).alias("language"),
    ).first()
    assert (got.text, got.steps, tuple(got.line), got.money, got.other, got.locale, got.language) == ("x and {b}", ["Wash.", "Cut it.", "Fry it well"], ("rice", ""), "€1,234.50", "CHF 2.00", "en", "it")


def test_broken_payloads_give_no_rows(spark):
    bad = spark.createDataFrame([(1, None), (2, ""), (3, "{"), (4, "[]"), (5, '{"items": null}')], "id long, payload string")
    for read in (payloads.shopping_rows, payloads.map_elements, payloads.geocoded):
        assert read(bad).collect() == []
    assert payloads.result_links(spark.createDataFrame([(1, None), (2, "<a>x</a>")], "page_id long, html string")).collect() == []
