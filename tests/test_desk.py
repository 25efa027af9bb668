"""Orders as people sort, words that bring dishes to recipes, records and reports on awkward rows."""

import random

from pyspark.sql import functions as F

from larder.functions import records
from larder.operators import names, reports
from larder.plans import kitchen


def test_a_list_is_ordered_as_people_sort(spark):
    said = ["Zucchini", "apple", "Éclair", "eggs", "Eggplant", "Apricot", "zest", "Öl", "olives"]
    df = spark.createDataFrame([(1, n, "1 kg", i) for i, n in enumerate(said)], "basket long, name string, text string, ord int")
    rows = kitchen.grocery(df, F.lit(1.0)).where("category = 'Healthy Fats'").orderBy("place").collect()
    got = [r.name for r in rows]
    import unicodedata

    plain = lambda s: unicodedata.normalize("NFD", s).encode("ascii", "ignore").decode().lower()
    assert len(got) > 3 and got == sorted(got, key=plain) and "Éclair" in got and got.index("Éclair") < got.index("Öl")


def test_dishes_meet_every_name_that_shares_enough(spark):
    rng = random.Random(5)
    words = ["with"] * 6 + [f"w{i}x" for i in range(14)]
    texts = lambda n: sorted({" ".join(rng.choices(words, k=rng.randint(1, 7))) for _ in range(n)})
    dishes, recipes = texts(120), texts(200)
    asked = spark.createDataFrame([(d, None, None) for d in dishes], "dish string, cuisine string, meal string")
    offered = spark.createDataFrame([(i, n, 1.0, None, None) for i, n in enumerate(recipes)], "recipe long, name string, weight double, cuisine string, meal string")

    def score(n, h):
        if n == h:
            return 1000
        a, b = n.split(), h.split()
        if len(a) >= 2 and n in h:
            return 700
        if len(b) >= 2 and h in n:
            return 650
        shared = sum(t in b for t in a)
        return 50 * shared if shared >= max(2, -(-len(a) * 55 // 100)) else 0

    want = {}
    for d in dishes:
        top = max((score(d, h), -i) for i, h in enumerate(recipes))
        if top[0] >= 50:
            want[d] = (-top[1], top[0])
    got = {r.dish: (r.recipe, r.score) for r in names.best_recipe(asked, offered).collect()}
    assert got == want and len(want) > 60


def test_a_common_word_brings_no_dish_that_has_rarer_ones(spark):
    dishes = spark.createDataFrame([(f"soup with a{i} b{i}", ["soup", "with", f"a{i}", f"b{i}"]) for i in range(300)], "dish string, words array<string>")
    recipes = spark.createDataFrame([(f"soup with c{i}", ["soup", "with", f"c{i}"]) for i in range(300)], "name string, others array<string>")
    assert names.sharing(dishes, recipes).count() == 0


def test_records_have_defaults_for_what_is_missing(spark):
    df = spark.createDataFrame([("7", "Pasta al Forno!", 5, 20, None, None, None, ""), ("8", "x", 1, 2, "hard", (1, 2, 3, 4), ["Egg"], "Big  Soup & co")], "id string, t string, p int, c int, d string, n struct<calories:int,protein:int,carbs:int,fat:int>, a array<string>, q string")
    a, b = [r.r for r in df.select(records.recipe_record(*[F.col(c) for c in df.columns]).alias("r")).collect()]
    assert (a.id, a.servings, a.minutes, a.difficulty, tuple(a.nutrition), a.allergens) == ("local-7", 4, 25, "easy", (480, 22, 55, 16), [])
    assert a.image.endswith("food,pasta%2Cal%2Cforno") and b.image.endswith("food,big%2Csoup%2Cco") and (b.difficulty, tuple(b.nutrition), b.allergens) == ("hard", (1, 2, 3, 4), ["Egg"])


def test_reports_without_rows_of_a_kind_lack_its_section(spark):
    who = spark.createDataFrame([(1, "it", "EUR", "", "Italia", 50.0, 40.5, -3.0, True), (2, "xx", "CHF", "Bern", None, None, 1.0, 2.5, None)], "report long, language string, currency string, city string, country string, budget double, spend double, savings double, zero_day boolean")
    meals = spark.createDataFrame([(1, 0, "a", "b", None), (9, 0, "x", "y", "z")], "report long, day int, breakfast string, lunch string, dinner string")
    goods = spark.createDataFrame([(2, 1, "Bread", None, "Carbohydrates")], "report long, place int, name string, quantity string, category string")
    shops = spark.createDataFrame([], "report long, place int, name string, total double, cheapest boolean")
    rows = [tuple(r) for r in reports.report_rows(who, meals, goods, shops).orderBy("report", "section", "ord").collect()]
    nb = "\u00a0"
    assert rows == [
        (1, 1, 0, "Italia", None), (1, 2, 0, "Budget", f"50,00{nb}€"), (1, 2, 1, "Spesa stimata", f"40,50{nb}€"), (1, 2, 2, "Risparmio previsto", f"0,00{nb}€"), (1, 2, 3, "Giorno a Zero Spese", "Sì"),
        (1, 3, 0, "Colazione", "a"), (1, 3, 1, "Pranzo", "b"), (1, 3, 2, "Cena", None),
        (2, 1, 0, "Bern · ", None), (2, 2, 0, "Budget", "CHF 0.00"), (2, 2, 1, "Estimated spend", "CHF 1.00"), (2, 2, 2, "Expected savings", "CHF 2.50"), (2, 2, 3, "Zero Spend Day", "No"), (2, 4, 1, "• Bread — ", "Carbohydrates"),
    ]
    empty = reports.report_rows(who.limit(0), meals.limit(0), goods.limit(0), shops)
    assert empty.collect() == [] and empty.columns == list(reports.COLUMNS)
