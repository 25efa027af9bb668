import pytest
from pyspark.sql import functions as F

from larder.functions import measure, quantity, text
from larder.plans.planning import score, without_dislikes


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("said", "want"),
    [("1.5 kg", (1.5, "kg")), ("250 g", (250.0, "g")), ("2 tbsp", (30.0, "ml")), ("1 cup", (240.0, "ml")), ("8 slices", (1.0, "unit")), ("41 slices", (3.0, "unit")), ("3 cloves", (15.0, "g")), ("12 leaves", (1.0, "unit")), ("2 packs", (2.0, "pack")), ("4", (4.0, "unit")), ("1,5 kg", (1.0, "unit")), ("about 2 tins", (2.0, "unit")), ("2 stalks", None), ("to taste", None), ("0 g", None)],
)
def test_shopping_quantities(spark, said, want):
    got = one(spark, quantity.parse_shopping(F.lit(said)))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    ("need", "unit", "size", "grams", "packs"),
    [("2", "kg", 1.0, 100.0, 1), ("11", "kg", 1.0, 100.0, 2), ("450 ml", "g", 400.0, None, 2), ("0.6 kg", "ml", 500.0, None, 2), ("200 ml", "unit", 1.0, None, 1), ("900 g", "unit", 1.0, 400.0, 3), ("250 g", "kg", 1.0, None, 1), ("900 g", "unit", 1.0, None, None), ("3", "g", 200.0, None, None)],
)
def test_packs(spark, need, unit, size, grams, packs):
    assert one(spark, quantity.pack_count(quantity.parse_shopping(F.lit(need)), F.lit(unit), F.lit(size), F.lit(grams).cast("double"))) == packs


@pytest.mark.parametrize(
    ("said", "by", "want"),
    [("3 cans", 0.7, "2 cans"), ("12", 1.25, "15"), ("300 g", 0.7, "200 g"), ("1.5 kg", 1.5, "2.5 kg"), ("1 kg", 1.25, "1.3 kg"), ("1 l", 3.0, "3 l"), ("2 loaves", 30 / 7, "9 loaves"), ("2 bulbs", 1.25, "2.5 bulbs"), ("to taste", 2.0, "to taste")],
)
def test_scaled_templates(spark, said, by, want):
    assert one(spark, quantity.scale_template(F.lit(said), F.lit(by))) == want


@pytest.mark.parametrize(("amount", "kind", "label", "want"), [(120.0, "g", "g", "150 g"), (999.0, "g", "g", "1000 g"), (1000.0, "g", "g", "1 kg"), (1130.0, "g", "g", "1.25 kg"), (60.0, "ml", "ml", "100 ml"), (2.2, "pcs", "cans", "3 cans"), (0.2, "pcs", "pcs", "1 pcs"), (0.0, "raw", "to taste", "to taste")])
def test_shown_amounts(spark, amount, kind, label, want):
    assert one(spark, quantity.show_amount(F.lit(amount), F.lit(kind), F.lit(label))) == want


def test_money_and_distance(spark):
    assert one(spark, measure.round2(F.lit(1.005))) == 1.0
    assert one(spark, measure.convert(F.lit(10.0), F.lit("GBP"), F.lit("EUR"))) == pytest.approx(11.6)
    assert one(spark, measure.convert(F.lit(10.0), F.lit("JPY"), F.lit("EUR"))) is None
    assert one(spark, measure.haversine_km(*[F.lit(x) for x in (51.5, -0.1, 48.85, 2.35)])) == pytest.approx(342.40074706)
    assert one(spark, measure.lcg_states(F.lit(1), 4)) == [1107666780, 795024139, 3310400750, 350025589]
    assert tuple(one(spark, measure.parse_price(F.lit("1.234,50 €")))) == (1234.5, "EUR")


@pytest.mark.parametrize(("budget", "people", "period", "tier"), [(60, 4, "weekly", "low"), (70, 4, "weekly", "medium"), (116, 4, "weekly", "medium"), (117, 4, "weekly", "premium"), (250, 2, "monthly", "premium"), (500, 8, "monthly", "low"), (1000, 12, "monthly", "premium"), (0, 4, "weekly", "medium")])
def test_budget_tiers(spark, budget, people, period, tier):
    assert one(spark, measure.budget_tier(F.lit(float(budget)), F.lit(people), F.lit(period))) == tier


@pytest.mark.parametrize(
    ("row", "want"),
    [((80.0, 100.0, 4, "weekly", False, 20, False, 0), ("comfortable", 20, 0, 1040, 100, 84, 93, 5.6)), ((95.0, 100.0, 4, "weekly", True, 20, False, 0), ("optimized", 5, 0, 260, 88, 90, 92, 8.0)), ((120.0, 100.0, 4, "weekly", False, 20, False, 0), ("over", 0, 20, 0, 40, 84, 60, 5.6)), ((40.0, 50.0, 4, "weekly", False, 20, False, 0), ("too_low", 10, 0, 520, 100, 84, 93, 5.6)), ((300.0, 400.0, 2, "monthly", True, 9, True, 0), ("comfortable", 100, 0, 1200, 100, 90, 99, 4.0)), ((80.0, 100.0, 4, "weekly", False, 20, False, 1), ("unavailable", 0, 0, 0, 0, 0, 0, 5.6))],
)
def test_scorecard(spark, row, want):
    columns = "spend double, budget double, household int, period string, zero_day boolean, items int, healthy boolean, missing int"
    got = score(spark.createDataFrame([row], columns).withColumn("id", F.lit(1))).first()
    assert tuple(got[c] for c in ("status", "savings", "over", "annual_savings", "efficiency", "waste", "total", "saved_kg")) == want


def test_texts(spark):
    assert one(spark, text.encode_component(F.lit("a b+c!'()*"))) == "a%20b%2Bc!'()*"
    assert one(spark, text.slug(F.lit(" Red  Onions! "))) == "red-onions"
    assert one(spark, text.host(F.lit("https://www.Shop.example/x?q=1"))) == "shop.example"
    assert one(spark, text.strip_tags(F.lit("<p>a&amp;b<script>x<y</script> <b>c</b></p>"))) == "a&b c"
    assert one(spark, without_dislikes(F.array(F.lit("fish")), F.array(F.lit("fish")))) == ["fish"]
