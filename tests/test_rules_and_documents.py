import json
import re

import pytest
from pyspark.sql import functions as F

from larder.operators import rules
from larder.plans import cook
from larder.sources import documents


def test_the_first_rule_of_each_book_fits(spark):
    texts = ["", "Slow LAMB tagine", "tagine with lamb", "egg on toast", "toast with eggs", "scrambled eggs", "eggs scrambled", "oats", "oat", "nutmeg", "walnut bread", "fisherman's cod", "codfish", "salmon\ntraybake", "beanstew", "chickennoodle wrap", "été", "  "]
    table = [*cook.DISH_RULES, *cook.ALLERGEN_RULES]
    df = spark.createDataFrame([(t,) for t in texts] * 3 + [(None,)], "text string")
    want = {}
    for t in texts:
        for book, pattern, value in table:
            if re.search(pattern, t.lower()) and book not in want.setdefault(t, {}):
                want[t][book] = value
    got = {r.text: r.fits for r in rules.first_fits(df, table).collect()}
    assert got == {t: fits for t, fits in want.items() if fits}
    fits = sorted((r.text, r.book, r.value) for r in rules.all_fits(df, table).collect())
    assert fits == sorted((t, b, v) for t in texts for b, p, v in table if re.search(p, t.lower()))


def test_texts_are_read_once_for_all_rules(spark):
    df = spark.range(10).select(F.concat(F.lit("lamb "), F.col("id") % 2).alias("text"))
    plan = rules.all_fits(df, cook.DISH_RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.lower().count("rlike") == 1


def test_patterns_of_other_forms_are_refused(spark):
    for pattern in ("a|", "^a", "[ab]", "A"):
        with pytest.raises(ValueError):
            rules.table_of(spark, [("b", pattern, "v")])


def test_recipes_of_awkward_dishes(spark):
    dishes = spark.createDataFrame([(None, None, None), ("  ", "lunch", 0), (" Roast   fish \n tagine ", None, -3), ("yogurt", "breakfast", 2)], "dish string, meal string, servings int")
    got = {(r.title, r.meal): r for r in cook.rule_recipes(dishes).collect()}
    assert set(got) == {("Recipe", "dinner"), ("Recipe", "lunch"), ("Roast fish tagine", "dinner"), ("yogurt", "breakfast")}
    fish = got["Roast fish tagine", "dinner"]
    assert (fish.id, fish.servings, fish.prep, fish.cook, fish.difficulty, fish.allergens) == ("deterministic-roast-fish-tagine", 1, 15, 45, "medium", ["Gluten", "Fish/Shellfish"])
    assert [tuple(r) for r in fish.ingredients][:2] == [("White fish fillets", "700 g"), ("Couscous", "300 g")]
    assert got["yogurt", "breakfast"].allergens == ["Milk"] and got["Recipe", "dinner"].servings == 4
    assert cook.rule_recipes(dishes.limit(0)).collect() == []


GOOD = {
    "budgetAnalysis": "", "estimatedCost": 1, "safetyMargin": 1.5, "status": "critical", "recommendedBudget": None, "minimumBudget": 1e300, "mealPlan": [], "groceryList": [{"name": "a", "quantity": "", "estimatedCost": 0, "category": "c"}], "savingTips": ["é"],
}


def changed(**kw):
    return json.dumps({k: v for k, v in (GOOD | kw).items() if v != "gone"})


def test_good_and_broken_documents_add_up(spark):
    texts = [
        changed(), changed(extra={"a": 1}), None, "", "{", "null", "7", "[]", '"x"', changed(status="other"), changed(status=None), changed(status="gone"), changed(recommendedBudget="1"), changed(minimumBudget=None), changed(minimumBudget="gone"), changed(mealPlan=None),
        changed(mealPlan=[1, {"day": "a", "breakfast": "b", "lunch": None}]), changed(groceryList=[{"name": "a", "quantity": "", "estimatedCost": -0.01, "category": "c"}]), changed(savingTips=[["a"], None, 1]), changed(estimatedCost=True, safetyMargin={}),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, document string").repartition(3)
    good, broken = documents.checked(df, documents.PLAN, documents.PLAN_TYPE)
    assert sorted(r.id for r in good.collect()) == [0, 1, 13]
    found = {}
    for r in broken.collect():
        found.setdefault(r.id, []).append((r.path, r.reason))
    among = "not one of comfortable, optimized, critical, too_low"
    assert {i: sorted(v) for i, v in found.items()} == {
        **{i: [("$", "no JSON")] for i in (2, 3, 4)}, **{i: [("$", "expected object")] for i in (5, 6, 7, 8)}, 9: [("$.status", among)], 10: [("$.status", "expected string")], 11: [("$.status", "missing")], 12: [("$.recommendedBudget", "expected number")],
        14: [("$.minimumBudget", "missing")], 15: [("$.mealPlan", "expected array")], 16: [("$.mealPlan[0]", "expected object"), ("$.mealPlan[1].dinner", "missing"), ("$.mealPlan[1].lunch", "expected string")],
        17: [("$.groceryList[0].estimatedCost", "below 0")], 18: [("$.savingTips[0]", "expected string"), ("$.savingTips[1]", "expected string"), ("$.savingTips[2]", "expected string")], 19: [("$.estimatedCost", "expected number"), ("$.safetyMargin", "expected number")],
    }
    record = good.where("id = 0").first().record
    assert (record.minimumBudget, record.groceryList[0].category, record.savingTips) == (1e300, "c", ["é"])
