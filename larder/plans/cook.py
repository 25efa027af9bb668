"""Recipes by rules for dishes that no source knows, and saved documents against their contract; the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import rules
from larder.plans.carriers import table
from larder.plans.kitchen import pick
from larder.sources import documents
from larder.sources.scratch import spread

# Dishes that are known, in order, and their ingredients.
KNOWN_DISHES = (
    ("lamb.*tagine|tagine.*lamb", "Lamb shoulder: 800 g; Onions: 2; Carrots: 3; Chickpeas: 400 g; Chopped tomatoes: 400 g; Dried apricots: 100 g; Couscous: 300 g; Mixed spices: 20 g; Olive oil: 30 ml"),
    ("avocado.*toast|toast.*avocado", "Avocado: 2; Sourdough bread: 8 slices; Eggs: 4; Lemon: 1; Olive oil: 20 ml"),
    ("scrambled.*egg|egg.*toast", "Eggs: 8; Bread: 8 slices; Butter: 30 g; Milk: 60 ml"),
    ("yogurt|yoghurt|parfait", "Greek yogurt: 600 g; Granola: 200 g; Berries: 250 g; Honey: 40 g"),
    ("salmon.*traybake|traybake.*salmon", "Salmon fillets: 600 g; Cherry tomatoes: 400 g; Zucchini: 2; Lemon: 1; Olive oil: 30 ml"),
    ("pizza|margherita", "Pizza flour: 500 g; Tomato sauce: 300 ml; Mozzarella: 300 g; Fresh basil: 12 leaves; Olive oil: 30 ml"),
)
# Breakfasts, and what the other meals are made of, by words of the dish.
BREAKFASTS = (("oat|porridge", "Oats: 300 g; Milk: 800 ml; Bananas: 2; Honey: 30 g"),)
BREAKFAST = "Eggs: 6; Bread: 6 slices; Tomatoes: 300 g; Olive oil: 20 ml"
PROTEINS = (
    ("lamb", "Lamb shoulder: 700 g"), ("salmon", "Salmon fillets: 600 g"), ("fish|cod", "White fish fillets: 700 g"), ("tuna", "Canned tuna: 3 tins"), ("beef", "Beef mince: 500 g"), ("chicken", "Chicken thighs: 800 g"),
    ("lentil", "Red lentils: 350 g"), ("bean", "Black beans: 800 g"),
)
PROTEIN = "Chickpeas: 800 g"
CARBS = (("pasta|spaghetti|noodle", "Pasta: 500 g"), ("couscous|tagine", "Couscous: 300 g"), ("bread|toast|wrap|gyros", "Wholegrain bread: 1 loaf"))
CARB = "Rice: 400 g"
BESIDE = "Tomatoes: 500 g; Onions: 2; Garlic: 3 cloves; Olive oil: 30 ml; Mixed spices: 10 g"
# Words of slow and of demanding dishes.
SLOW, DEMANDING = "tagine|stew|roast|traybake", "tagine|risotto|ramen"
# Allergens by words of the ingredients, in order.
ALLERGENS = (
    ("egg|eggs", "Egg"), ("milk|cheese|mozzarella|feta|yogurt|butter|parmesan", "Milk"), ("bread|toast|pasta|flour|couscous|pita|noodle|wrap|tortilla", "Gluten"), ("salmon|tuna|cod|fish|prawn|shrimp", "Fish/Shellfish"),
    ("soy|tofu|miso", "Soy"), ("nut|almond|walnut|peanut", "Nuts"),
)
# Nutrition of a breakfast and of another meal.
NUTRITION = {"calories": (380, 560), "protein": (18, 30), "carbs": (42, 58), "fat": (16, 22)}

DISH_RULES = [
    *[("known", p, v) for p, v in KNOWN_DISHES], *[("breakfast", p, v) for p, v in BREAKFASTS], *[("protein", p, v) for p, v in PROTEINS], *[("carb", p, v) for p, v in CARBS], ("slow", SLOW, "slow"), ("demanding", DEMANDING, "demanding"),
]
ALLERGEN_RULES = [("allergen", p, v) for p, v in ALLERGENS]


def rule_recipes(dishes: DataFrame) -> DataFrame:
    """id, title, servings, prep, cook, difficulty, ingredients, nutrition, allergens for distinct (dish, meal, servings).

    Blanks in a title become one, an empty one is 'Recipe'; a missing meal is a dinner, servings are four where they
    are missing and one at least. Every distinct title, and every distinct ingredient name, is read once for all rules.
    """
    title = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce("dish", F.lit("")), r"^\s+|\s+$", "")), r"\s+", " ")
    asked = dishes.select(F.when(title == "", "Recipe").otherwise(title).alias("title"), F.coalesce("meal", F.lit("dinner")).alias("meal"), F.greatest(F.coalesce("servings", F.lit(4)), F.lit(1)).alias("servings")).distinct()
    fits = rules.first_fits(asked, DISH_RULES, "title").withColumnRenamed("text", "title")
    of = lambda book, other=None: F.coalesce(F.try_element_at("fits", F.lit(book)), F.lit(other))
    breakfast = F.col("meal") == "breakfast"
    made = F.when(breakfast, of("breakfast", BREAKFAST)).otherwise(F.concat_ws("; ", of("protein", PROTEIN), of("carb", CARB), F.lit(BESIDE)))
    full = asked.join(fits, "title", "left").withColumn("list", F.coalesce(of("known"), made))

    lists = full.select("list").distinct().withColumn("name", F.explode(F.transform(F.split("list", "; "), lambda r: F.split_part(r, F.lit(": "), F.lit(1)))))
    held = lists.join(rules.all_fits(lists, ALLERGEN_RULES, "name").withColumnRenamed("text", "name"), "name").select("list", "place", "value").distinct()
    allergens = held.groupBy("list").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda a: a["value"]).alias("allergens"))
    row = lambda r: F.struct(F.split_part(r, F.lit(": "), F.lit(1)).alias("name"), F.split_part(r, F.lit(": "), F.lit(2)).alias("quantity"))
    return full.join(allergens, "list", "left").select(
        F.concat(F.lit("deterministic-"), F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-")).alias("id"), "title", "meal", "servings",
        F.when(breakfast, 10).otherwise(15).alias("prep"), F.when(of("slow").isNotNull(), 45).when(breakfast, 10).otherwise(25).alias("cook"), F.when(of("demanding").isNotNull(), "medium").otherwise("easy").alias("difficulty"),
        F.transform(F.split("list", "; "), row).alias("ingredients"), F.struct(*[F.when(breakfast, a).otherwise(b).alias(name) for name, (a, b) in NUTRITION.items()]).alias("nutrition"),
        F.coalesce("allergens", F.array().cast("array<string>")).alias("allergens"),
    )


_FIRST = ("Lamb", "Slow  Roast", "Egg", "scrambled", "Avocado", "Salmon", "Cod", "Beef", "Bean", "Oat", "Tuna", "Plain", "toast of")
_LAST = ("tagine", "toast", "yogurt parfait", "traybake", "noodles", "eggs", "risotto", "Pizza", "stew", "")


def f13_rule_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe by rules for every dish named after parts."""
    k = F.col("p_partkey")
    dish = F.concat_ws(" ", pick(_FIRST, k), "p_name", pick(_LAST, F.floor(k / 13)))
    dishes = table(spark, sf_dir, "part").select(dish.alias("dish"), pick(("breakfast", "lunch", "dinner", "snack"), F.floor(k / 3)).alias("meal"), F.when(k % 5 > 0, (k % 7).cast("int")).alias("servings"))
    rows = rule_recipes(dishes)
    shown = F.array_join(F.transform("ingredients", lambda r: F.concat(r["name"], F.lit(" "), r["quantity"])), ", ")
    return rows.select("id", "title", "meal", "servings", "prep", "cook", "difficulty", shown.alias("shown"), F.col("nutrition.calories").alias("calories"), F.array_join("allergens", ",").alias("allergens"))


def _listed(text: str) -> str:
    return text.replace(": ", " ").replace("; ", ", ")


def _case(rows: tuple[tuple[str, str], ...], other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(n, '{p}') THEN '{_listed(v)}'" for p, v in rows) + f" ELSE {other} END"


_SQL_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
F13_SQL = f"""WITH p AS (SELECT DISTINCT regexp_replace(trim({_SQL_LIST(_FIRST)}[p_partkey % 13 + 1] || ' ' || p_name || ' ' || {_SQL_LIST(_LAST)}[(p_partkey // 13) % 10 + 1]), '\\s+', ' ', 'g') AS title,
  ['breakfast', 'lunch', 'dinner', 'snack'][(p_partkey // 3) % 4 + 1] AS meal, CASE WHEN p_partkey % 5 > 0 THEN greatest(p_partkey % 7, 1) ELSE 4 END::INT AS servings FROM part),
t AS (SELECT *, lower(title) AS n, meal = 'breakfast' AS b FROM p),
i AS (SELECT *, {_case(KNOWN_DISHES, f"CASE WHEN b THEN {_case(BREAKFASTS, repr(_listed(BREAKFAST)))} ELSE {_case(PROTEINS, repr(_listed(PROTEIN)))} || ', ' || {_case(CARBS, repr(_listed(CARB)))} || ', {_listed(BESIDE)}' END")} AS shown FROM t)
SELECT 'deterministic-' || regexp_replace(n, '[^a-z0-9]+', '-', 'g') AS id, title, meal, servings, CASE WHEN b THEN 10 ELSE 15 END AS prep, CASE WHEN regexp_matches(n, '{SLOW}') THEN 45 WHEN b THEN 10 ELSE 25 END AS cook,
  CASE WHEN regexp_matches(n, '{DEMANDING}') THEN 'medium' ELSE 'easy' END AS difficulty, shown, CASE WHEN b THEN 380 ELSE 560 END AS calories,
  array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(lower(shown), '{p}') THEN '{v}' END" for p, v in ALLERGENS)}], lambda x: x IS NOT NULL), ',') AS allergens FROM i"""


def plan_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, document: orders as saved plans in JSON; some are no JSON, and some break the contract in one or more fields."""
    k = F.col("o_orderkey")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    meal = text('{"day":"Mon","breakfast":"', F.col("o_orderpriority"), '","lunch":', F.when(k % 5 == 0, "7").otherwise('"soup"'), ',"dinner":"stew"}')
    item = text('{"name":"rice","quantity":"1 kg","estimatedCost":', F.when(k % 3 == 0, "-1.5").otherwise("0"), F.when(k % 4 == 0, "}").otherwise(',"category":"Grains"}'))
    status = F.concat(F.lit('"'), pick(("comfortable", "optimized", "critical", "too_low", "unheard"), k), F.lit('"'))
    whole = text(
        '{"budgetAnalysis":"ok","estimatedCost":', F.col("o_totalprice").cast("string"), ',"safetyMargin":5,"status":', status, ',"recommendedBudget":', F.when(k % 6 == 0, "null").otherwise("120.5"),
        F.when(k % 8 == 0, "").otherwise(',"minimumBudget":80'), ',"mealPlan":', F.when(k % 9 == 0, '{"day":1}').otherwise(text("[", meal, ",", meal, "]")), ',"groceryList":[', item, '],"savingTips":', F.when(k % 10 == 0, '["a",2]').otherwise("[]"), ',"more":true}',
    )
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderkey")
    return orders.select(k.alias("id"), F.when(k % 11 == 0, F.left(whole, F.lit(40))).when(k % 13 == 0, F.lit("[1, 2]")).otherwise(whole).alias("document"))


def p16_plan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved plans that keep the contract, with what they hold, and each fault of the others with its path and reason."""
    good, broken = documents.checked(plan_texts(spark, sf_dir), documents.PLAN, documents.PLAN_TYPE)
    none = lambda kind: F.lit(None).cast(kind)
    kept = good.select("id", none("string").alias("path"), none("string").alias("reason"), F.col("record.status").alias("status"), F.size("record.mealPlan").alias("meals"), F.round("record.estimatedCost", 2).alias("cost"))
    return kept.unionByName(broken.select("id", "path", "reason", none("string").alias("status"), none("int").alias("meals"), none("double").alias("cost")))


P16_DOCUMENTS_SQL = """WITH o AS (SELECT o_orderkey AS id, o_orderkey AS k, o_totalprice FROM orders),
f AS (SELECT id, '$' AS path, 'no JSON' AS reason FROM o WHERE k % 11 = 0
  UNION ALL SELECT id, '$', 'expected object' FROM o WHERE k % 11 > 0 AND k % 13 = 0
  UNION ALL SELECT id, unnest(list_filter([CASE WHEN k % 5 = 4 THEN '$.status' END, CASE WHEN k % 8 = 0 THEN '$.minimumBudget' END, CASE WHEN k % 9 = 0 THEN '$.mealPlan' END, CASE WHEN k % 9 > 0 AND k % 5 = 0 THEN '$.mealPlan[0].lunch' END,
    CASE WHEN k % 9 > 0 AND k % 5 = 0 THEN '$.mealPlan[1].lunch' END, CASE WHEN k % 3 = 0 THEN '$.groceryList[0].estimatedCost' END, CASE WHEN k % 4 = 0 THEN '$.groceryList[0].category' END, CASE WHEN k % 10 = 0 THEN '$.savingTips[1]' END], lambda x: x IS NOT NULL)) AS path,
    CASE path WHEN '$.status' THEN 'not one of comfortable, optimized, critical, too_low' WHEN '$.minimumBudget' THEN 'missing' WHEN '$.mealPlan' THEN 'expected array' WHEN '$.groceryList[0].estimatedCost' THEN 'below 0' WHEN '$.groceryList[0].category' THEN 'missing' ELSE 'expected string' END FROM o WHERE k % 11 > 0 AND k % 13 > 0)
SELECT id, path, reason, NULL AS status, NULL::INT AS meals, NULL::DOUBLE AS cost FROM f
UNION ALL SELECT id, NULL, NULL, ['comfortable', 'optimized', 'critical', 'too_low'][k % 5 + 1], 2, round(o_totalprice, 2) FROM o WHERE id NOT IN (SELECT id FROM f)"""

QUERIES = {
    "f13_rule_recipes": (f13_rule_recipes, F13_SQL),
    "p16_plan_documents": (p16_plan_documents, P16_DOCUMENTS_SQL),
}
