"""Queries over whole weeks, waterfalls with all their tiers, contracts, links and money as shown, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import food, records
from larder.functions.measure import draw, lcg_states
from larder.functions.quantity import lookup, read_template, scale_template
from larder.functions.text import encode_component
from larder.plans.carriers import table
from larder.plans.kitchen import LIST_SQL, MERGED_CTE, grocery, pick
from larder.plans.planning import without_dislikes
from larder.sources.scratch import kept, spread
from larder.streaming.recency import cache_hits

# A week's pools and shopping template of the demonstration.
POOLS = {"breakfast": ("Oats and fruit", "Toast with egg", "Yogurt bowl"), "lunch": ("Lentil soup", "Tuna salad", "Pasta salad", "Rice bowl"), "dinner": ("Chicken rice", "Bean chili", "Fish stew", "Pasta bake", "Egg curry")}
ZERO_DAY = {"breakfast": "Pantry oats & fruit", "lunch": "Leftovers reheated", "dinner": "Zero Spend Day — leftovers & pantry staples"}
TEMPLATE = (
    ("Chicken breast", "1 kg"), ("Tuna", "3 cans"), ("Eggs", "12"), ("Lentils", "500 g"), ("Tomatoes", "1.5 kg"), ("Onions", "6"), ("Spinach", "300 g"), ("Carrots", "800 g"), ("Potatoes", "2 kg"), ("Rice", "1 kg"),
    ("Pasta", "500 g"), ("Bread", "2 loaves"), ("Oats", "750 g"), ("Olive oil", "500 ml"), ("Butter", "250 g"), ("Yogurt", "4"), ("Feta", "200 g"), ("Almonds", "150 g"),
)
DAYS = 7


def week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, template (what diets leave of it), drops, zero (index of the day without spending, or -1), states, first (the first state of the meals).

    The few columns of customers are dealt out before the states are drawn, as their files may be one task's; the template is read once for each set of diets.
    """
    k = F.col("c_custkey")
    diets = F.when(k % 3 == 0, F.array(F.lit("Vegan"))).when(k % 3 == 1, F.array(F.lit("Gluten Free"))).otherwise(F.array().cast("array<string>"))
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(q).alias("quantity"), read_template(F.lit(q)).alias("read")) for n, q in TEMPLATE])
    who = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(k.alias("id"), diets.alias("diets"), lcg_states(k, 3 * DAYS + 3).alias("states"), (k % 4 == 0).alias("zero_day"))
    left = kept(table(spark, sf_dir, "customer").select(diets.alias("diets")).distinct()).select("diets", F.filter(rows, lambda r: food.fits_diets(r["name"], F.col("diets"))).alias("template"))
    of = who.join(kept(left), "diets").select("id", "template", "states", "zero_day")
    of = of.withColumn("drops", F.least(F.lit(2), F.floor(F.size("template") * 0.12)).cast("int"))
    zero = F.when(F.col("zero_day"), 3 + F.floor(draw(F.element_at("states", F.col("drops") + 1)) * 2)).otherwise(-1)
    return of.withColumn("zero", zero.cast("int")).withColumn("first", F.col("drops") + F.when(F.col("zero_day"), 1).otherwise(0))


def c7_week_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakfast, lunch and dinner of seven days, drawn in turn from the pools without disliked dishes; a day without spending draws nothing."""
    dislikes = F.array(pick(("egg", "rice", "none"), F.col("id")))
    pools = {meal: without_dislikes(F.array(*[F.lit(d) for d in dishes]), F.col("dislikes")) for meal, dishes in POOLS.items()}
    left = kept(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).select(dislikes.alias("dislikes")).distinct()).withColumns(pools)
    own = week(spark, sf_dir).withColumn("dislikes", dislikes).join(kept(left), "dislikes").drop("dislikes", "template")
    days = own.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(DAYS - 1))))
    turn = F.col("day") - F.when((F.col("zero") >= 0) & (F.col("day") > F.col("zero")), 1).otherwise(0)

    def meal(name: str, place: int) -> Column:
        state = F.element_at("states", (F.col("first") + 3 * turn + place + 1).cast("int"))
        at = (F.floor(draw(state) * F.size(name)) + F.col("day") + place) % F.size(name) + 1
        return F.when(F.col("day") == F.col("zero"), ZERO_DAY[name]).otherwise(F.element_at(name, at.cast("int")))

    return days.select("id", "day", *[meal(name, place).alias(f"{name}_") for place, name in enumerate(POOLS)]).toDF("id", "day", *POOLS)


def c7_week_groceries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The template's rows that diets and seeded drops leave, scaled by household and period."""
    own = week(spark, sf_dir)
    dropped = F.transform(F.slice("states", F.lit(1), F.col("drops")), lambda s: F.floor(draw(s) * F.size("template")))
    by = F.least(F.lit(1.8), F.greatest(F.lit(0.7), (F.col("id") % 6 + 1) / 4)) * F.when(F.col("id") % 2 == 0, 30.0 / 7).otherwise(1.0)
    rows = own.select("id", dropped.alias("dropped"), F.posexplode_outer("template").alias("pos", "r")).where("pos is not null").where(~F.array_contains("dropped", F.col("pos").cast("long")))
    return rows.select("id", "pos", "r.name", scale_template(F.col("r.quantity"), by, F.col("r.read")).alias("quantity"))


_TEMPLATE_SQL = """template(pos, name, n, unit) AS (VALUES (0, 'Chicken breast', 1.0, 'kg'), (1, 'Tuna', 3, 'cans'), (2, 'Eggs', 12, ''), (3, 'Lentils', 500, 'g'), (4, 'Tomatoes', 1.5, 'kg'), (5, 'Onions', 6, ''), (6, 'Spinach', 300, 'g'), (7, 'Carrots', 800, 'g'),
  (8, 'Potatoes', 2, 'kg'), (9, 'Rice', 1, 'kg'), (10, 'Pasta', 500, 'g'), (11, 'Bread', 2, 'loaves'), (12, 'Oats', 750, 'g'), (13, 'Olive oil', 500, 'ml'), (14, 'Butter', 250, 'g'), (15, 'Yogurt', 4, ''), (16, 'Feta', 200, 'g'), (17, 'Almonds', 150, 'g'))"""
WEEK_CTE = f"""WITH RECURSIVE s(id, k, state) AS (SELECT c_custkey, 0, (greatest((c_custkey * 2654435761) % 4294967296, 1) * 1664525 + 1013904223) % 4294967296 FROM customer UNION ALL SELECT id, k + 1, (state * 1664525 + 1013904223) % 4294967296 FROM s WHERE k < 23),
{_TEMPLATE_SQL},
kept AS (SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_custkey ORDER BY pos) - 1 AS pos, name, n::DOUBLE AS n, unit, count(*) OVER (PARTITION BY c_custkey) AS size FROM customer, template
  WHERE NOT (c_custkey % 3 = 0 AND regexp_matches(lower(name), 'chicken|salmon|tuna|beef|feta|yogurt|butter|egg|parmesan')) AND NOT (c_custkey % 3 = 1 AND regexp_matches(lower(name), 'bread|pasta|flour|sourdough'))),
w AS (SELECT DISTINCT id, size, least(2, floor(size * 0.12::DOUBLE))::INT AS drops, id % 4 = 0 AS zero_day FROM kept),
z AS (SELECT w.*, CASE WHEN zero_day THEN 3 + floor(state / 4294967295.0::DOUBLE * 2)::INT ELSE -1 END AS zero FROM w JOIN s ON s.id = w.id AND k = drops)"""
C7_PLAN_SQL = f"""{WEEK_CTE},
p AS (SELECT id, drops + CASE WHEN zero_day THEN 1 ELSE 0 END AS first, zero, day, day - CASE WHEN zero >= 0 AND day > zero THEN 1 ELSE 0 END AS turn,
  CASE id % 3 WHEN 0 THEN ['Oats and fruit', 'Yogurt bowl'] ELSE ['Oats and fruit', 'Toast with egg', 'Yogurt bowl'] END AS b, CASE id % 3 WHEN 1 THEN ['Lentil soup', 'Tuna salad', 'Pasta salad'] ELSE ['Lentil soup', 'Tuna salad', 'Pasta salad', 'Rice bowl'] END AS l,
  CASE id % 3 WHEN 0 THEN ['Chicken rice', 'Bean chili', 'Fish stew', 'Pasta bake'] WHEN 1 THEN ['Bean chili', 'Fish stew', 'Pasta bake', 'Egg curry'] ELSE ['Chicken rice', 'Bean chili', 'Fish stew', 'Pasta bake', 'Egg curry'] END AS d FROM z, range(7) t(day)),
q AS (SELECT p.*, s.k - p.first - 3 * turn AS place, state / 4294967295.0::DOUBLE AS u FROM p JOIN s ON s.id = p.id AND s.k BETWEEN p.first + 3 * turn AND p.first + 3 * turn + 2)
SELECT id, day::INT AS day, max(CASE WHEN day = zero THEN 'Pantry oats & fruit' ELSE b[(floor(u * len(b))::INT + day) % len(b) + 1] END) FILTER (place = 0) AS breakfast,
  max(CASE WHEN day = zero THEN 'Leftovers reheated' ELSE l[(floor(u * len(l))::INT + day + 1) % len(l) + 1] END) FILTER (place = 1) AS lunch,
  max(CASE WHEN day = zero THEN 'Zero Spend Day — leftovers & pantry staples' ELSE d[(floor(u * len(d))::INT + day + 2) % len(d) + 1] END) FILTER (place = 2) AS dinner FROM q GROUP BY id, day"""
C7_GROCERIES_SQL = f"""{WEEK_CTE},
v AS (SELECT kept.*, n * (least(1.8::DOUBLE, greatest(0.7::DOUBLE, (id % 6 + 1) / 4)) * CASE WHEN id % 2 = 0 THEN 30.0::DOUBLE / 7 ELSE 1.0::DOUBLE END) AS x FROM kept
  WHERE NOT EXISTS (SELECT 1 FROM s JOIN w ON w.id = s.id WHERE s.id = kept.id AND s.k < drops AND floor(state / 4294967295.0::DOUBLE * w.size) = kept.pos))
SELECT id, pos::INT AS pos, name, trim(regexp_replace(CASE WHEN unit IN ('', 'cans', 'loaves') THEN greatest(1.0, floor(x + 0.5)) WHEN unit IN ('g', 'ml') THEN greatest(50.0, floor(x / 50 + 0.5) * 50)
  WHEN x >= 2 THEN floor(x * 2 + 0.5) / 2 ELSE greatest(0.1, floor(x * 10 + 0.5) / 10) END::DECIMAL(20,1)::VARCHAR, '\\.0$', '') || ' ' || unit) AS quantity FROM v"""

# Recipes of the demonstration's dinners.
DINNERS = (
    ("Chicken rice", "Chicken breast", "250 g"), ("Chicken rice", "Rice", "0,5 l"), ("Chicken rice", "Garlic", "3 cloves"), ("Bean chili", "Canned tomatoes", "2 cans"), ("Bean chili", "Onions", "4"), ("Bean chili", "Salt", "to taste"),
    ("Fish stew", "Tomatoes", "1.5 kg"), ("Fish stew", "Garlic", "250 g"), ("Fish stew", "Fresh basil", "a handful"), ("Pasta bake", "Spaghetti", "250 g"), ("Pasta bake", "basil (chopped)", "2 tbsp"), ("Pasta bake", "Feta cheese", "250 g"),
    ("Egg curry", "Eggs", "4"), ("Egg curry", "Rice", "250 g"), ("Egg curry", "Onions", "4"),
)


def c9_week_shopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The week's dinners, days without spending left out, by their recipes to one shopping list, scaled by household and period."""
    recipes = spark.createDataFrame([(dish, k, name, text) for k, (dish, name, text) in enumerate(DINNERS)], "dinner string, pos int, name string, text string")
    dinners = c7_week_plan(spark, sf_dir).where(food.spends(F.col("dinner"))).select(F.col("id").alias("basket"), "day", "dinner")
    rows = dinners.join(F.broadcast(recipes), "dinner").select("basket", "name", "text", F.struct("day", "pos").alias("ord"))
    by = (F.col("basket") % 6 + 1) / 4 * F.when(F.col("basket") % 2 == 0, 30.0 / 7).otherwise(1.0)
    return grocery(kept(rows), by).select("basket", "key", "name", "quantity", "category", "place")


_DINNERS_SQL = ", ".join(f"('{d}', {k}, '{n}', '{t}')" for k, (d, n, t) in enumerate(DINNERS))
C9_WEEK_SQL = f"""{C7_PLAN_SQL.replace(")\nSELECT id, day::INT", "),\nplan AS (SELECT id, day::INT")}),
recipe(dinner, pos, name, text) AS (VALUES {_DINNERS_SQL}),
lines AS (SELECT id AS basket, name, text, row(day, pos) AS ord, greatest(0.25::DOUBLE, (id % 6 + 1) / 4 * CASE WHEN id % 2 = 0 THEN 30.0::DOUBLE / 7 ELSE 1.0::DOUBLE END) AS scale FROM plan JOIN recipe USING (dinner)), {MERGED_CTE.replace("kept AS", "bought AS").replace("FROM kept", "FROM bought")} {LIST_SQL}"""

# ---- waterfalls ----


def c8_recipe_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dish from the cache, the local recipes, the web's answers, the model's answers, else the rules; an answer that isn't complete doesn't count."""
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slot"), (F.col("o_orderkey") * 7 % 500).alias("dish"))
    tiers = (("cache", key % 5 == 0, 4, 3), ("local", key % 3 == 0, 4, 3), ("web", key % 2 == 0, 3, 3), ("ai", key % 7 < 4, 4, 3))
    met = wanted
    for tier, answered, ingredients, steps in tiers:
        answer = part.where(answered).select(key.alias("dish"), (key % 6 + 1).alias("n_ingredients"), (F.col("p_size") % 5 + 1).alias("n_steps"), (key % 11).alias("calories"))
        enough = (F.col("n_ingredients") >= ingredients) & (F.col("n_steps") >= steps) & (F.lit(tier == "web") | (F.col("calories") > 0))
        met = met.join(answer.where(enough).select("dish", F.col("n_ingredients").alias(f"of_{tier}")), "dish", "left")
    origin = F.coalesce(*[F.when(F.col(f"of_{t}").isNotNull(), t) for t, *_ in tiers], F.lit("rules"))
    return met.select("slot", "dish", origin.alias("origin"), F.coalesce(*[f"of_{t}" for t, *_ in tiers], F.lit(2)).cast("long").alias("ingredients"))


C8_TIERS_SQL = """WITH p AS (SELECT p_partkey AS k, p_partkey % 6 + 1 AS i, p_size % 5 + 1 AS s, p_partkey % 11 AS c FROM part), o AS (SELECT o_orderkey AS slot, o_orderkey * 7 % 500 AS dish FROM orders),
r AS (SELECT slot, dish, i, CASE WHEN k IS NULL THEN 'rules' WHEN k % 5 = 0 AND i >= 4 AND s >= 3 AND c > 0 THEN 'cache' WHEN k % 3 = 0 AND i >= 4 AND s >= 3 AND c > 0 THEN 'local' WHEN k % 2 = 0 AND i >= 3 AND s >= 3 THEN 'web'
  WHEN k % 7 < 4 AND i >= 4 AND s >= 3 AND c > 0 THEN 'ai' ELSE 'rules' END AS origin FROM o LEFT JOIN p ON k = dish)
SELECT slot, dish, origin, CASE WHEN origin = 'rules' THEN 2 ELSE i END AS ingredients FROM r"""


def c10_product_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's product: the cheapest plausible real offer (.9), the market's own chain (.4), the marketplace (.45), the estimate (.55), else a search (.3); kinds as in A7."""
    k, price = F.col("l_partkey"), F.col("l_extendedprice") / 1000
    real = (F.col("l_returnflag") == "A") & (price > 0.2) & (price < 60) & (k % 4 == 0)
    best = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min(F.when(real, F.struct(price.alias("price"), "l_orderkey", "l_suppkey"))).alias("b"))
    tier = F.when(F.col("b").isNotNull(), "google-shopping").when(k % 5 == 1, "retailer").when(k % 5 == 2, "amazon").when(k % 5 == 3, "estimate").otherwise("search")
    told = best.withColumn("source", tier)
    confidence = F.coalesce(*[F.when(F.col("source") == s, c) for s, c in (("google-shopping", 0.9), ("retailer", 0.4), ("amazon", 0.45), ("estimate", 0.55), ("search", 0.3))])
    kind = F.when(F.col("source") == "google-shopping", "real").when(F.col("source") == "estimate", "estimated").otherwise("fallback-search")
    return told.select("l_partkey", "source", kind.alias("kind"), confidence.alias("confidence"), F.when(F.col("source") == "estimate", 2.5).otherwise(F.col("b.price")).alias("price"))


C10_TIERS_SQL = """WITH b AS (SELECT l_partkey, min(l_extendedprice / 1000) FILTER (l_returnflag = 'A' AND l_extendedprice / 1000 > 0.2 AND l_extendedprice / 1000 < 60 AND l_partkey % 4 = 0) AS p FROM lineitem GROUP BY 1),
t AS (SELECT *, CASE WHEN p IS NOT NULL THEN 'google-shopping' WHEN l_partkey % 5 = 1 THEN 'retailer' WHEN l_partkey % 5 = 2 THEN 'amazon' WHEN l_partkey % 5 = 3 THEN 'estimate' ELSE 'search' END AS source FROM b)
SELECT l_partkey, source, CASE source WHEN 'google-shopping' THEN 'real' WHEN 'estimate' THEN 'estimated' ELSE 'fallback-search' END AS kind,
  CASE source WHEN 'google-shopping' THEN 0.9::DOUBLE WHEN 'retailer' THEN 0.4::DOUBLE WHEN 'amazon' THEN 0.45::DOUBLE WHEN 'estimate' THEN 0.55::DOUBLE ELSE 0.3::DOUBLE END AS confidence, CASE WHEN source = 'estimate' THEN 2.5::DOUBLE ELSE p END AS price FROM t"""


def c14_chef_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rewrite of six fields, each only where it says something; ingredients and servings stay the recipe's own; without a rewrite the recipe stays (C14, T4)."""
    key = F.col("p_partkey")
    base = table(spark, sf_dir, "part").select(key.alias("recipe"), F.col("p_name").alias("title"), F.col("p_brand").alias("description"), F.array_repeat(F.lit("own"), (key % 4).cast("int")).alias("steps"), (key % 60).alias("prep"), F.col("p_size").alias("cook"), F.lit("easy").alias("difficulty"), F.col("p_type").alias("ingredients"))
    said = table(spark, sf_dir, "part").where("p_partkey % 3 > 0").select(
        key.alias("recipe"), F.when(key % 2 == 0, F.upper("p_name")).otherwise("").alias("c_title"), F.when(key % 5 > 0, "told").alias("c_description"), F.array_repeat(F.lit("new"), (key % 6).cast("int")).alias("c_steps"),
        (key % 7).alias("c_prep"), (key % 2).cast("int").alias("c_cook"), F.when(key % 4 > 0, "hard").alias("c_difficulty"), F.lit("changed").alias("c_ingredients"),
    )
    met = base.join(said, "recipe", "left")
    own = lambda c: F.coalesce(F.nullif(F.col(f"c_{c}"), F.lit("")), F.col(c)).alias(c)
    number = lambda c: F.coalesce(F.nullif(F.col(f"c_{c}"), F.lit(0)), F.col(c)).alias(c)
    steps = F.when(F.size("c_steps") >= 3, F.col("c_steps")).otherwise(F.col("steps"))
    return met.select("recipe", own("title"), own("description"), F.array_join(steps, " ").alias("steps"), number("prep"), number("cook"), own("difficulty"), "ingredients", F.col("c_title").isNotNull().alias("enhanced"))


C14_REWRITE_SQL = """SELECT p_partkey AS recipe, CASE WHEN e AND p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS title, CASE WHEN e AND p_partkey % 5 > 0 THEN 'told' ELSE p_brand END AS description,
  CASE WHEN e AND p_partkey % 6 >= 3 THEN trim(repeat('new ', (p_partkey % 6)::INT)) ELSE trim(repeat('own ', (p_partkey % 4)::INT)) END AS steps, CASE WHEN e AND p_partkey % 7 > 0 THEN p_partkey % 7 ELSE p_partkey % 60 END AS prep,
  CASE WHEN e AND p_partkey % 2 > 0 THEN 1 ELSE p_size END AS cook, CASE WHEN e AND p_partkey % 4 > 0 THEN 'hard' ELSE 'easy' END AS difficulty, p_type AS ingredients, e AS enhanced FROM (SELECT *, p_partkey % 3 > 0 AS e FROM part)"""

# ---- contracts, defaults, links, money ----


def p16_valid_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles as JSON over their defaults, with the fields that break the contract; a record of another version counts as none."""
    k = F.col("c_custkey")
    said = F.create_map(
        F.lit("v"), F.when(k % 7 > 0, "2").otherwise("1"), F.lit("city"), F.when(k % 5 > 0, F.col("c_mktsegment")).otherwise(""), F.lit("household"), F.when(k % 3 > 0, (k % 6).cast("string")),
        F.lit("budget"), F.round("c_acctbal").cast("int").cast("string"), F.lit("currency"), pick(("EUR", "USD", "XXX"), k), F.lit("frequency"), F.when(k % 4 > 0, pick(("weekly", "monthly", "yearly"), k + 1)),
    )
    text = table(spark, sf_dir, "customer").select("c_custkey", F.to_json(said).alias("record"))
    p = F.from_json("record", "v string, city string, household string, budget string, currency string, frequency string")
    own = text.select("c_custkey", F.when(p["v"] == "2", p).alias("p"))
    full = own.select("c_custkey", F.col("p").isNotNull().alias("read"), *[F.coalesce(F.col(f"p.{c}"), F.lit(d)).alias(c) for c, d in (("city", ""), ("household", ""), ("budget", ""), ("currency", "EUR"), ("frequency", "weekly"))])
    wrong = {"city": F.col("city") == "", "household": F.col("household") == "", "budget": ~F.coalesce(F.col("budget").try_cast("double") > 0, F.lit(False)), "currency": ~F.col("currency").isin("EUR", "GBP", "USD"), "frequency": ~F.col("frequency").isin("weekly", "monthly")}
    broken = F.array_compact(F.array(*[F.when(w, name) for name, w in wrong.items()]))
    return full.select("c_custkey", "read", "currency", "frequency", F.array_join(broken, " ").alias("broken"), (F.size(broken) == 0).alias("valid"))


P16_SQL = """WITH a AS (SELECT c_custkey AS k, c_custkey % 7 > 0 AS read, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment ELSE '' END AS city, CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 6)::VARCHAR ELSE '' END AS household, round(c_acctbal) AS budget,
  ['EUR', 'USD', 'XXX'][c_custkey % 3 + 1] AS currency, CASE WHEN c_custkey % 4 > 0 THEN ['weekly', 'monthly', 'yearly'][(c_custkey + 1) % 3 + 1] ELSE 'weekly' END AS frequency FROM customer),
b AS (SELECT k, read, CASE WHEN read THEN currency ELSE 'EUR' END AS currency, CASE WHEN read THEN frequency ELSE 'weekly' END AS frequency,
  list_filter([CASE WHEN NOT read OR city = '' THEN 'city' END, CASE WHEN NOT read OR household = '' THEN 'household' END, CASE WHEN NOT read OR NOT budget > 0 THEN 'budget' END, CASE WHEN read AND currency = 'XXX' THEN 'currency' END, CASE WHEN read AND frequency = 'yearly' THEN 'frequency' END], lambda x: x IS NOT NULL) AS broken FROM a)
SELECT k AS c_custkey, read, currency, frequency, array_to_string(broken, ' ') AS broken, len(broken) = 0 AS valid FROM b"""

# Hosts of the marketplace by country of the demonstration, and its search parameters.
HOSTS = {"IT": "amazon.it", "GB": "amazon.co.uk", "DE": "amazon.de", "US": "amazon.com"}
LANGUAGE = {"IT": "it", "GB": "en", "DE": "de", "US": "en", "CH": "de"}


def f65_shop_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search links of a part in a country: the marketplace's host, else the general one; the shopping search with country and language, else without."""
    code = pick(("IT", "GB", "DE", "US", "CH", "??"), F.col("p_partkey"))
    q = encode_component(F.trim(F.concat(F.lit(" "), F.col("p_name"), F.lit(" & "), F.col("p_brand"))))
    market = F.concat(F.lit("https://www."), F.coalesce(lookup(HOSTS, code), F.lit("amazon.com")), F.lit("/s?k="), q)
    language = lookup(LANGUAGE, code)
    search = F.concat(F.lit("https://www.google.com/search?tbm=shop&q="), q, F.coalesce(F.concat(F.lit("&gl="), F.lower(code), F.lit("&hl="), language), F.lit("")))
    return table(spark, sf_dir, "part").select("p_partkey", market.alias("market"), search.alias("search"))


F65_LINKS_SQL = """WITH a AS (SELECT p_partkey, ['IT', 'GB', 'DE', 'US', 'CH', '??'][p_partkey % 6 + 1] AS code, replace(replace(replace(p_name || ' & ' || p_brand, '#', '%23'), '&', '%26'), ' ', '%20') AS q FROM part)
SELECT p_partkey, 'https://www.' || CASE code WHEN 'IT' THEN 'amazon.it' WHEN 'GB' THEN 'amazon.co.uk' WHEN 'DE' THEN 'amazon.de' ELSE 'amazon.com' END || '/s?k=' || q AS market,
  'https://www.google.com/search?tbm=shop&q=' || q || CASE WHEN code = '??' THEN '' ELSE '&gl=' || lower(code) || '&hl=' || CASE code WHEN 'IT' THEN 'it' WHEN 'DE' THEN 'de' WHEN 'CH' THEN 'de' ELSE 'en' END END AS search FROM a"""


def f41_local_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as each language writes them; unknown currencies as their code before two decimals."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", records.local_money(F.col("o_totalprice"), pick(("EUR", "GBP", "USD", "QQQ"), k), pick(("en", "it", "fr"), k)).alias("shown"))


F41_SQL = """WITH a AS (SELECT o_orderkey, printf('%.2f', o_totalprice) AS plain, format('{:,.2f}', o_totalprice) AS en, ['€', '£', '$', 'QQQ'][o_orderkey % 4 + 1] AS sign, o_orderkey % 3 AS l FROM orders)
SELECT o_orderkey, CASE WHEN sign = 'QQQ' THEN 'QQQ ' || plain WHEN l = 0 THEN sign || en WHEN l = 1 THEN translate(en, ',.', '.,') || chr(160) || sign ELSE translate(en, ',.', chr(8239) || ',') || chr(160) || sign END AS shown FROM a"""


def t2_cache_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each view or click finds its user's last signup or purchase: in memory for ten minutes, in the session for an hour, or nowhere."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").isin("signup", "purchase").alias("put"))
    near, far = (cache_hits(events, seconds).withColumnRenamed("hit", name) for seconds, name in ((600, "memory"), (3600, "session")))
    level = F.when(F.col("memory"), "memory").when(F.col("session"), "session").otherwise("none")
    return near.join(far.drop("key"), "id").select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), level.alias("level"))


T2_SQL = """WITH e AS (SELECT user_id, event_id, ts, event_type IN ('signup', 'purchase') AS put FROM events),
s AS (SELECT *, epoch_us(ts) - epoch_us(max(CASE WHEN put THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS age FROM e)
SELECT user_id, event_id, CASE WHEN age <= 600000000 THEN 'memory' WHEN age <= 3600000000 THEN 'session' ELSE 'none' END AS level FROM s WHERE NOT put"""


QUERIES = {
    "c7_week_plan": (c7_week_plan, C7_PLAN_SQL),
    "c7_week_groceries": (c7_week_groceries, C7_GROCERIES_SQL),
    "c9_week_shopping": (c9_week_shopping, C9_WEEK_SQL),
    "c8_recipe_tiers": (c8_recipe_tiers, C8_TIERS_SQL),
    "c10_product_tiers": (c10_product_tiers, C10_TIERS_SQL),
    "c14_chef_rewrite": (c14_chef_rewrite, C14_REWRITE_SQL),
    "p16_valid_profiles": (p16_valid_profiles, P16_SQL),
    "f65_shop_links": (f65_shop_links, F65_LINKS_SQL),
    "f41_local_money": (f41_local_money, F41_SQL),
    "t2_cache_levels": (t2_cache_levels, T2_SQL),
}
