"""Queries over reports, recipe records, totals in a fixed order, areas and the telemetry sink, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import food, records
from larder.operators import baskets, names, ranking, reports
from larder.plans.carriers import chains, customers, table
from larder.plans.kitchen import CATEGORY_SQL, LINES_CTE, lines, pick
from larder.plans.tiers import C7_PLAN_SQL, C9_WEEK_SQL, c7_week_plan, c9_week_shopping
from larder.sources.scratch import fresh_path, kept
from larder.streaming.events import KINDS, start_sink


def a5_grocery_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each basket's subtotal by category in the list's fixed order; categories that the list doesn't know don't show (A5).

    Some lines bring a category of their own. Sums are cut before the shuffle, so a basket has at most seven rows to place.
    """
    of = kept(lines(spark, sf_dir).select("name").distinct()).withColumn("known", food.category(F.col("name")))
    own = F.element_at(F.create_map(*[F.lit(x) for x in (5, "Fruit", 6, "Pantry", 7, "Household", 3, "Other")]), F.col("ord.l_linenumber"))
    cost = F.sum(F.col("ord.l_extendedprice").cast("decimal(18,2)")).cast("double")
    totals = lines(spark, sf_dir).join(of, "name").groupBy("basket", F.coalesce(own, "known").alias("category")).agg(cost.alias("subtotal"), F.count("*").alias("items"))
    shown = totals.withColumn("at", food.list_place(F.col("category"))).where("at > 0")
    return ranking.placed(shown, ["basket"], [F.asc("at")]).drop("at")


A5_SQL = f"""WITH {LINES_CTE.replace("AS ord FROM", "AS ord, l_linenumber AS nr, l_extendedprice AS cost FROM")}, c AS (SELECT *, CASE nr WHEN 5 THEN 'Fruit' WHEN 6 THEN 'Pantry' WHEN 7 THEN 'Household' WHEN 3 THEN 'Other' ELSE {CATEGORY_SQL} END AS category FROM lines),
t AS (SELECT basket, category, sum(cost::DECIMAL(18,2))::DOUBLE AS subtotal, count(*) AS items FROM c WHERE category <> 'Household' GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY basket ORDER BY list_position(['Proteins', 'Vegetables', 'Carbohydrates', 'Healthy Fats', 'Fruit', 'Pantry', 'Other'], category))::INT AS place FROM t"""


def f79_recipe_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a recipe record, with defaults for what it lacks."""
    k = F.col("p_partkey")
    facts = F.when(k % 3 > 0, F.struct(F.col("p_size").alias("calories"), (k % 40).cast("int").alias("protein"), F.lit(50).alias("carbs"), F.lit(10).alias("fat")))
    allergens = F.when(k % 4 == 0, F.array(F.lit("Egg"), F.lit("Milk"))).when(k % 4 == 1, F.array().cast("array<string>"))
    query = F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.concat(F.lit(" Très  "), F.col("p_brand"), F.lit("! ")))
    made = records.recipe_record(k.cast("string"), F.col("p_name"), (k % 30).cast("int"), F.col("p_size"), F.when(k % 2 == 0, "hard"), facts, allergens, query)
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("r")).select("p_partkey", "r.id", "r.title", "r.image", "r.servings", "r.minutes", "r.difficulty", "r.source", "r.nutrition.calories", "r.nutrition.protein", "r.nutrition.carbs", "r.nutrition.fat", F.array_join("r.allergens", ", ").alias("allergens"))


F79_SQL = """WITH p AS (SELECT *, CASE WHEN p_partkey % 5 = 1 THEN ' Très  ' || p_brand || '! ' ELSE p_name END AS q FROM part)
SELECT p_partkey, 'local-' || p_partkey AS id, p_name AS title, 'https://source.unsplash.com/featured/800x600/?food,' || replace(regexp_replace(trim(regexp_replace(lower(q), '[^a-z0-9 ]', ' ', 'g')), ' +', ',', 'g'), ',', '%2C') AS image,
  4 AS servings, (p_partkey % 30 + p_size)::INT AS minutes, CASE WHEN p_partkey % 2 = 0 THEN 'hard' ELSE 'easy' END AS difficulty, 'themealdb' AS source, CASE WHEN p_partkey % 3 > 0 THEN p_size ELSE 480 END AS calories,
  CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 40 ELSE 22 END::INT AS protein, CASE WHEN p_partkey % 3 > 0 THEN 50 ELSE 55 END AS carbs, CASE WHEN p_partkey % 3 > 0 THEN 10 ELSE 16 END AS fat, CASE WHEN p_partkey % 4 = 0 THEN 'Egg, Milk' ELSE '' END AS allergens FROM p"""

DISHES = ("red widget of steel", "blue bolt", "large gear ring", "anvil")


def f81_area_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order's dish the best title of its own search, unless that is of another area than asked for; then the best title of the area's list.

    Titles meet the words of the asked dishes by `names.containing`, each distinct pair of dish and area is looked up once,
    and an area without any hit gives its first title.
    """
    o = F.col("l_orderkey")
    dish, area = pick(DISHES, o), F.when(o % 3 > 0, F.concat(F.lit("Brand#"), (o % 27).cast("string")))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_name").alias("title"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_brand")).alias("of"))
    words = F.filter(F.split(F.lower(F.col("dish")), r"\s+"), lambda w: F.length(w) > 2)
    score = F.size(F.filter(words, lambda w: F.contains(F.col("title"), w)))
    met = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", dish.alias("dish"), area.alias("area")).join(part, "l_partkey").withColumn("score", score)
    best = met.groupBy("l_orderkey", "dish", "area").agg(F.max_by(F.struct("l_partkey", "of"), F.struct("score", -F.col("l_linenumber"), -F.col("l_partkey"))).alias("b"))
    right = F.col("area").isNull() | F.col("b.of").isNull() | (F.col("b.of") == F.col("area"))
    searched = kept(best.select("l_orderkey", "dish", "area", F.when(right, F.col("b.l_partkey")).alias("own")))
    asked = kept(searched.where("own is null").select("dish", "area").distinct())
    wanted = asked.select("dish", "area", F.explode(words).alias("part"))
    holds = names.containing(part.select(F.col("title").alias("whole")), wanted.select("part")).withColumnRenamed("whole", "title")
    hits = wanted.join(holds, "part").join(part.where("of is not null"), (F.col("of") == F.col("area")) & (part["title"] == holds["title"]))
    scored = hits.groupBy("dish", "area", "l_partkey").agg(F.count("*").alias("n")).groupBy("dish", "area").agg(F.max(F.struct("n", -F.col("l_partkey"))).alias("m"))
    scored = scored.select("dish", "area", (-F.col("m.col2")).alias("hit"))
    opening = part.where("of is not null").groupBy(F.col("of").alias("area")).agg(F.min("l_partkey").alias("opening"))
    listed = asked.join(scored, ["dish", "area"], "left").join(opening, "area", "left").select("dish", "area", F.coalesce("hit", "opening").alias("listed"))
    way = F.when(F.col("own").isNotNull(), "search").when(F.col("listed").isNotNull(), "area")
    return searched.join(listed, ["dish", "area"], "left").select("l_orderkey", F.coalesce("own", "listed").alias("l_partkey"), way.alias("way"))


F81_SQL = """WITH p AS (SELECT p_partkey, lower(p_name) AS title, CASE WHEN p_partkey % 7 > 0 THEN p_brand END AS of_ FROM part),
s AS (SELECT l_orderkey, l_linenumber, p_partkey, title, of_, ['red widget of steel', 'blue bolt', 'large gear ring', 'anvil'][l_orderkey % 4 + 1] AS dish, CASE WHEN l_orderkey % 3 > 0 THEN 'Brand#' || l_orderkey % 27 END AS area FROM lineitem JOIN p ON p_partkey = l_partkey),
w AS (SELECT *, len(list_filter(string_split(dish, ' '), lambda x: length(x) > 2 AND contains(title, x))) AS score FROM s),
b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber, p_partkey) = 1),
a AS (SELECT dish, area, p.p_partkey AS listed FROM (SELECT DISTINCT dish, area FROM s WHERE area IS NOT NULL) d JOIN p ON p.of_ = d.area
  QUALIFY row_number() OVER (PARTITION BY dish, area ORDER BY len(list_filter(string_split(dish, ' '), lambda x: length(x) > 2 AND contains(title, x))) DESC, p.p_partkey) = 1)
SELECT l_orderkey, CASE WHEN coalesce(of_ = b.area, true) THEN p_partkey ELSE listed END AS l_partkey, CASE WHEN coalesce(of_ = b.area, true) THEN 'search' WHEN listed IS NOT NULL THEN 'area' END AS way FROM b LEFT JOIN a USING (dish, area)"""


def s16_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's weekly report: place, money, meals, shopping list and the stores of the country."""
    k = F.col("c_custkey")
    spend = F.when(F.col("c_acctbal") == 0, F.col("c_acctbal")).otherwise(F.floor("c_acctbal").cast("double"))  # a whole number has no -0.0
    who = customers(spark, sf_dir).select(
        k.alias("report"), pick(("en", "it", "fr", "es", "de", "pt"), k).alias("language"), "currency", F.when(k % 4 > 0, F.col("city")).otherwise("").alias("city"), "country",
        F.col("c_acctbal").alias("budget"), spend.alias("spend"), (F.col("c_acctbal") - F.floor("c_acctbal") - (k % 2)).alias("savings"), (k % 4 == 0).alias("zero_day"),
    )
    nation = F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("country")))
    shops = chains(spark, sf_dir).join(nation, "nation_key").select("store", "country", (F.lit(0.8) + (F.col("store") % 40) / 100).alias("multiplier"))
    compared = baskets.compare_stores(who.select(F.col("report").alias("basket"), "country", F.col("budget").alias("total")), F.broadcast(shops))
    return reports.report_rows(
        who, c7_week_plan(spark, sf_dir).withColumnRenamed("id", "report"), c9_week_shopping(spark, sf_dir).withColumnRenamed("basket", "report"),
        compared.select(F.col("basket").alias("report"), "place", F.concat(F.lit("Store "), F.col("store")).alias("name"), "total", "cheapest"),
    )


_WORDS = ", ".join("('" + language + "', " + ", ".join("'" + words[k] + "'" for k in reports.WORDS["en"]) + ")" for language, words in reports.WORDS.items())


def _money_sql(amount: str) -> str:
    plain = f"format('{{:,.2f}}', {amount})"
    sign = "CASE currency WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' WHEN 'USD' THEN '$' END"
    return f"coalesce(CASE language WHEN 'en' THEN {sign} || {plain} WHEN 'fr' THEN translate({plain}, ',.', chr(8239) || ',') || chr(160) || {sign} ELSE translate({plain}, ',.', '.,') || chr(160) || {sign} END, currency || ' ' || replace({plain}, ',', ''))"


S16_SQL = f"""WITH said(language, {", ".join(f"w_{k}" for k in reports.WORDS["en"])}) AS (VALUES {_WORDS}),
who AS (SELECT c_custkey AS report, ['en', 'it', 'fr', 'es', 'de', 'pt'][c_custkey % 6 + 1] AS language, ['EUR', 'GBP', 'USD', 'AED'][n_nationkey % 4 + 1] AS currency, CASE WHEN c_custkey % 4 > 0 THEN n_name || '/' || (c_custkey % 3) || ' · ' ELSE '' END || n_name AS place,
  c_acctbal AS budget, floor(c_acctbal) AS spend, greatest(0, c_acctbal - floor(c_acctbal) - c_custkey % 2) AS savings, c_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
r AS (SELECT w.*, s.* EXCLUDE (language) FROM who w JOIN said s ON s.language = CASE w.language WHEN 'pt' THEN 'en' ELSE w.language END),
meals AS (SELECT id AS report, day, breakfast, lunch, dinner FROM ({C7_PLAN_SQL})),
goods AS (SELECT basket AS report, place, name, quantity, category FROM ({C9_WEEK_SQL})),
m AS (SELECT report, s_suppkey AS store, floor(budget * (0.8::DOUBLE + (s_suppkey % 40)::DOUBLE / 100) * 100 + 0.5) / 100 AS total FROM who JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY s_nationkey, s_suppkey % 8) ON s_nationkey = c_nationkey WHERE budget > 0),
shops AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY total, store) AS place, total = min(total) OVER (PARTITION BY report) AS cheapest FROM m)
SELECT report, 1 AS section, 0 AS ord, place AS label, NULL AS value FROM r
UNION ALL SELECT report, 2, 0, w_budget, {_money_sql("budget")} FROM r UNION ALL SELECT report, 2, 1, w_spend, {_money_sql("spend")} FROM r UNION ALL SELECT report, 2, 2, w_savings, {_money_sql("savings")} FROM r
UNION ALL SELECT report, 2, 3, w_zero, CASE WHEN report % 4 = 0 THEN w_yes ELSE w_no END FROM r
UNION ALL SELECT report, 3, (day * 3 + t.k)::INT, [w_breakfast, w_lunch, w_dinner][t.k + 1], [breakfast, lunch, dinner][t.k + 1] FROM meals JOIN r USING (report), range(3) t(k)
UNION ALL SELECT goods.report, 4, goods.place::INT, '• ' || name || ' — ' || quantity, category FROM goods JOIN r USING (report)
UNION ALL SELECT shops.report, 5, shops.place::INT, 'Store ' || store || CASE WHEN cheapest THEN ' · ' || w_cheapest ELSE '' END, {_money_sql("total")} FROM shops JOIN r USING (report)"""


def s17_event_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sink of known events holds after the table has run through it as a stream: each event once, by kind."""
    base = fresh_path(spark)
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    events.write.parquet(f"{base}/in")
    start_sink(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 64).parquet(f"{base}/in"), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{base}/out").select("event_id", "event_type", "user_id")


S17_SQL = f"SELECT event_id, event_type, user_id FROM events WHERE event_type IN ({', '.join(repr(k) for k in KINDS)})"

QUERIES = {
    "a5_grocery_totals": (a5_grocery_totals, A5_SQL),
    "f79_recipe_records": (f79_recipe_records, F79_SQL),
    "f81_area_recipes": (f81_area_recipes, F81_SQL),
    "s16_report_rows": (s16_report_rows, S16_SQL),
    "s17_event_sink": (s17_event_sink, S17_SQL),
}
