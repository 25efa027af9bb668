"""Queries over profiles, plans, recipes and their results, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.measure import budget_tier, draw, lcg_states, round2
from larder.functions.quantity import js_round, lookup, parse_shopping, scale_template
from larder.functions.text import capitalise
from larder.operators import baskets, ranking
from larder.plans.carriers import table

# ---- A4: ingredient lines into shopping lines ----


def a4_merge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds, labels = (F.array(*[F.lit(x) for x in xs]) for xs in (("g", "ml", "pcs", "raw"), ("g", "ml", "pcs", "cans")))
    line = table(spark, sf_dir, "lineitem").withColumn("k", ((F.col("l_partkey") + F.col("l_linenumber")) % 4 + 1).cast("int"))
    lines = line.select(
        F.col("l_orderkey").alias("basket"), (F.col("l_partkey") % 20).cast("string").alias("key"), capitalise(F.concat(F.lit("item "), F.col("l_partkey").cast("string"))).alias("name"),
        F.element_at(kinds, F.col("k")).alias("kind"), (F.col("l_quantity") * F.when(F.col("k") <= 2, 17).otherwise(1)).alias("amount"), F.element_at(labels, F.col("k")).alias("label"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"),
    )
    return baskets.merge_lines(lines)


A4_SQL = """WITH l AS (SELECT l_orderkey AS basket, (l_partkey % 20)::VARCHAR AS key, 'Item ' || l_partkey AS name, (l_partkey + l_linenumber) % 4 + 1 AS k, l_quantity, row(l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord FROM lineitem),
m AS (SELECT basket, key, name, ['g','ml','pcs','raw'][k] AS kind, l_quantity * CASE WHEN k <= 2 THEN 17 ELSE 1 END AS amount, ['g','ml','pcs','cans'][k] AS label, ord FROM l),
f AS (SELECT basket, key, arg_min(name, ord) AS name, arg_min(kind, ord) AS kind, arg_min(label, ord) AS label FROM m GROUP BY ALL),
s AS (SELECT f.basket, f.key, any_value(f.name) AS name, any_value(f.kind) AS kind, any_value(f.label) AS label, sum(m.amount) AS amount FROM f JOIN m ON f.basket = m.basket AND f.key = m.key AND f.kind = m.kind GROUP BY ALL)
SELECT basket, key, name, kind, amount, CASE WHEN amount <= 0 THEN label
  WHEN kind IN ('g','ml') AND amount >= 1000 THEN regexp_replace((floor(amount / 1000 * 4 + 0.5) / 4)::DECIMAL(20,2)::VARCHAR, '\\.?0+$', '') || CASE kind WHEN 'g' THEN ' kg' ELSE ' l' END
  WHEN kind IN ('g','ml') THEN (ceil(amount / 50) * 50)::BIGINT || ' ' || kind ELSE ceil(amount)::BIGINT || ' ' || label END AS quantity FROM s"""

# ---- F20, F25: quantity texts ----


def f20_parse_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.array(*[F.lit(u) for u in ("kg", "g", "tbsp", "cups", "slices", "cloves", "tins")])
    text = F.concat_ws(" ", F.col("l_quantity").cast("int").cast("string"), F.element_at(units, (F.col("l_partkey") % 7 + 1).cast("int")))
    got = table(spark, sf_dir, "lineitem").select(text.alias("text")).distinct().withColumn("q", parse_shopping(F.col("text")))
    return got.select("text", F.col("q.amount").alias("amount"), F.col("q.unit").alias("unit"), scale_template(F.col("text"), F.lit(0.7)).alias("scaled"))


F20_SQL = """WITH t AS (SELECT DISTINCT l_quantity::INT AS n, ['kg','g','tbsp','cups','slices','cloves','tins'][l_partkey % 7 + 1] AS u FROM lineitem), v AS (SELECT n, u, n * 0.7::DOUBLE AS s FROM t)
SELECT n || ' ' || u AS text, CASE u WHEN 'tbsp' THEN n * 15.0 WHEN 'cups' THEN n * 240.0 WHEN 'slices' THEN ceil(n / 20) WHEN 'cloves' THEN n * 5.0 ELSE n END::DOUBLE AS amount,
  CASE u WHEN 'tbsp' THEN 'ml' WHEN 'cups' THEN 'ml' WHEN 'slices' THEN 'unit' WHEN 'cloves' THEN 'g' WHEN 'tins' THEN 'unit' ELSE u END AS unit,
  regexp_replace(CASE u WHEN 'tins' THEN greatest(1.0, floor(s + 0.5)) WHEN 'g' THEN greatest(50.0, floor(s / 50 + 0.5) * 50)
    WHEN 'kg' THEN CASE WHEN s >= 2 THEN floor(s * 2 + 0.5) / 2 ELSE greatest(0.1, floor(s * 10 + 0.5) / 10) END
    ELSE CASE WHEN s >= 10 THEN floor(s + 0.5) ELSE floor(s * 10 + 0.5) / 10 END END::DECIMAL(20,1)::VARCHAR, '\\.0$', '') || ' ' || u AS scaled FROM v"""

# ---- C5, C6, F46: scorecard ----


def score(profiles: DataFrame) -> DataFrame:
    """Results of profiles (id, budget, household, period weekly or monthly, zero_day, items, healthy, spend, missing).

    One unpriced line makes every money result 0 and the status unavailable.
    """
    c, half = F.col, js_round
    scale, days = F.when(c("period") == "monthly", 30.0 / 7).otherwise(1.0), F.when(c("period") == "monthly", 30).otherwise(7)
    ok = (c("missing") == 0) & (c("items") > 0) & (c("spend") > 0)
    p = profiles.withColumns({"budget": F.greatest(F.coalesce("budget", F.lit(0.0)), F.lit(0.0)), "spend": F.when(ok, round2(c("spend"))).otherwise(0.0), "ok": F.coalesce(ok, F.lit(False)), "zero": F.when(c("zero_day"), 1).otherwise(0)})
    p = p.withColumns({"ratio": F.when(c("budget") > 0, c("spend") / c("budget")).otherwise(0.0), "least": half(14 * c("household") * scale), "weekly": round2(c("spend") / scale)})
    status = F.when(~c("ok"), "unavailable").when(c("spend") > c("budget"), "over").when((c("budget") > 0) & (c("budget") < c("least")), "too_low").when(c("ratio") >= 0.9, "optimized").otherwise("comfortable")
    savings = F.when(c("ok"), F.greatest(F.lit(0.0), round2(c("budget") - c("spend")))).otherwise(0.0)
    within = half(100 - F.greatest(F.lit(0.0), c("ratio") - 0.85) * 120)
    beyond = half(F.greatest(F.lit(0.0), 100 - (c("ratio") - 1) * 300))
    clamp = lambda x: F.least(F.lit(100.0), F.greatest(F.lit(0.0), x))
    p = p.withColumns({
        "status": status, "savings": savings, "over": F.when(c("ok"), F.greatest(F.lit(0.0), round2(c("spend") - c("budget")))).otherwise(0.0),
        "efficiency": F.when(c("ok"), clamp(F.when(c("spend") <= c("budget"), within).otherwise(beyond))).otherwise(0.0),
        "waste": F.when(c("ok"), F.least(F.lit(100.0), 70 + (28 + 12 * c("zero")) / 2)).otherwise(0.0), "nutrition": F.when(c("ok"), F.when(c("healthy"), 92.0).otherwise(84.0)).otherwise(0.0),
        "saved_kg": half((1.4 * c("household") + c("zero") * half(0.6 * c("household") * 10) / 10) * 10) / 10,
    })
    total = F.least(F.lit(99.0), half(0.55 * c("efficiency") + 0.2 * c("waste") + 0.15 * c("nutrition") + 0.1 * 85 + 4 * c("zero")))
    return p.select(
        "id", F.greatest(F.least("items", F.lit(12)), F.when(c("zero") == 1, F.least(F.lit(6.0), F.greatest(F.lit(3.0), half(c("items") * 0.25)))).otherwise(0)).alias("reused"), F.when(c("zero") == 1, round2(c("weekly") / 7)).otherwise(0.0).alias("zero_spend"), "status", "savings", "over", "weekly", "efficiency", "waste", "saved_kg", F.when(c("ok"), total).otherwise(0.0).alias("total"),
        (savings * F.when(c("period") == "monthly", 12).otherwise(52)).alias("annual_savings"), (c("spend") / c("household") / days).alias("per_person_day"),
        F.when(c("status") == "too_low", c("least")).alias("minimum_budget"), F.when(c("status") == "too_low", half(28 * c("household") * scale)).alias("recommended_budget"),
        budget_tier(c("budget"), c("household"), c("period")).alias("tier"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / 20000).alias("spend"), F.count("*").alias("items"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").join(spend, c == F.col("o_custkey"), "left").select(
        c.alias("id"), (F.col("c_acctbal") / 20).alias("budget"), (c % 6 + 1).alias("household"), F.when(c % 2 == 0, "weekly").otherwise("monthly").alias("period"), (c % 3 == 0).alias("zero_day"),
        F.coalesce("items", F.lit(0)).alias("items"), (c % 5 == 0).alias("healthy"), F.coalesce("spend", F.lit(0.0)).alias("spend"), F.coalesce((F.col("p") > 4).cast("int"), F.lit(0)).alias("missing"),
    )


def c5_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(profiles(spark, sf_dir)).drop("reused", "zero_spend")


def _r(x: str, unit: str = "1") -> str:
    return f"floor({x} + 0.5)" if unit == "1" else f"floor(({x}) * {unit} + 0.5) / {unit}"


C5_CTE = f"""WITH o AS (SELECT o_custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / 20000 AS spend, count(*) AS items, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1),
a AS (SELECT c_custkey AS id, greatest(c_acctbal / 20, 0.0) AS budget, c_custkey % 6 + 1 AS household, CASE WHEN c_custkey % 2 = 0 THEN 1.0::DOUBLE ELSE 30.0::DOUBLE / 7 END AS scale, c_custkey % 2 = 0 AS weekly_,
  CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS zero, c_custkey % 5 = 0 AS healthy, coalesce(items, 0) AS items, coalesce(spend, 0.0) AS raw, coalesce(spend > 0 AND p <= 4, false) AS ok FROM customer LEFT JOIN o ON o_custkey = c_custkey),
b AS (SELECT *, CASE WHEN ok THEN {_r("raw", "100")} ELSE 0.0 END AS spend, {_r("14 * household * scale")} AS least FROM a),
c AS (SELECT *, CASE WHEN budget > 0 THEN spend / budget ELSE 0.0 END AS ratio FROM b),
d AS (SELECT *, CASE WHEN NOT ok THEN 'unavailable' WHEN spend > budget THEN 'over' WHEN budget > 0 AND budget < least THEN 'too_low' WHEN ratio >= 0.9::DOUBLE THEN 'optimized' ELSE 'comfortable' END AS status,
  CASE WHEN ok THEN greatest(0.0, {_r("budget - spend", "100")}) ELSE 0.0 END AS savings, CASE WHEN ok THEN greatest(0.0, {_r("spend - budget", "100")}) ELSE 0.0 END AS over,
  CASE WHEN NOT ok THEN 0.0 WHEN spend <= budget THEN least(100.0, greatest(0.0, {_r("100 - greatest(0.0, ratio - 0.85::DOUBLE) * 120")})) ELSE least(100.0, greatest(0.0, {_r("greatest(0.0, 100 - (ratio - 1) * 300)")})) END AS efficiency,
  CASE WHEN ok THEN least(100.0, 70 + (28 + 12 * zero) / 2) ELSE 0.0 END AS waste, CASE WHEN NOT ok THEN 0.0 WHEN healthy THEN 92.0 ELSE 84.0 END AS nutrition,
  {_r("1.4::DOUBLE * household + zero * " + _r("0.6::DOUBLE * household", "10"), "10")} AS saved_kg FROM c)
"""
C5_SQL = (
    C5_CTE
    + f"""SELECT id, status, savings, over, {_r("spend / scale", "100")} AS weekly, efficiency, waste::DOUBLE AS waste, saved_kg,
  CASE WHEN ok THEN least(99.0, {_r("0.55::DOUBLE * efficiency + 0.2::DOUBLE * waste + 0.15::DOUBLE * nutrition + 0.1::DOUBLE * 85 + 4 * zero")}) ELSE 0.0 END AS total,
  savings * CASE WHEN weekly_ THEN 52 ELSE 12 END AS annual_savings, spend / household / CASE WHEN weekly_ THEN 7 ELSE 30 END AS per_person_day,
  CASE WHEN status = 'too_low' THEN least END AS minimum_budget, CASE WHEN status = 'too_low' THEN {_r("28 * household * scale")} END AS recommended_budget,
  CASE WHEN budget > 0 AND budget * scale2 < 300 THEN 'low' WHEN budget > 0 AND budget * scale2 >= 500 THEN 'premium' ELSE 'medium' END AS tier
FROM (SELECT *, CASE WHEN weekly_ THEN 30.0::DOUBLE / 7 ELSE 1.0::DOUBLE END / least(greatest(household / 4, 0.5::DOUBLE), 2.0::DOUBLE) AS scale2 FROM d)"""
)


# What a household spends in a week, by city; OTHER_WEEKLY elsewhere.
CITY_WEEKLY = {"london": 135, "naples": 95, "berlin": 110, "dubai": 165}
OTHER_WEEKLY = 120
_CITIES = ("London", "NAPLES", "Berlin", "dubai", "Rome")


def insights(scored: DataFrame, city: Column) -> DataFrame:
    """id, key, value: up to four remarks on each scored profile, each only where its number is above 0."""
    average = F.coalesce(lookup(CITY_WEEKLY, F.lower(city)), F.lit(OTHER_WEEKLY))
    row = lambda key, value: F.when(value > 0, F.struct(F.lit(key).alias("key"), value.cast("double").alias("value")))
    below = js_round((average - F.col("weekly")) / average * 100)
    rows = [row("below_average", below), row("reused", F.col("reused")), row("annual_savings", F.col("annual_savings")), row("zero_spend", F.col("zero_spend"))]
    return scored.select("id", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("id", "r.key", "r.value")


def c6_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remarks on every profile, spending compared with the average of its city."""
    city = F.element_at(F.array(*[F.lit(c) for c in _CITIES]), (F.col("id") % 5 + 1).cast("int"))
    return insights(score(profiles(spark, sf_dir)), city)


C6_SQL = (
    C5_CTE
    + f""", av AS (SELECT *, [135, 95, 110, 165, 120][id % 5 + 1] AS average FROM d),
e AS (SELECT id, {_r("(average - " + _r("spend / scale", "100") + ") / average * 100")} AS below, savings * CASE WHEN weekly_ THEN 52 ELSE 12 END AS annual, greatest(least(items, 12), CASE WHEN zero = 1 THEN least(6, greatest(3, floor(items * 0.25::DOUBLE + 0.5))) ELSE 0 END) AS reused, CASE WHEN zero = 1 THEN {_r(_r("spend / scale", "100") + " / 7", "100")} ELSE 0.0 END AS zsd FROM av)
SELECT id, 'below_average' AS key, below::DOUBLE AS value FROM e WHERE below > 0 UNION ALL SELECT id, 'reused', reused::DOUBLE FROM e WHERE reused > 0
UNION ALL SELECT id, 'zero_spend', zsd::DOUBLE FROM e WHERE zsd > 0 UNION ALL SELECT id, 'annual_savings', annual::DOUBLE FROM e WHERE annual > 0"""
)

# ---- C7, P1, F45: seeded plans ----

# Dishes of the demonstration pool.
DISHES = ("lentil soup", "chicken rice", "bean chili", "fish stew", "pasta bake", "egg curry", "tofu bowl")


def without_dislikes(dishes: Column, dislikes: Column) -> Column:
    """Dishes without a disliked word in their name; all of them where none is left."""
    left = F.filter(dishes, lambda d: ~F.exists(dislikes, lambda x: (F.trim(x) != "") & F.contains(F.lower(d), F.lower(F.trim(x)))))
    return F.when(F.size(left) > 0, left).otherwise(dishes)


def c7_seeded_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven dinners per profile, drawn from the dishes it doesn't dislike, the same for the same seed."""
    dislikes = F.split(F.when(F.col("c_custkey") % 3 == 0, "chicken, fish").when(F.col("c_custkey") % 3 == 1, "e").otherwise(""), "[,\n]")
    pool = without_dislikes(F.array(*[F.lit(d) for d in DISHES]), dislikes)
    plan = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), pool.alias("pool"), lcg_states(F.col("c_custkey"), 7).alias("states"))
    picked = plan.select("id", "pool", F.posexplode("states").alias("day", "state"))
    at = F.pmod(F.floor(draw(F.col("state")) * F.size("pool")), F.size("pool")) + 1
    return picked.select("id", "day", "state", F.element_at("pool", at.cast("int")).alias("dinner"))


C7_SQL = f"""WITH RECURSIVE s(id, day, state) AS (
  SELECT c_custkey, -1, greatest((c_custkey::BIGINT * 2654435761) % 4294967296, 1) FROM customer UNION ALL SELECT id, day + 1, (state * 1664525 + 1013904223) % 4294967296 FROM s WHERE day < 6),
p AS (SELECT id, day::INT AS day, state::BIGINT AS state, CASE id % 3 WHEN 0 THEN {[d for d in DISHES if "chicken" not in d and "fish" not in d]} WHEN 1 THEN {[d for d in DISHES if "e" not in d] or list(DISHES)} ELSE {list(DISHES)} END AS pool FROM s WHERE day >= 0)
SELECT id, day, state, pool[(floor(state / 4294967295.0::DOUBLE * len(pool))::BIGINT % len(pool)) + 1] AS dinner FROM p"""

# ---- nested plans, overlays, state ----


def j11_overlay_meals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as days of meals: nested, edited by a patch per (day, meal), flattened, empty meals dropped."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("day"), F.col("turn").alias("meal"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))
    nested = turns.groupBy("day").agg(F.sort_array(F.collect_list(F.struct("meal", "size"))).alias("meals"))
    flat = nested.select("day", F.explode("meals").alias("m")).select("day", "m.meal", "m.size")
    patches = turns.where("meal % 4 = 2").select("day", "meal", (F.col("size") * 2).alias("patched"))
    return flat.join(patches, ["day", "meal"], "left").select("day", "meal", F.coalesce("patched", "size").alias("size")).where("size > 0")


J11_SQL = "SELECT conv_id AS day, turn AS meal, (coalesce(length(text), 0) * CASE WHEN turn % 4 = 2 THEN 2 ELSE 1 END)::BIGINT AS size FROM conversations WHERE coalesce(length(text), 0) > 0"


def a8_plan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("meals"), F.count_if(F.coalesce(F.col("role") == "user", F.lit(False))).alias("unparsed"))


A8_SQL = "SELECT conv_id, count(*) AS meals, count(*) FILTER (role = 'user') AS unparsed FROM conversations GROUP BY 1"


def t5_latest_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"], ["value"])


T5_SQL = "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2"


def j17_visible_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of child tables that the owner of their parent may see."""
    owners = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    mine = table(spark, sf_dir, "orders").join(owners, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(mine, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("items"))


J17_SQL = "SELECT l_orderkey, count(*) AS items FROM lineitem WHERE EXISTS (SELECT 1 FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = l_orderkey AND c_mktsegment = 'BUILDING') GROUP BY 1"

QUERIES = {
    "a4_merge_lines": (a4_merge_lines, A4_SQL),
    "f20_parse_quantities": (f20_parse_quantities, F20_SQL),
    "c5_scorecard": (c5_scorecard, C5_SQL),
    "c6_insights": (c6_insights, C6_SQL),
    "c7_seeded_plan": (c7_seeded_plan, C7_SQL),
    "j11_overlay_meals": (j11_overlay_meals, J11_SQL),
    "a8_plan_stats": (a8_plan_stats, A8_SQL),
    "t5_latest_generation": (t5_latest_generation, T5_SQL),
    "j17_visible_items": (j17_visible_items, J17_SQL),
}
