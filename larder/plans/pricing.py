"""Queries that price baskets, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.measure import parse_price, round2, sanitise
from larder.functions.quantity import pack_count, parse_shopping
from larder.operators import baskets, matching, ranking
from larder.plans.carriers import chains, customers, price_rows, table, words_of
from larder.sources.scratch import kept

PRICE_SQL = """
rows_ AS (
  SELECT l_partkey AS ingredient, n_name || '/' || (l_linenumber % 3) AS city, n_name AS country, r_name AS region,
    ['g','kg','ml','l','unit'][(l_partkey + l_suppkey) % 5 + 1] AS unit, (l_suppkey % 7 + 1)::DOUBLE AS quantity,
    l_extendedprice / l_quantity AS price, ['EUR','GBP','USD','AED','JPY'][n_nationkey % 5 + 1] AS currency,
    l_orderkey AS o1, l_linenumber AS o2, l_suppkey AS o3, l_extendedprice AS o4
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
per AS (
  SELECT *, CASE WHEN unit IN ('g','kg') THEN 'mass' WHEN unit IN ('ml','l') THEN 'volume' ELSE 'count' END AS family,
    CASE WHEN unit IN ('kg','l') THEN 1000.0 ELSE 1.0 END AS factor,
    CASE currency WHEN 'EUR' THEN 1.0::DOUBLE WHEN 'GBP' THEN 1.16::DOUBLE WHEN 'USD' THEN 0.92::DOUBLE WHEN 'AED' THEN 0.25::DOUBLE END AS rate FROM rows_),
requests AS (
  SELECT o_orderkey AS request, o_custkey AS basket, CASE WHEN o_orderkey % 10 = 3 THEN -1 ELSE o_orderkey % 200 END AS ingredient, n_name || '/' || (c_custkey % 3) AS city, n_name AS country, r_name AS region,
    ['EUR','GBP','USD','AED'][n_nationkey % 4 + 1] AS currency
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
"""


def _tier_sql(tier: str, keys: str) -> str:
    first = "min(row(o1, o2, o3, o4, unit, quantity, price, rate))"
    group = f"ingredient{', ' + keys if keys else ''}"
    return f"""
{tier}_first AS (SELECT {group}, arg_min(unit, row(o1, o2, o3, o4)) AS unit, arg_min(quantity, row(o1, o2, o3, o4)) AS quantity,
  arg_min(price, row(o1, o2, o3, o4)) AS price, arg_min(currency, row(o1, o2, o3, o4)) AS currency,
  avg(price * rate / (quantity * factor)) FILTER (family = 'mass') AS mass, avg(price * rate / (quantity * factor)) FILTER (family = 'volume') AS volume,
  avg(price * rate / (quantity * factor)) FILTER (family = 'count') AS count_ FROM per GROUP BY {group}),
{tier}_ AS (SELECT {group}, unit, quantity,
  CASE WHEN '{tier}' = 'city' THEN price * CASE currency WHEN 'EUR' THEN 1.0::DOUBLE WHEN 'GBP' THEN 1.16::DOUBLE WHEN 'USD' THEN 0.92::DOUBLE WHEN 'AED' THEN 0.25::DOUBLE END
  ELSE CASE WHEN unit IN ('g','kg') THEN mass WHEN unit IN ('ml','l') THEN volume ELSE count_ END * (quantity * CASE WHEN unit IN ('kg','l') THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END) END AS euros
  FROM {tier}_first)"""  # fmt: skip


TIERS_SQL = ",".join(_tier_sql(t, k) for t, k in (("city", "city"), ("country", "country"), ("region", "region"), ("global", "")))
CASCADE_SQL = f"""WITH {PRICE_SQL},{TIERS_SQL},
cascade AS (
  SELECT q.*, CASE WHEN a.ingredient IS NOT NULL THEN 'city' WHEN b.ingredient IS NOT NULL THEN 'country' WHEN c.ingredient IS NOT NULL THEN 'region'
    WHEN d.ingredient IS NOT NULL THEN 'global' ELSE 'missing' END AS tier,
    CASE WHEN a.ingredient IS NOT NULL THEN a.unit WHEN b.ingredient IS NOT NULL THEN b.unit WHEN c.ingredient IS NOT NULL THEN c.unit ELSE d.unit END AS unit,
    CASE WHEN a.ingredient IS NOT NULL THEN a.quantity WHEN b.ingredient IS NOT NULL THEN b.quantity WHEN c.ingredient IS NOT NULL THEN c.quantity ELSE d.quantity END AS quantity,
    CASE WHEN a.ingredient IS NOT NULL THEN a.euros WHEN b.ingredient IS NOT NULL THEN b.euros WHEN c.ingredient IS NOT NULL THEN c.euros ELSE d.euros END AS euros,
    CASE WHEN a.ingredient IS NOT NULL THEN 0.9::DOUBLE WHEN b.ingredient IS NOT NULL THEN 0.7::DOUBLE WHEN c.ingredient IS NOT NULL THEN 0.55::DOUBLE
      WHEN d.ingredient IS NOT NULL THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS confidence
  FROM requests q LEFT JOIN city_ a ON a.ingredient = q.ingredient AND a.city = q.city LEFT JOIN country_ b ON b.ingredient = q.ingredient AND b.country = q.country
    LEFT JOIN region_ c ON c.ingredient = q.ingredient AND c.region = q.region LEFT JOIN global_ d ON d.ingredient = q.ingredient),
priced AS (SELECT *, floor(euros / CASE currency WHEN 'EUR' THEN 1.0::DOUBLE WHEN 'GBP' THEN 1.16::DOUBLE WHEN 'USD' THEN 0.92::DOUBLE ELSE 0.25::DOUBLE END * 100 + 0.5) / 100 AS unit_price FROM cascade)
"""


def asked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request, basket, ingredient: each order asks for one ingredient; a tenth ask for one that nobody sells (-1)."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_custkey").alias("basket"), F.when(F.col("o_orderkey") % 10 == 3, -1).otherwise(F.col("o_orderkey") % 200).alias("ingredient"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asked_orders with the place and currency of their customer."""
    return asked_orders(spark, sf_dir).join(customers(spark, sf_dir), F.col("basket") == F.col("c_custkey")).select("request", "basket", "ingredient", "city", "country", "region", "currency")


def priced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price rows of ingredients that nobody asks for can't be chosen, so they go before any row is grouped or shuffled."""
    wanted = kept(asked_orders(spark, sf_dir).select("ingredient").distinct())
    return matching.cascade(requests(spark, sf_dir), matching.place_prices(price_rows(spark, sf_dir, wanted)))


def j3_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced_requests(spark, sf_dir).select("request", "tier", "unit", "quantity", "unit_price", "confidence")


J3_SQL = CASCADE_SQL + "SELECT request, tier, unit, quantity, unit_price, confidence FROM priced"

# Quantity texts that the requests cycle through, as (text, amount in base units, family).
NEEDS = (("1.5 kg", 1500.0, "mass"), ("250 g", 250.0, "mass"), ("2 tbsp", 30.0, "volume"), ("8", 8.0, "count"), ("3 cloves", 15.0, "mass"), ("41 slices", 3.0, "count"), ("to taste", None, None))
PIECE_GRAMS = 150.0


def c2_price_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cascade, packs, sanity cap and basket totals (of C2 only J3, A1, F20, F23, F24, A3; one piece weight and one cap for all)."""
    texts = F.array(*[F.lit(t) for t, _, _ in NEEDS])
    lines = priced_requests(spark, sf_dir).withColumn("need", parse_shopping(F.element_at(texts, (F.col("request") % len(NEEDS) + 1).cast("int"))))
    packs = pack_count(F.col("need"), F.col("unit"), F.col("quantity"), F.lit(PIECE_GRAMS))
    scaled = lines.withColumn("cost", sanitise(packs * F.col("unit_price") / 1000, F.lit("Proteins")))
    return baskets.totals(scaled)


_amounts = ", ".join("NULL" if a is None else f"{a}::DOUBLE" for _, a, _ in NEEDS)
_families = ", ".join("NULL" if f is None else f"'{f}'" for _, _, f in NEEDS)
C2_SQL = (
    CASCADE_SQL
    + f""", need AS (SELECT *, [{_amounts}][request % 7 + 1] AS base, [{_families}][request % 7 + 1] AS want,
    CASE WHEN unit IN ('g','kg') THEN 'mass' WHEN unit IN ('ml','l') THEN 'volume' WHEN unit = 'unit' THEN 'count' END AS have FROM priced),
  req AS (SELECT *, CASE WHEN have = want THEN base WHEN have = 'mass' AND want = 'count' THEN base * {PIECE_GRAMS} WHEN have = 'count' AND want = 'mass' THEN greatest(1.0, ceil(base / {PIECE_GRAMS}))
    WHEN have IN ('mass','volume') AND want IN ('mass','volume') THEN base WHEN have = 'count' AND want = 'volume' THEN 1.0 END AS required FROM need),
  costs AS (SELECT *, CASE WHEN required IS NOT NULL THEN greatest(1, ceil(required / (quantity * CASE WHEN unit IN ('kg','l') THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END))) * unit_price / 1000 END AS raw FROM req),
  fine AS (SELECT basket, confidence, CASE WHEN raw IS NULL OR raw <= 0 OR raw > 90 THEN 0.0 ELSE floor(raw * 100 + 0.5) / 100 END AS cost FROM costs)
SELECT basket, sum(cost::DECIMAL(18,2))::DOUBLE AS total, count(*) FILTER (cost > 0) / count(*) AS coverage,
  coalesce(sum(confidence::DECIMAL(18,3)) FILTER (cost > 0)::DOUBLE / nullif(count(*) FILTER (cost > 0), 0), 0.0) AS average_confidence, count(*) FILTER (NOT cost > 0) AS n_missing
FROM fine GROUP BY basket"""
)


def c3_cheaper_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another ingredient of the same place whose price per base unit of the same family is lower; c3_substitutions has the table of alternatives."""
    asked = priced_requests(spark, sf_dir).withColumn("other", (F.col("ingredient") + 1) % 200)
    offers = asked.where("unit_price > 0").groupBy("ingredient", "country", "unit").agg(F.min(F.col("unit_price") / F.col("quantity")).alias("per"))
    mine = offers.withColumn("other", (F.col("ingredient") + 1) % 200)
    theirs = offers.select(F.col("ingredient").alias("other"), "country", "unit", F.col("per").alias("other_per"))
    met = mine.join(theirs, ["other", "country", "unit"]).withColumn("saved", round2(F.col("per") - F.col("other_per")))
    return met.where("saved > 0").select("ingredient", "other", "country", "unit", "saved")


C3_SQL = (
    CASCADE_SQL
    + """, offers AS (SELECT ingredient, country, unit, min(unit_price / quantity) AS per FROM priced WHERE unit_price > 0 GROUP BY ALL)
SELECT a.ingredient, b.ingredient AS other, a.country, a.unit, floor((a.per - b.per) * 100 + 0.5) / 100 AS saved
FROM offers a JOIN offers b ON b.ingredient = (a.ingredient + 1) % 200 AND a.country = b.country AND a.unit = b.unit WHERE floor((a.per - b.per) * 100 + 0.5) / 100 > 0"""
)


def j1_token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(F.concat_ws(" ", F.lower("p_type"), "p_name").alias("item"))
    return matching.token_matches(items, table(spark, sf_dir, "part").select(F.col("p_name").alias("row")))


J1_SQL = f"""WITH a AS (SELECT DISTINCT lower(p_type) || ' ' || p_name AS item FROM part), b AS (SELECT DISTINCT p_name AS row FROM part),
x AS (SELECT item, {words_of("item")} AS w FROM a), y AS (SELECT row, {words_of("row")} AS w FROM b),
l AS (SELECT item, len(w) AS n, unnest(w) AS t FROM x), r AS (SELECT row, len(w) AS m, unnest(w) AS t FROM y),
s AS (SELECT item, row, count(*) / greatest(n, m) AS score FROM l JOIN r USING (t) GROUP BY item, row, n, m)
SELECT item, row, score FROM s WHERE score >= 0.34 QUALIFY score >= max(score) OVER (PARTITION BY item) - 0.001"""


def a2_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return ranking.keep_best(events, ["user_id", "event_type"], [F.desc("value"), F.asc("event_id")]).select("user_id", "event_type", "event_id", "value")


A2_SQL = "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1"


def c4_compare_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order at the chains of its country, eight at most, the cheapest first."""
    place = customers(spark, sf_dir).select("c_custkey", F.col("country"))
    of = table(spark, sf_dir, "orders").join(place, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("basket"), "country", F.col("o_totalprice").alias("total"))
    nation = F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("country")))
    stores = chains(spark, sf_dir).join(nation, "nation_key").select("store", "country", (F.lit(0.8) + (F.col("store") % 40) / 100).alias("multiplier"))
    return baskets.compare_stores(of, F.broadcast(stores))


C4_SQL = """WITH m AS (SELECT o_orderkey AS basket, s_suppkey AS store, floor(o_totalprice * (0.8::DOUBLE + (s_suppkey % 40)::DOUBLE / 100) * 100 + 0.5) / 100 AS total
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY s_nationkey, s_suppkey % 8) ON s_nationkey = c_nationkey WHERE o_totalprice > 0)
SELECT basket, store, row_number() OVER (PARTITION BY basket ORDER BY total, store)::INT AS place, total, floor((max(total) OVER w - total) * 100 + 0.5) / 100 AS saved, total = min(total) OVER w AS cheapest FROM m WINDOW w AS (PARTITION BY basket)"""


def f42_parse_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written in both conventions and read back; implausible ones go."""
    cents = F.format_number((F.col("p_partkey") * 37 % 9000) / 100, 2)
    swapped = F.translate(cents, ",.", ".,")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("£"), cents)).otherwise(F.concat(swapped, F.lit(" €")))
    got = table(spark, sf_dir, "part").select("p_partkey", parse_price(text).alias("p"))
    return got.select("p_partkey", "p.price", "p.currency").where("price > 0.2 and price < 60")


F42_SQL = "SELECT p_partkey, p_partkey * 37 % 9000 / 100 AS price, CASE WHEN p_partkey % 2 = 0 THEN 'GBP' ELSE 'EUR' END AS currency FROM part WHERE p_partkey * 37 % 9000 BETWEEN 21 AND 5999"

QUERIES = {
    "j3_cascade": (j3_cascade, J3_SQL),
    "c2_price_baskets": (c2_price_baskets, C2_SQL),
    "c3_cheaper_alternatives": (c3_cheaper_alternatives, C3_SQL),
    "j1_token_match": (j1_token_match, J1_SQL),
    "a2_keep_best": (a2_keep_best, A2_SQL),
    "c4_compare_stores": (c4_compare_stores, C4_SQL),
    "f42_parse_prices": (f42_parse_prices, F42_SQL),
}
