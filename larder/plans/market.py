"""Queries over shops, retailers, sources and saved plans, and the same in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions import food
from larder.functions.measure import EUR, convert, haversine_km, round2
from larder.functions.text import json_ld, normalise, og_image, strip_tags
from larder.operators import near, ranking
from larder.plans.carriers import table
from larder.plans.kitchen import NAMES, NAMES_SQL, QUANTITIES, pick
from larder.plans.shopping import serves
from larder.sources import layout
from larder.sources.scratch import fresh_path, spread
from larder.sources.tables import PRICE, load_prices, prices_of, provider

# The registry of the demonstration, one document per market; _default holds for the others.
REGISTRY = {
    "0": """[{"id":"fastcart","name":"FastCart","kind":"delivery","eta":"30-60 min","only":["build"],"never":[]},{"id":"greenshop","name":"Green Shop","kind":"supermarket","eta":"Same day","only":[],"never":["furniture"]},
             {"id":"oldmart","name":"Old Mart","kind":"supermarket","eta":"In-store only","only":[],"never":[]}]""",
    "1": """[{"id":"bikefood","name":"Bike Food","kind":"delivery","eta":"20-40 min","only":[],"never":["machinery"]},{"id":"cityfresh","name":"City Fresh","kind":"supermarket","eta":"Next day","only":[],"never":[]}]""",
    "2": """[{"id":"wholesale","name":"Wholesale","kind":"supermarket","eta":"In-store only","only":["household"],"never":[]},{"id":"openmarket","name":"Open Market","kind":"marketplace","eta":"2-3 days","only":[],"never":[]}]""",
    "_default": """[{"id":"postbox","name":"Post Box","kind":"supermarket","eta":"Next day","only":[],"never":[]}]""",
}
RETAILER = "array<struct<id:string,name:string,kind:string,eta:string,only:array<string>,never:array<string>>>"
# Further names under which a retailer of the demonstration appears.
RETAILER_ALIASES = (("fastcart", "fast cart groceries"), ("cityfresh", "the city fresh store"), ("bikefood", "bikefood com"))
# Place of each kind of retailer among offers.
PRIORITY = {"amazon": 0, "marketplace": 1, "delivery": 2, "supermarket": 3, "estimate": 9}
IN_STORE = "In-store only"

REGISTRY_CTE = """registry(market, ord, id, name, kind, eta, only_, never) AS (VALUES ('0', 0, 'fastcart', 'FastCart', 'delivery', '30-60 min', ['build'], []::VARCHAR[]), ('0', 1, 'greenshop', 'Green Shop', 'supermarket', 'Same day', [], ['furniture']),
  ('0', 2, 'oldmart', 'Old Mart', 'supermarket', 'In-store only', [], []), ('1', 0, 'bikefood', 'Bike Food', 'delivery', '20-40 min', [], ['machinery']), ('1', 1, 'cityfresh', 'City Fresh', 'supermarket', 'Next day', [], []),
  ('2', 0, 'wholesale', 'Wholesale', 'supermarket', 'In-store only', ['household'], []), ('2', 1, 'openmarket', 'Open Market', 'marketplace', '2-3 days', [], []), ('3', 0, 'postbox', 'Post Box', 'supermarket', 'Next day', [], []))"""


def retailers(spark: SparkSession, markets: DataFrame) -> DataFrame:
    """market, ord, id, name, kind, eta, only, never of each market: its own document, else the default one."""
    known = spark.createDataFrame(list(REGISTRY.items()), "market string, document string")
    default = known.where("market = '_default'").select(F.col("document").alias("other"))
    met = markets.select("market").distinct().join(F.broadcast(known), "market", "left").crossJoin(F.broadcast(default))
    return met.select("market", F.posexplode(F.from_json(F.coalesce("document", "other"), RETAILER)).alias("ord", "r")).select("market", "ord", "r.*")


def market_of(nation: Column) -> Column:
    return (nation % 4).cast("string")


def s5_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retailers of each nation."""
    nations = table(spark, sf_dir, "nation").select("n_name", market_of(F.col("n_nationkey")).alias("market"))
    return nations.join(F.broadcast(retailers(spark, nations)), "market").select("n_name", "ord", "id", "kind", "eta")


S5_SQL = f"WITH {REGISTRY_CTE} SELECT n_name, ord, id, kind, eta FROM nation JOIN registry ON market = (n_nationkey % 4)::VARCHAR"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, name, text, estimate, city, market: an ingredient asked for by each order."""
    who = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 > 0, F.lower("c_mktsegment")).alias("city"), market_of(F.col("c_nationkey")).alias("market"))
    key = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(key.alias("item"), "o_custkey", pick(NAMES, key).alias("name"), pick(QUANTITIES, key).alias("text"), F.when(key % 3 > 0, F.col("o_totalprice") / 1000).alias("estimate"))
    return asked.join(who, F.col("o_custkey") == F.col("c_custkey")).select("item", "name", "text", "estimate", "city", "market")


ITEMS_CTE = f"""items AS (SELECT o_orderkey AS item, ({NAMES_SQL})[o_orderkey % 24 + 1] AS name, ['250 g', '1.5 kg', '2 tbsp', '0,5 l', '3 cloves', 'to taste', '1 loaf', '1.25 cups', '4', 'a handful', '750 ml', '2 cans'][o_orderkey % 12 + 1] AS text,
  CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 1000 END AS estimate, CASE WHEN c_custkey % 11 > 0 THEN lower(c_mktsegment) END AS city, (c_nationkey % 4)::VARCHAR AS market FROM orders JOIN customer ON c_custkey = o_custkey)"""


def served(asked: DataFrame, spark: SparkSession) -> DataFrame:
    """asked with the retailers of its market that serve its city; a market has a few."""
    return asked.join(F.broadcast(retailers(spark, asked)).withColumnRenamed("name", "retailer"), "market").where(serves(F.col("city"), F.col("only"), F.col("never")))


def c11_buy_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All options of each item: direct offers, the marketplace, deliveries, online shops, the shopping search, in-store shops and the estimate.

    By kind, then confidence, then as listed; the cheapest offer that isn't an estimate and the fastest
    delivery marked (C11, U3, W5, W6, A11, F29, P14). An item's offers and what it asks for are shuffled once, as
    numbers and short texts; its options are laid out, ordered and marked inside its row.
    """
    ids = ("fastcart", "greenshop", "oldmart", "bikefood", "cityfresh", "wholesale", "openmarket", "elsewhere")
    markets = table(spark, sf_dir, "customer").select(market_of(F.col("c_nationkey")).alias("market")).distinct()
    everyone = reduce(DataFrame.union, [spark.createDataFrame([(k,)], "market string") for k in ("0", "1", "2", "3")])
    entries = lambda key, value, name: F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name)
    of_market = retailers(spark, markets.where("market is not null")).groupBy("market").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "kind", "eta", "only", "never"))).alias("shops")).agg(entries("market", "shops", "shops"))
    of_id = retailers(spark, everyone).agg(entries("id", F.struct("kind", "eta"), "known"))

    offer = F.struct(F.col("l_extendedprice").alias("price"), "l_linenumber", "l_partkey", "l_suppkey").alias("offer")
    asks = items(spark, sf_dir).select("item", F.struct("market", "city", "estimate").alias("ask"))
    real = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("item"), offer)
    met = asks.unionByName(real, allowMissingColumns=True).groupBy("item").agg(F.array_sort(F.collect_list("offer")).alias("offers"), F.collect_list("ask").alias("asks"))
    met = met.crossJoin(F.broadcast(of_market)).crossJoin(F.broadcast(of_id))

    none, yes, no = F.lit(None), F.lit(True), F.lit(False)
    priority = lambda kind: F.coalesce(*[F.when(kind == k, n) for k, n in PRIORITY.items()])
    option = lambda family, pos, id_, kind, source, price, confidence, eta, delivery: F.struct(priority(kind).alias("priority"), (-confidence).alias("less"), F.lit(family).alias("family"), pos.cast("long").alias("pos"), id_.alias("id"), kind.alias("kind"), F.lit(source).alias("source"), price.cast("double").alias("price"), confidence.alias("confidence"), eta.cast("string").alias("eta"), delivery.alias("delivery"))

    def direct(o: Column, at: Column) -> Column:
        id_ = pick(ids, o["l_suppkey"])
        known = F.try_element_at(F.col("known"), id_)
        able = F.coalesce((known["kind"] != "supermarket") | (known["eta"] != IN_STORE), no)
        return option(1, at + 1, id_, F.coalesce(known["kind"], F.lit("supermarket")), "direct_product_url", o["price"], F.when(at == 0, 0.9).otherwise(0.75), known["eta"], able)

    def around(ask: Column) -> Column:
        near = F.filter(F.coalesce(F.try_element_at(F.col("shops"), ask["market"]), F.array()), lambda s: serves(ask["city"], s["only"], s["never"]))
        shop, inside = lambda s: s["kind"] == "supermarket", lambda s: s["eta"] == IN_STORE
        of = lambda keep, family, kind, source, confidence, able: F.transform(F.filter(near, keep), lambda s: option(family, s["ord"], s["id"], F.lit(kind), source, none, F.lit(confidence), s["eta"], able))
        always = F.array(
            option(2, F.lit(0), F.lit("amazon-fresh"), F.lit("amazon"), "amazon_search", none, F.lit(0.6), F.when(ask["market"] == "2", "Next day").otherwise("Same day (Prime)"), yes),
            option(5, F.lit(0), F.lit("google-shopping"), F.lit("marketplace"), "google_shopping", none, F.lit(0.35), none, no),
        )
        guess = F.filter(F.array(option(7, F.lit(0), F.lit("estimated"), F.lit("estimate"), "estimated_fallback", round2(ask["estimate"]), F.lit(0.2), none, no)), lambda _: F.coalesce(ask["estimate"] > 0, no))
        return F.concat(
            always, guess, of(lambda s: s["kind"] == "delivery", 3, "delivery", "delivery_search", 0.55, yes),
            of(lambda s: shop(s) & ~inside(s), 4, "supermarket", "retailer_search_url", 0.45, yes), of(lambda s: shop(s) & inside(s), 6, "supermarket", "retailer_search_url", 0.25, no),
        )

    options = met.select("item", F.array_sort(F.concat(F.transform("offers", direct), F.flatten(F.transform("asks", around)))).alias("o"))
    said = lambda x: F.lower(F.coalesce(x["eta"], F.lit("")))
    wait = lambda x: F.when(F.contains(said(x), F.lit("min")), 0).when(F.contains(said(x), F.lit("same day")), 1).when(F.contains(said(x), F.lit("next day")), 2).otherwise(3)
    first = lambda fits, by: F.array_min(F.transform("o", lambda x, at: F.when(fits(x), F.struct(by(x).alias("by"), at.alias("at")))))["at"]
    cheapest = first(lambda x: (x["price"] > 0) & (x["source"] != "estimated_fallback"), lambda x: x["price"])
    marked = options.select("item", "o", cheapest.alias("low"), first(lambda x: x["delivery"], wait).alias("fast"))
    # outer: from a plain explode the optimiser infers a filter on the options and makes them twice
    spread_out = marked.select("item", "low", "fast", F.posexplode_outer("o").alias("at", "x"))
    mark = lambda best: F.coalesce(F.col(best) == F.col("at"), no)
    return spread_out.select("item", (F.col("at") + 1).alias("place"), "x.id", "x.kind", "x.source", "x.price", "x.confidence", "x.eta", "x.delivery", mark("low").alias("cheapest"), mark("fast").alias("fastest"))


_SERVED = "(city IS NULL OR CASE WHEN len(only_) > 0 THEN len(list_filter(only_, lambda x: contains(city, x))) > 0 ELSE len(list_filter(never, lambda x: contains(city, x))) = 0 END)"
C11_OPTIONS_SQL = f"""WITH {REGISTRY_CTE}, {ITEMS_CTE}, near AS (SELECT items.item, registry.* FROM items JOIN registry USING (market) WHERE {_SERVED}),
real AS (SELECT l_orderkey AS item, ['fastcart', 'greenshop', 'oldmart', 'bikefood', 'cityfresh', 'wholesale', 'openmarket', 'elsewhere'][l_suppkey % 8 + 1] AS id, l_extendedprice AS price,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey, l_suppkey) AS pos FROM lineitem WHERE l_returnflag = 'A'),
o AS (SELECT item, 1 AS family, pos, id, coalesce(r.kind, 'supermarket') AS kind, 'direct_product_url' AS source, price, CASE WHEN pos = 1 THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END AS confidence, eta, coalesce(r.kind <> 'supermarket' OR eta <> 'In-store only', false) AS delivery FROM real LEFT JOIN registry r USING (id)
  UNION ALL SELECT item, 2, 0, 'amazon-fresh', 'amazon', 'amazon_search', NULL, 0.6, CASE market WHEN '2' THEN 'Next day' ELSE 'Same day (Prime)' END, true FROM items
  UNION ALL SELECT item, 3, ord, id, 'delivery', 'delivery_search', NULL, 0.55, eta, true FROM near WHERE kind = 'delivery'
  UNION ALL SELECT item, 4, ord, id, 'supermarket', 'retailer_search_url', NULL, 0.45, eta, true FROM near WHERE kind = 'supermarket' AND eta <> 'In-store only'
  UNION ALL SELECT item, 5, 0, 'google-shopping', 'marketplace', 'google_shopping', NULL, 0.35, NULL, false FROM items
  UNION ALL SELECT item, 6, ord, id, 'supermarket', 'retailer_search_url', NULL, 0.25, eta, false FROM near WHERE kind = 'supermarket' AND eta = 'In-store only'
  UNION ALL SELECT item, 7, 0, 'estimated', 'estimate', 'estimated_fallback', floor(estimate * 100 + 0.5) / 100, 0.2, NULL, false FROM items WHERE estimate > 0),
p AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY CASE kind WHEN 'amazon' THEN 0 WHEN 'marketplace' THEN 1 WHEN 'delivery' THEN 2 WHEN 'supermarket' THEN 3 ELSE 9 END, confidence DESC, family, pos)::INT AS place,
  CASE WHEN contains(lower(eta), 'min') THEN 0 WHEN contains(lower(eta), 'same day') THEN 1 WHEN contains(lower(eta), 'next day') THEN 2 ELSE 3 END AS wait, price > 0 AND source <> 'estimated_fallback' AS priced FROM o)
SELECT item, place, id, kind, source, price, confidence, eta, delivery, coalesce(priced, false) AND row_number() OVER (PARTITION BY item ORDER BY coalesce(priced, false) DESC, price, place) = 1 AS cheapest,
  delivery AND row_number() OVER (PARTITION BY item ORDER BY delivery DESC, wait, place) = 1 AS fastest FROM p"""


def o6_basket_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a whole basket can be bought online: the marketplace, deliveries, online shops, by priority, then as listed; the estimate and its parts beside."""
    asked = items(spark, sf_dir)
    q = food.split_quantity(F.col("text"))
    first = asked.select("item", "text", F.lit("amazon-fresh").alias("id"), F.lit("amazon").alias("kind"), F.lit("Next day").alias("eta"), F.lit(0).alias("ord"))
    others = served(asked, spark).where((F.col("kind") == "delivery") | (F.col("kind") == "supermarket") & (F.col("eta") != IN_STORE)).select("item", "text", "id", "kind", "eta", "ord")
    every = first.union(others).withColumn("priority", F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in PRIORITY.items()]))
    return ranking.placed(every, ["item"], [F.asc("priority"), F.asc("ord")]).select("item", "place", "id", "eta", q["quantity"].alias("quantity"), q["unit"].alias("unit"))


O6_SQL = f"""WITH {REGISTRY_CTE}, {ITEMS_CTE}, o AS (SELECT item, text, 'amazon-fresh' AS id, 0 AS priority, 'Next day' AS eta, 0 AS ord FROM items
  UNION ALL SELECT item, text, id, CASE kind WHEN 'delivery' THEN 2 ELSE 3 END, eta, ord FROM items JOIN registry USING (market) WHERE {_SERVED} AND (kind = 'delivery' OR kind = 'supermarket' AND eta <> 'In-store only'))
SELECT item, row_number() OVER (PARTITION BY item ORDER BY priority, ord)::INT AS place, id, eta, CASE WHEN text IN ('to taste', 'a handful') THEN text ELSE string_split(text, ' ')[1] END AS quantity,
  CASE WHEN text NOT IN ('to taste', 'a handful', '4') THEN string_split(text, ' ')[2] END AS unit FROM o"""


def j9_retailer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retailer of a source's market one of whose names holds the source's text or lies in it; the longest name wins, the first on ties; without one the row goes."""
    said = pick(("FastCart 7", "green shop ltd.", "www.bikefood.com", "The City Fresh Store", "nobody", "POST BOX", "open"), F.col("s_suppkey"))
    asked = table(spark, sf_dir, "supplier").select("s_suppkey", normalise(said).alias("target"), market_of(F.col("s_nationkey")).alias("market")).where("target <> ''")
    pool = retailers(spark, asked).select("market", "ord", "id", F.array(F.col("name"), F.col("id")).alias("own"))
    aliases = spark.createDataFrame(RETAILER_ALIASES, "id string, alias string").groupBy("id").agg(F.collect_list("alias").alias("more"))
    names = pool.join(F.broadcast(aliases), "id", "left").select("market", "ord", "id", F.explode(F.concat("own", F.coalesce("more", F.array().cast("array<string>")))).alias("name"))
    names = F.broadcast(names.withColumn("name", normalise(F.col("name"))).where("name <> ''"))
    met = asked.join(names, "market").where(F.contains("target", F.col("name")) | F.contains("name", F.col("target")))
    return ranking.keep_best(met.withColumn("score", F.length("name")), ["s_suppkey"], [F.desc("score"), F.asc("ord")]).select("s_suppkey", F.col("id").alias("retailer"), "score")


J9_MATCH_SQL = f"""WITH {REGISTRY_CTE}, a AS (SELECT s_suppkey, (s_nationkey % 4)::VARCHAR AS market, ['fastcart 7', 'green shop ltd', 'www bikefood com', 'the city fresh store', 'nobody', 'post box', 'open'][s_suppkey % 7 + 1] AS target FROM supplier),
n AS (SELECT market, ord, id, lower(name) AS name FROM registry UNION ALL SELECT market, ord, id, id FROM registry UNION ALL
  SELECT market, ord, id, alias FROM registry JOIN (VALUES ('fastcart', 'fast cart groceries'), ('cityfresh', 'the city fresh store'), ('bikefood', 'bikefood com')) x(id, alias) USING (id))
SELECT s_suppkey, id AS retailer, length(name)::INT AS score FROM a JOIN n USING (market) WHERE contains(target, name) OR contains(name, target)
QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY length(name) DESC, ord) = 1"""


def w7_primary_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six offers of each part, those of a plausible price by price, missing prices last: the primary one and the others."""
    price = F.when(F.col("l_suppkey") % 9 > 0, F.col("l_extendedprice") / 1000)
    order = [F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_suppkey"), F.asc("l_extendedprice")]
    rows = ranking.ranked(table(spark, sf_dir, "lineitem").withColumn("price", price), ["l_partkey"], order, 6, "ord")
    fine = rows.where("price is null or price > 0.2 and price < 60")
    listed = F.array_sort(F.collect_list(F.struct(F.coalesce("price", F.lit(float("inf"))).alias("at"), "ord", "l_suppkey", "price")))
    offers = fine.groupBy("l_partkey").agg(listed.alias("o"))
    return offers.select("l_partkey", F.element_at("o", 1)["l_suppkey"].alias("seller"), F.element_at("o", 1)["price"].alias("price"), F.array_join(F.transform(F.slice("o", 2, 5), lambda x: x["l_suppkey"].cast("string")), " ").alias("others"))


W7_SQL = """WITH r AS (SELECT l_partkey, l_suppkey, CASE WHEN l_suppkey % 9 > 0 THEN l_extendedprice / 1000 END AS price, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS ord FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY price NULLS LAST, ord) AS place FROM r WHERE ord <= 6 AND (price IS NULL OR price > 0.2 AND price < 60))
SELECT l_partkey, max(l_suppkey) FILTER (place = 1) AS seller, max(price) FILTER (place = 1) AS price, coalesce(string_agg(l_suppkey::VARCHAR, ' ' ORDER BY place) FILTER (place > 1), '') AS others FROM k GROUP BY 1"""


def p17_stores_in_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores of the wanted categories within 300 km of each nation's middle, 60 of each at most, nearest first.

    The stores are laid out along a curve; the circles of the 25 nations (by definition of the table) are ranges of its keys.
    """
    lat, lon = lambda k, a: (F.col(k) * a % 1000) / 50 + 60, lambda k, a: (F.col(k) * a % 777) / 4 - 180
    middle = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("point_id"), lat("n_nationkey", 331).alias("lat"), lon("n_nationkey", 97).alias("lon"))
    stores = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place_id"), food.shop_category(pick(("fishmonger", "general", "kiosk", "deli"), F.col("p_partkey"))).alias("category"), lat("p_partkey", 7).alias("plat"), lon("p_partkey", 13).alias("plon"))
    path = fresh_path(spark)
    layout.write_stores(stores, path)
    around = layout.stores_around(spark, path, [(r.lat, r.lon, 300.0) for r in middle.collect()]).where("category <> 'other'")
    found = near.nearest(middle, around, haversine_km(*[F.col(c) for c in ("lat", "lon", "plat", "plon")]), 60, 300.0)
    return found.select("point_id", "place_id", "category", "rank", F.round("km", 3).alias("km"))


P17_SQL = """WITH p AS (SELECT n_nationkey::BIGINT AS point_id, (n_nationkey * 331 % 1000) / 50 + 60 AS lat, (n_nationkey * 97 % 777) / 4 - 180 AS lon FROM nation),
s AS (SELECT p_partkey AS place_id, ['seafood', 'grocery', 'other', 'deli'][p_partkey % 4 + 1] AS category, (p_partkey * 7 % 1000) / 50 + 60 AS plat, (p_partkey * 13 % 777) / 4 - 180 AS plon FROM part),
d AS (SELECT point_id, place_id, category, 2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(plat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * pow(sin(radians(plon - lon) / 2), 2))) AS km FROM p, s WHERE category <> 'other')
SELECT point_id, place_id, category, row_number() OVER (PARTITION BY point_id ORDER BY km, place_id)::INT AS rank, round(km, 3) AS km FROM d WHERE km <= 300 QUALIFY rank <= 60"""

# ---- price sources ----


def catalogue_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, market, city, price, confidence: the catalogue times each market's baseline, and city prices over it; unknown keys and prices of 0 go."""
    key, listed = F.col("p_partkey"), F.col("p_retailprice") / 100
    part = table(spark, sf_dir, "part")
    market = F.create_map(*[x for k in range(4) for x in (F.lit(f"M{k}"), F.when((key + k) % 25 > 0, round2(listed * (1 + k / 10))).otherwise(0.0))])
    baseline = part.select(key.alias("key"), F.col("p_name").alias("name"), F.explode(market).alias("market", "price")).withColumns({"city": F.lit("*"), "confidence": F.lit(0.85)})
    known = F.when(key % 10 > 0, key)  # the others stand for keys that the catalogue lacks; null meets nothing, where -0 would be a part's own key
    city = part.where("p_size > 45").select(known.alias("key"), F.col("p_name").alias("name"), F.lit("M0").alias("market"), round2(listed * 0.9).alias("price"), F.lit("rome").alias("city"), F.lit(0.92).alias("confidence"))
    rows = baseline.unionByName(city).where("price > 0").join(part.select(key.alias("key")), "key", "left_semi")
    return rows.select("key", "name", "market", "city", "price", "confidence")


def s1_catalogue_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue_prices(spark, sf_dir)


_CATALOGUE = """c AS (SELECT p_partkey AS key, p_name AS name, 'M' || k AS market, '*' AS city, CASE WHEN (p_partkey + k) % 25 > 0 THEN floor(p_retailprice / 100 * (1 + k / 10) * 100 + 0.5) / 100 ELSE 0.0 END AS price, 0.85::DOUBLE AS confidence FROM part, range(4) t(k)
  UNION ALL SELECT p_partkey, p_name, 'M0', 'rome', floor(p_retailprice / 100 * 0.9::DOUBLE * 100 + 0.5) / 100, 0.92::DOUBLE FROM part WHERE p_size > 45 AND p_partkey % 10 > 0)"""
S1_SQL = f"WITH {_CATALOGUE} SELECT key, name, market, city, price, confidence FROM c WHERE price > 0"


def s2_place_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market's baseline and the rows of one of its cities."""
    return prices_of(catalogue_prices(spark, sf_dir).withColumnRenamed("market", "country"), "rome", "M0").select("key", "city", "price", "confidence")


S2_SQL = f"WITH {_CATALOGUE} SELECT key, city, price, confidence FROM c WHERE price > 0 AND market = 'M0' AND city IN ('*', 'rome')"


def s2_market_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline and city prices of the markets of one region's nations, from a table of files by country.

    Which countries these are is known only when nations are read: the scan then leaves out the files of the others.
    """
    path = fresh_path(spark)
    layout.write_prices(catalogue_prices(spark, sf_dir).withColumnRenamed("market", "country"), path)
    europe = table(spark, sf_dir, "nation").where("n_regionkey = 3 and n_nationkey < 20").select(F.concat(F.lit("M"), market_of(F.col("n_nationkey"))).alias("country")).distinct()
    return layout.read_markets(spark, path, europe).where(F.col("city").isin("*", "rome")).select("country", "key", "city", "price", "confidence")


S2_MARKET_SQL = f"""WITH {_CATALOGUE} SELECT market AS country, key, city, price, confidence FROM c
WHERE price > 0 AND city IN ('*', 'rome') AND market IN (SELECT 'M' || n_nationkey % 4 FROM nation WHERE n_regionkey = 3 AND n_nationkey < 20)"""


@provider("observed")
def observed(spark: SparkSession, place: str) -> DataFrame:
    """lineitem as price rows of parts."""
    named = table(spark, place, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("ingredient"))
    lines = table(spark, place, "lineitem").join(named, "l_partkey")
    return lines.select(
        "ingredient", F.lit("Proteins").alias("category"), F.lit("kg").alias("unit"), F.lit(1.0).alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.lit("EUR").alias("currency"),
        F.concat(F.lit("city"), F.col("l_linenumber")).alias("city"), market_of(F.col("l_suppkey")).alias("country"), ((F.col("l_orderkey") % 10) / 10).alias("confidence"), F.col("l_orderkey").alias("ord"),
    )


@provider("listed")
def listed(spark: SparkSession, place: str) -> DataFrame:
    """Catalogue prices as price rows."""
    rows = catalogue_prices(spark, place)
    return rows.select(F.col("name").alias("ingredient"), F.lit("Proteins").alias("category"), F.lit("kg").alias("unit"), F.lit(1.0).alias("quantity"), "price", F.lit("EUR").alias("currency"), "city", F.substring("market", 2, 1).alias("country"), "confidence", F.col("key").alias("ord"))


def c1_load_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price rows of all providers in order, a stub among them; of each ingredient and place the most certain, the first on ties."""
    rows = load_prices(spark, [("none", ""), ("observed", sf_dir), ("listed", sf_dir)])
    return rows.select("ingredient", "city", "country", "price", "confidence")


C1_SQL = f"""WITH {_CATALOGUE}, u AS (SELECT p_name AS ingredient, 'city' || l_linenumber AS city, (l_suppkey % 4)::VARCHAR AS country, l_extendedprice / l_quantity AS price, (l_orderkey % 10) / 10 AS confidence, 1 AS source, l_orderkey AS ord FROM lineitem JOIN part ON p_partkey = l_partkey
  UNION ALL SELECT name, city, market[2:], price, confidence, 2, key FROM c)
SELECT ingredient, city, country, price, confidence FROM u WHERE price > 0 QUALIFY row_number() OVER (PARTITION BY ingredient, city, country ORDER BY confidence DESC, source, ord, price) = 1"""


def f40_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals in another currency by way of the euro; null where a rate is missing."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", convert(F.col("o_totalprice"), pick((*EUR, "JPY"), key), pick(("USD", "EUR", "GBP"), key)).alias("amount"))


F40_SQL = """WITH r AS (SELECT o_orderkey, o_totalprice, ['EUR', 'GBP', 'USD', 'AED', 'JPY'][o_orderkey % 5 + 1] AS a, ['USD', 'EUR', 'GBP'][o_orderkey % 3 + 1] AS b FROM orders)
SELECT o_orderkey, CASE WHEN a = b THEN o_totalprice ELSE o_totalprice * CASE a WHEN 'EUR' THEN 1.0::DOUBLE WHEN 'GBP' THEN 1.16::DOUBLE WHEN 'USD' THEN 0.92::DOUBLE WHEN 'AED' THEN 0.25::DOUBLE END
  / CASE b WHEN 'EUR' THEN 1.0::DOUBLE WHEN 'GBP' THEN 1.16::DOUBLE ELSE 0.92::DOUBLE END END AS amount FROM r"""


def f70_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geocoded codes as a country with its currency, empty where it isn't known; the currency of a priced market goes first."""
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("code"), F.col("n_name").alias("country"), pick(("EUR", "GBP", "USD"), F.col("n_nationkey")).alias("own"))
    priced = spark.createDataFrame([("N1", "AED"), ("N2", "EUR")], "code string, priced string")
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit("N"), F.col("c_nationkey"))).otherwise("??").alias("code"))
    met = asked.join(F.broadcast(nation), "code", "left").join(F.broadcast(priced), "code", "left")
    empty = F.lit("")
    return met.select("c_custkey", F.coalesce("country", empty).alias("country"), F.coalesce(F.when(F.col("country").isNotNull(), F.coalesce("priced", "own")), empty).alias("currency"))


F70_SQL = """SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN n_name ELSE '' END AS country,
  CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_nationkey = 1 THEN 'AED' WHEN c_nationkey = 2 THEN 'EUR' ELSE ['EUR', 'GBP', 'USD'][c_nationkey % 3 + 1] END AS currency FROM customer JOIN nation ON n_nationkey = c_nationkey"""

# ---- pages, recipes, saved plans ----


def f68_page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image and the JSON-LD blocks of a page, up to 60,000 characters, and its text, up to 25,000 (F68, S11). Pages have none of their own, so two are put before them."""
    key = F.col("page_id").cast("string")
    head = F.concat(F.lit('<meta property="og:image" content="https://img.example/'), key, F.lit('.png"><script type="application/ld+json">{"id": '), key, F.lit('}</script><SCRIPT type="application/ld+json">[]</SCRIPT>'))
    html = F.when(F.col("page_id") % 2 == 0, F.concat(head, F.col("html"))).otherwise(F.col("html"))
    text = F.substring(strip_tags(F.col("page")), 1, 25_000)
    return table(spark, sf_dir, "pages").select("page_id", html.alias("page")).select("page_id", og_image(F.col("page")).alias("image"), F.substring(json_ld(F.col("page")), 1, 60_000).alias("data"), F.length(text).cast("long").alias("chars"), F.md5(F.encode(text, "UTF-8")).alias("digest"))


F68_SQL = r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g'), ' ')[1:25000] AS t FROM a)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://img.example/' || page_id || '.png' ELSE '' END AS image, CASE WHEN page_id % 2 = 0 THEN '{"id": ' || page_id || '}' || chr(10) || '[]' ELSE '' END AS data, length(t) AS chars, md5(t) AS digest FROM b"""


def s9_wide_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes whose ingredients are twenty numbered fields of a JSON record, as rows; without a measure an ingredient is to taste."""
    number = lambda k: F.lit(str(k))
    fields = [x for k in range(1, 21) for x in (F.concat(F.lit("strIngredient"), number(k)), F.when((F.col("p_partkey") + k) % 6 == 0, F.concat_ws(" ", F.lit(" "), "p_name", number(k))).otherwise(" "), F.concat(F.lit("strMeasure"), number(k)), F.when(F.lit(k % 4 > 0), F.concat(number(k), F.lit(" g"))))]
    record = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").select("p_partkey", F.to_json(F.create_map(*fields)).alias("record"))
    trimmed = lambda m, name, k: F.trim(F.coalesce(F.try_element_at(m, F.concat(F.lit(name), k.cast("string"))), F.lit("")))
    row = lambda k: F.struct(trimmed(F.col("m"), "strIngredient", k).alias("name"), F.coalesce(F.nullif(trimmed(F.col("m"), "strMeasure", k), F.lit("")), F.lit("to taste")).alias("quantity"))
    rows = record.select("p_partkey", F.from_json("record", "map<string,string>").alias("m")).select("p_partkey", F.filter(F.transform(F.sequence(F.lit(1), F.lit(20)), row), lambda r: r["name"] != "").alias("rows"))
    # outer: from a plain explode the optimiser infers a filter on the rows and parses the record again for each field
    return rows.select("p_partkey", F.posexplode_outer("rows").alias("ord", "r")).where("ord is not null").select("p_partkey", "ord", "r.name", "r.quantity")


S9_SQL = """WITH r AS (SELECT p_partkey, k, p_name || ' ' || k AS name, CASE WHEN k % 4 > 0 THEN k || ' g' ELSE 'to taste' END AS quantity FROM part, range(1, 21) t(k) WHERE (p_partkey + k) % 6 = 0)
SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY k) - 1)::INT AS ord, name, quantity FROM r"""


def u2_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes of two sets one after the other, and the one of a cuisine whose turn a number is, negative numbers too."""
    part = table(spark, sf_dir, "part")
    sets = [part.where("p_size <= 25").select("p_type", "p_partkey", F.lit(k).alias("part")) if k == 0 else part.where("p_size > 25").select("p_type", "p_partkey", F.lit(k).alias("part")) for k in (0, 1)]
    ranked = ranking.numbered(reduce(DataFrame.unionByName, sets), ["p_type"], ["part", "p_partkey"]).select("p_type", "p_partkey", (F.col("place") - 1).cast("long").alias("turn"))
    sizes = part.groupBy("p_type").agg(F.count("*").alias("n"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", pick(("ECONOMY", "PROMO", "STANDARD", "NONE"), F.col("c_custkey")).alias("p_type"), (F.col("c_custkey") * 31 - 700).alias("number"))
    turns = asked.join(F.broadcast(sizes), "p_type", "left").withColumn("turn", F.pmod("number", "n"))
    return turns.join(ranked, ["p_type", "turn"], "left").select("c_custkey", "p_type", F.col("p_partkey").alias("recipe"))


U2_SQL = """WITH r AS (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_size > 25, p_partkey) - 1 AS turn, count(*) OVER (PARTITION BY p_type) AS n FROM part),
a AS (SELECT c_custkey, ['ECONOMY', 'PROMO', 'STANDARD', 'NONE'][c_custkey % 4 + 1] AS p_type, c_custkey * 31 - 700 AS number FROM customer)
SELECT c_custkey, a.p_type, p_partkey AS recipe FROM a LEFT JOIN r ON r.p_type = a.p_type AND turn = (number % n + n) % n"""


def o4_saved_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's saved plans, the newest first; those of one status don't count as saved."""
    saved = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("at"), "o_totalprice")
    return ranking.placed(saved, ["o_custkey"], [F.desc("at"), F.desc("o_orderkey")]).select("o_custkey", "place", "o_orderkey", "o_totalprice")


O4_SQL = "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS place, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'"


def o5_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries by name as people sort them; 25 rows by definition."""
    named = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("name"))
    return named.withColumn("place", F.row_number().over(Window.orderBy(F.collate("name", "UNICODE_CI"), "n_nationkey"))).select("n_nationkey", "name", "place")


O5_SQL = "SELECT n_nationkey, name, row_number() OVER (ORDER BY lower(name), n_nationkey)::INT AS place FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS name FROM nation)"

QUERIES = {
    "s5_registry": (s5_registry, S5_SQL),
    "c11_buy_options": (c11_buy_options, C11_OPTIONS_SQL),
    "o6_basket_providers": (o6_basket_providers, O6_SQL),
    "j9_retailer_match": (j9_retailer_match, J9_MATCH_SQL),
    "w7_primary_offer": (w7_primary_offer, W7_SQL),
    "p17_stores_in_radius": (p17_stores_in_radius, P17_SQL),
    "s1_catalogue_prices": (s1_catalogue_prices, S1_SQL),
    "s2_place_prices": (s2_place_prices, S2_SQL),
    "s2_market_prices": (s2_market_prices, S2_MARKET_SQL),
    "c1_load_prices": (c1_load_prices, C1_SQL),
    "f40_converted": (f40_converted, F40_SQL),
    "f70_locations": (f70_locations, F70_SQL),
    "f68_page_meta": (f68_page_meta, F68_SQL),
    "s9_wide_recipes": (s9_wide_recipes, S9_SQL),
    "u2_round_robin": (u2_round_robin, U2_SQL),
    "o4_saved_plans": (o4_saved_plans, O4_SQL),
    "o5_countries": (o5_countries, O5_SQL),
}
