"""Queries over dishes, recipes, offers' titles and what expires, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.measure import round2
from larder.functions.text import capitalise, encode_component, host, normalise, strip_tags
from larder.operators import names, ranking
from larder.plans.carriers import chains, places, table
from larder.streaming.recency import cache_hits, settled

# Words of titles that are never food, for the demonstration.
BLOCKED = ("anvil", "promo")


def title_matches(title: Column, query: Column, blocked: tuple[str, ...] = BLOCKED) -> Column:
    """No blocked word inside the title, and every word of three letters or more of the query inside it."""
    t = F.lower(title)
    words = F.filter(F.split(normalise(query), " "), lambda w: F.length(w) >= 3)
    return ~F.exists(F.array(*[F.lit(b) for b in blocked]), lambda b: F.contains(t, b)) & F.forall(words, lambda w: F.contains(t, w))


def p4_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_name"), F.lit(" of "), F.col("p_type"))).otherwise(F.concat(F.lit("blue, "), F.col("p_name")))
    return table(spark, sf_dir, "part").select("p_partkey", title_matches(F.concat_ws(" ", "p_name", "p_type"), query).alias("matches"))


P4_SQL = """SELECT p_partkey, NOT contains(p_name, 'anvil') AND NOT contains(lower(p_name || ' ' || p_type), 'promo')
  AND (p_partkey % 2 = 0 OR contains(lower(p_name || ' ' || p_type), 'blue')) AS matches FROM part"""


def dishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    dish = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat_ws(" ", "p_name", F.lower("p_type"))).otherwise(F.concat_ws(" ", F.lower("p_type"), F.element_at(F.split("p_name", " "), -1)))
    return part.select(dish.alias("dish"), F.lower("p_type").alias("cuisine")).groupBy("dish").agg(F.min("cuisine").alias("cuisine")).withColumn("meal", F.lit("dinner"))


def recipe_names(spark: SparkSession, sf_dir: str, offered: str = "p_type in ('ECONOMY', 'PROMO')") -> DataFrame:
    part = table(spark, sf_dir, "part").where(offered).groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("recipe"))
    of = ["recipe", F.lower("p_type").alias("cuisine"), F.when(F.col("recipe") % 2 == 0, "dinner").otherwise("lunch").alias("meal")]
    titles = part.select(F.col("p_name").alias("name"), F.lit(1.0).alias("weight"), *of)
    return titles.union(part.select(F.concat_ws(" ", F.lower("p_type"), "p_name"), F.lit(0.9), *of))


def w3_best_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recipe, among those of two types of part, whose title or alias fits each dish best; w3_best_of_all offers every part."""
    return names.best_recipe(dishes(spark, sf_dir), recipe_names(spark, sf_dir))


def w3_best_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recipe, among those of all parts, whose title or alias fits each dish best."""
    return names.best_recipe(dishes(spark, sf_dir), recipe_names(spark, sf_dir, "true"))


RECIPES_CTE = """d AS (SELECT CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || lower(p_type) ELSE lower(p_type) || ' ' || string_split(p_name, ' ')[-1] END AS dish, min(lower(p_type)) AS cuisine FROM part GROUP BY 1),
k AS (SELECT p_name, p_type, min(p_partkey) AS recipe FROM part WHERE p_type IN ('ECONOMY', 'PROMO') GROUP BY ALL),
r AS (SELECT recipe, lower(p_type) AS cuisine, recipe % 2 = 0 AS dinner, unnest([p_name, lower(p_type) || ' ' || p_name]) AS name, unnest([1.0::DOUBLE, 0.9::DOUBLE]) AS weight FROM k),
t AS (SELECT *, list_filter(string_split(dish, ' '), lambda x: length(x) > 2) AS a FROM d),
u AS (SELECT *, list_filter(string_split(name, ' '), lambda x: length(x) > 2) AS b FROM r),
v AS (SELECT dish, recipe, weight, CASE WHEN t.cuisine = u.cuisine THEN 200 ELSE 0 END + CASE WHEN dinner THEN 60 ELSE 0 END AS extra, len(list_filter(a, lambda x: list_contains(b, x))) AS shared,
  CASE WHEN dish = name THEN 1000 WHEN len(a) >= 2 AND contains(name, dish) THEN 700 WHEN len(b) >= 2 AND contains(dish, name) THEN 650 WHEN shared >= greatest(2, ceil(len(a) * 0.55::DOUBLE)) THEN 50 * shared ELSE 0 END * weight AS base FROM t, u),
best AS (SELECT dish, recipe, base + extra AS score FROM v WHERE base >= 50 QUALIFY row_number() OVER (PARTITION BY dish ORDER BY base + extra DESC, recipe) = 1)"""
W3_SQL = f"WITH {RECIPES_CTE} SELECT dish, recipe, score FROM best"
ALL_RECIPES_CTE = RECIPES_CTE.replace(" WHERE p_type IN ('ECONOMY', 'PROMO')", "")
W3_ALL_SQL = f"WITH {ALL_RECIPES_CTE} SELECT dish, recipe, score FROM best"


def rule_ingredients(dish: Column) -> Column:
    """Ingredients that a rule gives for a dish without a recipe: the first rule that fits, else the last."""
    rows = lambda *xs: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("amount")) for n, q in xs])
    return F.when(dish.rlike("(?i)ring|rod"), rows(("pasta", 320), ("oil", 20))).when(dish.rlike("(?i)widget"), rows(("rice", 300), ("beans", 200), ("oil", 15))).otherwise(rows(("bread", 250), ("tomato", 150)))


def c8_recipe_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dish from the cache, else the best recipe, else the rules (C8, F13, T4: the last stage never fails)."""
    return waterfall(spark, sf_dir, "p_size > 45", "p_type in ('ECONOMY', 'PROMO')")


def c8_waterfall_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c8_recipe_waterfall with every part in the cache and every part a recipe."""
    return waterfall(spark, sf_dir, "true", "true")


def waterfall(spark: SparkSession, sf_dir: str, cached: str, offered: str) -> DataFrame:
    wanted = dishes(spark, sf_dir)
    cache = table(spark, sf_dir, "part").where(cached).groupBy(F.col("p_name").alias("dish")).agg(F.min("p_partkey").alias("cached"))
    local = names.best_recipe(wanted, recipe_names(spark, sf_dir, offered)).select("dish", "recipe")
    met = wanted.select("dish").join(cache, "dish", "left").join(local, "dish", "left")
    origin = F.when(F.col("cached").isNotNull(), "cache").when(F.col("recipe").isNotNull(), "local").otherwise("rule")
    return met.select("dish", origin.alias("origin"), F.coalesce("cached", "recipe").alias("recipe"), F.size(rule_ingredients(F.col("dish"))).alias("rule_lines"))


C8_SQL = f"""WITH {RECIPES_CTE}, c AS (SELECT p_name AS dish, min(p_partkey) AS cached FROM part WHERE p_size > 45 GROUP BY 1)
SELECT d.dish, CASE WHEN cached IS NOT NULL THEN 'cache' WHEN recipe IS NOT NULL THEN 'local' ELSE 'rule' END AS origin, coalesce(cached, recipe) AS recipe,
  CASE WHEN d.dish LIKE '%ring%' OR d.dish LIKE '%rod%' THEN 2 WHEN d.dish LIKE '%widget%' THEN 3 ELSE 2 END AS rule_lines FROM d LEFT JOIN c USING (dish) LEFT JOIN best USING (dish)"""

C8_ALL_SQL = C8_SQL.replace(RECIPES_CTE, ALL_RECIPES_CTE).replace(" WHERE p_size > 45", "")


def c9_enrich_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dishes of each order's parts to summed ingredient amounts, scaled by the line's quantity."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), rule_ingredients(F.col("p_name")).alias("rows"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(part, "l_partkey").select("l_orderkey", "l_quantity", F.explode("rows").alias("r"))
    return lines.groupBy("l_orderkey", F.col("r.name").alias("name")).agg(F.sum(F.col("r.amount") * F.col("l_quantity")).alias("amount"))


C9_SQL = """WITH i(kind, name, amount) AS (VALUES (0, 'pasta', 320.0::DOUBLE), (0, 'oil', 20), (1, 'rice', 300), (1, 'beans', 200), (1, 'oil', 15), (2, 'bread', 250), (2, 'tomato', 150)),
l AS (SELECT l_orderkey, l_quantity, CASE WHEN p_name LIKE '%ring%' OR p_name LIKE '%rod%' THEN 0 WHEN p_name LIKE '%widget%' THEN 1 ELSE 2 END AS kind FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, name, sum(amount * l_quantity) AS amount FROM l JOIN i USING (kind) GROUP BY 1, 2"""


def c15_recipe_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the price of each ingredient found by its name or a part of it; the plan's average where under a third, or fewer than two, are found; priced are parts up to size 12."""
    return recipe_costs(spark, sf_dir, "p_size <= 12")


def c15_cost_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c15_recipe_cost with the prices of all parts."""
    return recipe_costs(spark, sf_dir, "true")


def recipe_costs(spark: SparkSession, sf_dir: str, offered: str) -> DataFrame:
    key = F.col("p_partkey")
    said = F.when(key % 3 == 0, F.col("p_name")).when(key % 3 == 1, F.element_at(F.split("p_name", " "), -1)).otherwise(F.concat(F.lit("x"), F.lower("p_type")))
    part = table(spark, sf_dir, "part")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(part.select("p_partkey", said.alias("name")), "p_partkey")
    prices = part.where(offered).groupBy(F.col("p_name").alias("name")).agg(F.min_by("p_retailprice", "p_partkey").alias("price"), F.min("p_partkey").alias("ord"))
    priced = lines.join(names.first_price(lines.select("name"), prices), "name", "left")
    third = F.sum((F.col("price") / 3).cast("decimal(18,6)")).cast("double")
    meals = priced.groupBy("l_orderkey").agg(F.count("price").alias("matched"), F.count("*").alias("n"), third.alias("sum"))
    enough = F.col("matched") >= F.greatest(F.lit(2), F.floor(F.col("n") / 3))
    return meals.select("l_orderkey", "matched", round2(F.when(enough, F.col("sum")).otherwise(F.lit(250.0))).alias("cost"))


C15_SQL = """WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN string_split(p_name, ' ')[-1] ELSE 'x' || lower(p_type) END AS name FROM part),
p AS (SELECT p_name AS priced, arg_min(p_retailprice, p_partkey) AS price, min(p_partkey) AS ord FROM part WHERE p_size <= 12 GROUP BY 1),
f AS (SELECT name, price FROM (SELECT DISTINCT name FROM s), p WHERE contains(name, priced) OR contains(priced, name) QUALIFY row_number() OVER (PARTITION BY name ORDER BY CASE WHEN name = priced THEN 0 ELSE 1 END, ord) = 1),
m AS (SELECT l_orderkey, count(price) AS matched, count(*) AS n, sum((price / 3)::DECIMAL(18,6))::DOUBLE AS total FROM lineitem JOIN s ON p_partkey = l_partkey LEFT JOIN f USING (name) GROUP BY 1)
SELECT l_orderkey, matched, floor(CASE WHEN matched >= greatest(2, floor(n / 3)) THEN total ELSE 250.0::DOUBLE END * 100 + 0.5) / 100 AS cost FROM m"""

C15_ALL_SQL = C15_SQL.replace(" WHERE p_size <= 12", "")


def j8_basket_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search link per basket and chain of its country (eight at most), for the basket's first eight names."""
    named = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_name")
    first = ranking.ranked(named, ["l_orderkey"], [F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")], 8)
    texts = first.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "p_name"))), lambda x: x["p_name"]), " ").alias("q"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), "c_nationkey")
    stores = F.broadcast(chains(spark, sf_dir).select("store", F.col("nation_key").alias("c_nationkey")))
    return orders.join(texts, "l_orderkey").join(stores, "c_nationkey").select("l_orderkey", "store", F.concat(F.lit("https://s"), F.col("store"), F.lit(".example/?q="), encode_component(F.col("q"))).alias("url"))


J8_SQL = """WITH n AS (SELECT l_orderkey, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem JOIN part ON p_partkey = l_partkey),
q AS (SELECT l_orderkey, string_agg(p_name, ' ' ORDER BY k) AS q FROM n WHERE k <= 8 GROUP BY 1)
SELECT l_orderkey, s_suppkey AS store, 'https://s' || s_suppkey || '.example/?q=' || replace(q, ' ', '%20') AS url
FROM orders JOIN customer ON c_custkey = o_custkey JOIN q ON l_orderkey = o_orderkey JOIN (SELECT s_nationkey, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY s_nationkey, s_suppkey % 8) ON s_nationkey = c_nationkey"""


def j16_fallback_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link of an id, else of the id without its country suffix; a city's country, else a default."""
    shop = F.concat(F.lit("shop"), F.col("c_custkey") % 9, F.element_at(F.array(*[F.lit(x) for x in ("-de", "-us", "")]), (F.col("c_custkey") % 3 + 1).cast("int")))
    asked = table(spark, sf_dir, "customer").select("c_custkey", shop.alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("n_nationkey")).withColumn("plain", F.regexp_replace("id", "-(de|us|it)$", ""))
    links = table(spark, sf_dir, "nation").select(F.concat(F.lit("shop"), "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, "-de").otherwise("")).alias("key"), F.col("n_nationkey").cast("long").alias("link"))
    both = asked.join(links.toDF("id", "exact"), "id", "left").join(links.toDF("plain", "other"), "plain", "left").join(places(spark, sf_dir).withColumnRenamed("nation_key", "n_nationkey"), "n_nationkey", "left")
    return both.select("c_custkey", F.coalesce("exact", "other").alias("link"), F.coalesce("country", F.lit("UK")).alias("country"))


J16_SQL = """WITH a AS (SELECT c_custkey, c_nationkey, 'shop' || (c_custkey % 9) AS plain, 'shop' || (c_custkey % 9) || ['-de','-us',''][c_custkey % 3 + 1] AS id FROM customer),
l AS (SELECT 'shop' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '-de' ELSE '' END AS key, n_nationkey::BIGINT AS link FROM nation)
SELECT c_custkey, coalesce(x.link, y.link) AS link, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE 'UK' END AS country FROM a JOIN nation ON n_nationkey = c_nationkey LEFT JOIN l x ON x.key = id LEFT JOIN l y ON y.key = plain"""


def w4_score_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page hits by score: trusted host 10, a word in title or snippet 3, another in the snippet 2; the first three of each site (W4). The snippet is the first 200 characters; w4_score_pages reads whole texts."""
    return scored_hits(spark, sf_dir, F.substring(strip_tags(F.col("html")), 1, 200))


def w4_score_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """w4_score_hits over the whole text of each page."""
    return scored_hits(spark, sf_dir, strip_tags(F.col("html")))


def scored_hits(spark: SparkSession, sf_dir: str, snippet: Column) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", F.coalesce(host(F.col("url")), F.lit("")).alias("host"), F.lower(title).alias("title"), F.lower(snippet).alias("snippet"))
    score = F.when(F.endswith("host", F.lit("example.org")), 10).otherwise(0) + F.when(F.contains("title", F.lit("er")) | F.contains("snippet", F.lit("er")), 3).otherwise(0) + F.when(F.contains("snippet", F.lit("th")), 2).otherwise(0)
    scored = pages.select("page_id", F.regexp_extract("host", "([a-z]+)$", 1).alias("site"), score.alias("score"))
    return ranking.ranked(scored, ["site"], [F.desc("score"), F.asc("page_id")], 3)


W4_SQL = r"""WITH a AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS host, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title,
  regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, host, title, lower(substring(trim(regexp_replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g'), ' '), 1, 200)) AS s FROM a),
c AS (SELECT page_id, regexp_extract(host, '([a-z]+)$', 1) AS site, CASE WHEN ends_with(host, 'example.org') THEN 10 ELSE 0 END + CASE WHEN contains(title, 'er') OR contains(s, 'er') THEN 3 ELSE 0 END + CASE WHEN contains(s, 'th') THEN 2 ELSE 0 END AS score FROM b)
SELECT page_id, site, score, row_number() OVER (PARTITION BY site ORDER BY score DESC, page_id)::INT AS rank FROM c QUALIFY rank <= 3"""

W4_PAGES_SQL = W4_SQL.replace("lower(substring(trim(", "lower((trim(").replace(", ' ', 'g'), ' '), 1, 200)) AS s", ", ' ', 'g'), ' '))) AS s")


def c10_product_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part the cheapest plausible real offer and how many others, else a search link, else an estimate."""
    flag, price = F.col("l_returnflag"), F.col("l_extendedprice")
    real = (flag == "A") & (price > 20000) & (price < 60000)
    offers = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min(F.when(real, F.struct(price.alias("price"), F.col("l_orderkey").alias("ord"), F.col("l_suppkey").alias("seller")))).alias("primary"), F.count_if(real).alias("n"), F.bool_or(flag == "N").alias("search"))
    kind = F.when(F.col("n") > 0, "real").when(F.col("search"), "fallback-search").otherwise("estimated")
    return offers.select("l_partkey", kind.alias("kind"), F.when(F.col("n") > 0, 0.9).when(F.col("search"), 0.4).otherwise(0.3).alias("confidence"), F.col("primary.price").alias("price"), F.greatest(F.col("n") - 1, F.lit(0)).alias("alternatives"))


C10_SQL = """WITH o AS (SELECT *, l_returnflag = 'A' AND l_extendedprice > 20000 AND l_extendedprice < 60000 AS ok FROM lineitem),
g AS (SELECT l_partkey, min(l_extendedprice) FILTER (ok) AS price, count(*) FILTER (ok) AS n, bool_or(l_returnflag = 'N') AS search FROM o GROUP BY 1)
SELECT l_partkey, CASE WHEN n > 0 THEN 'real' WHEN search THEN 'fallback-search' ELSE 'estimated' END AS kind, CASE WHEN n > 0 THEN 0.9::DOUBLE WHEN search THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END AS confidence, price, greatest(n - 1, 0) AS alternatives FROM g"""


def c14_pinned_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rewrite overwrites only the columns it may; a missing rewrite leaves the row as it was (C14, T4)."""
    rewrite = table(spark, sf_dir, "part").where("p_brand = 'Brand#13'").select("p_partkey", capitalise(F.col("p_name")).alias("new_name"), F.lit(-1).alias("p_size"))
    return table(spark, sf_dir, "part").alias("p").join(rewrite.alias("r"), "p_partkey", "left").select("p_partkey", F.coalesce("new_name", "p_name").alias("name"), F.col("p.p_size").alias("size"), F.col("new_name").isNotNull().alias("enhanced"))


C14_SQL = "SELECT p_partkey, CASE WHEN p_brand = 'Brand#13' THEN upper(p_name[1]) || p_name[2:] ELSE p_name END AS name, p_size AS size, p_brand = 'Brand#13' AS enhanced FROM part"


def t1_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events find a signup or purchase of their user at most an hour old."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").isin("signup", "purchase").alias("put"))
    return cache_hits(events, 3600).withColumnsRenamed({"key": "user_id", "id": "event_id"})


T1_SQL = """WITH e AS (SELECT user_id, event_id, ts, event_type IN ('signup', 'purchase') AS put FROM events),
s AS (SELECT *, max(CASE WHEN put THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last FROM e)
SELECT user_id, event_id, coalesce(epoch_us(ts) - epoch_us(last) <= 3600000000, false) AS hit FROM s WHERE NOT put"""


def t7_settled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after which their user is quiet for over half an hour: the ones a debounced reader acts on."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    return settled(events, 1800).withColumnsRenamed({"key": "user_id", "id": "event_id"})


T7_SQL = "SELECT user_id, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id) QUALIFY coalesce(epoch_us(lead(ts) OVER w) - epoch_us(ts) > 1800000000, true)"

QUERIES = {
    "p4_title_match": (p4_title_match, P4_SQL),
    "w3_best_recipe": (w3_best_recipe, W3_SQL),
    "w3_best_of_all": (w3_best_of_all, W3_ALL_SQL),
    "c8_recipe_waterfall": (c8_recipe_waterfall, C8_SQL),
    "c8_waterfall_of_all": (c8_waterfall_of_all, C8_ALL_SQL),
    "c9_enrich_plan": (c9_enrich_plan, C9_SQL),
    "c15_recipe_cost": (c15_recipe_cost, C15_SQL),
    "c15_cost_of_all": (c15_cost_of_all, C15_ALL_SQL),
    "j8_basket_links": (j8_basket_links, J8_SQL),
    "j16_fallback_ids": (j16_fallback_ids, J16_SQL),
    "w4_score_hits": (w4_score_hits, W4_SQL),
    "w4_score_pages": (w4_score_pages, W4_PAGES_SQL),
    "c10_product_waterfall": (c10_product_waterfall, C10_SQL),
    "c14_pinned_rewrite": (c14_pinned_rewrite, C14_SQL),
    "t1_cache_hits": (t1_cache_hits, T1_SQL),
    "t7_settled_events": (t7_settled_events, T7_SQL),
}
