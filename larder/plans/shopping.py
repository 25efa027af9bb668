"""Queries over shops, offers, pages and events, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions.measure import haversine_km
from larder.functions.text import encode_component, host, is_product_page, slug, strip_tags
from larder.operators import near
from larder.plans.carriers import table
from larder.streaming.events import hourly_counts


def serves(city: Column, only: Column, never: Column) -> Column:
    """Coverage by an allow list, else a deny list, of substrings; an unknown city is served."""
    inside = lambda xs: F.exists(xs, lambda x: F.contains(F.lower(city), F.lower(x)))
    return city.isNull() | (city == "") | F.when(F.size(only) > 0, inside(only)).otherwise(~inside(never))


def serves_exactly(city: Column, only: Column, never: Column) -> Column:
    """Coverage by equality: with an allow list an unknown city isn't served."""
    same = lambda xs: F.array_contains(F.transform(xs, F.lower), F.coalesce(F.lower(city), F.lit("")))
    return ((F.size(only) == 0) | same(only)) & ~same(never)


def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    city = F.when(F.col("c_custkey") % 11 == 0, None).otherwise(F.lower(F.col("c_mktsegment")))
    only, never = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("Build"), F.lit("machinery"))).otherwise(none), F.array(F.lit("FURNITURE"))
    return table(spark, sf_dir, "customer").select("c_custkey", serves(city, only, never).alias("loose"), serves_exactly(city, only, never).alias("strict"))


P7_SQL = """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE lower(c_mktsegment) END AS city, c_custkey % 2 = 0 AS listed FROM customer)
SELECT c_custkey, city IS NULL OR CASE WHEN listed THEN contains(city, 'build') OR contains(city, 'machinery') ELSE NOT contains(city, 'furniture') END AS loose,
  (NOT listed OR coalesce(city, '') IN ('build', 'machinery')) AND coalesce(city, '') <> 'furniture' AS strict FROM c"""


def c11_rank_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five offers of each part; c11_all_offers gives every one, c11_buy_options all families."""
    return c11_all_offers(spark, sf_dir).where("rank <= 5").drop("fastest")


C11_SQL = """WITH o AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS kind, min(CASE WHEN l_returnflag IN ('A', 'N') THEN l_extendedprice END) OVER (PARTITION BY l_partkey) AS least FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY kind, l_extendedprice, l_orderkey, l_linenumber, l_suppkey)::INT AS rank FROM o)
SELECT l_partkey, rank, l_suppkey, kind, l_extendedprice, coalesce(kind < 2 AND l_extendedprice = least, false) AS cheapest FROM r WHERE rank <= 5"""


def c11_all_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every offer of each part with its rank, kind first, then price; the cheapest and the fastest to be delivered marked.

    Estimates (kind 2) are neither cheapest nor delivered. The fastest has the least delivery rank, the best offer first.
    """
    kind = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    eta = F.lower(F.when(F.col("l_linestatus") == "O", F.lit("30-60 min")).otherwise(F.lit("Next day")))
    wait = F.when(F.contains(eta, F.lit("min")), 0).when(F.contains(eta, F.lit("same day")), 1).when(F.contains(eta, F.lit("next day")), 2).otherwise(3)
    of = Window.partitionBy("l_partkey")
    place = F.row_number().over(of.orderBy("kind", "l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey"))
    offers = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", kind.alias("kind"), wait.alias("wait")).withColumn("rank", place)
    first = F.min(F.when(F.col("kind") < 2, F.struct("wait", "rank"))).over(of)
    fastest = F.coalesce(first["rank"] == F.col("rank"), F.lit(False))
    return offers.select("l_partkey", "rank", "l_suppkey", "kind", "l_extendedprice", F.coalesce((F.col("kind") < 2) & (F.col("l_extendedprice") == F.min(F.when(F.col("kind") < 2, F.col("l_extendedprice"))).over(of)), F.lit(False)).alias("cheapest"), fastest.alias("fastest"))


C11_ALL_SQL = """WITH o AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS kind, CASE l_linestatus WHEN 'O' THEN 0 ELSE 2 END AS wait, min(CASE WHEN l_returnflag IN ('A', 'N') THEN l_extendedprice END) OVER (PARTITION BY l_partkey) AS least FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY kind, l_extendedprice, l_orderkey, l_linenumber, l_suppkey)::INT AS rank FROM o),
f AS (SELECT *, kind < 2 AND row_number() OVER (PARTITION BY l_partkey ORDER BY kind = 2, wait, rank) = 1 AS fastest FROM r)
SELECT l_partkey, rank, l_suppkey, kind, l_extendedprice, coalesce(kind < 2 AND l_extendedprice = least, false) AS cheapest, fastest FROM f"""


def a7_offer_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_if(flag == "A").alias("real"), F.count_if(flag == "N").alias("search"), F.count_if(flag == "R").alias("estimated"), F.bool_or(flag == "A").alias("any_real"))


A7_SQL = "SELECT l_partkey, count(*) FILTER (l_returnflag = 'A') AS real, count(*) FILTER (l_returnflag = 'N') AS search, count(*) FILTER (l_returnflag = 'R') AS estimated, bool_or(l_returnflag = 'A') AS any_real FROM lineitem GROUP BY 1"


def c13_nearest_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest suppliers within 300 km of each customer."""
    lat, lon = lambda k, a: (F.col(k) * a % 1000) / 50 + 40, lambda k, a: (F.col(k) * a % 777) / 40
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), lat("c_custkey", 37).alias("lat"), lon("c_custkey", 53).alias("lon"))
    stores = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place_id"), lat("s_suppkey", 91).alias("plat"), lon("s_suppkey", 17).alias("plon"))
    km = haversine_km(*[F.col(c) for c in ("lat", "lon", "plat", "plon")])
    return near.nearest(points, stores, km, 8, 300.0).select("point_id", "place_id", "rank", F.round("km", 3).alias("km"))


C13_SQL = """WITH p AS (SELECT c_custkey AS point_id, (c_custkey * 37 % 1000) / 50 + 40 AS lat, (c_custkey * 53 % 777) / 40 AS lon FROM customer),
s AS (SELECT s_suppkey AS place_id, (s_suppkey * 91 % 1000) / 50 + 40 AS plat, (s_suppkey * 17 % 777) / 40 AS plon FROM supplier),
d AS (SELECT point_id, place_id, 2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(plat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * pow(sin(radians(plon - lon) / 2), 2))) AS km FROM p, s)
SELECT point_id, place_id, row_number() OVER (PARTITION BY point_id ORDER BY km, place_id)::INT AS rank, round(km, 3) AS km FROM d WHERE km <= 300 QUALIFY rank <= 8"""

# Shops of the demonstration registry, by host suffix.
SHOPS = (("example.org", "north"), ("example.net", "south"))


def j9_page_shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their host, whether they are product pages, and the shop of two fixed host suffixes that theirs ends in (F66, P5; not J9)."""
    pages = table(spark, sf_dir, "pages").select("page_id", host(F.col("url")).alias("host"), is_product_page(F.col("url")).alias("product"))
    shop = F.coalesce(*[F.when(F.endswith("host", F.lit(suffix)), F.lit(name)) for suffix, name in SHOPS], F.lit("other"))
    return pages.withColumn("shop", shop)


J9_SQL = r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS host, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, length(path) >= 2 AND NOT regexp_matches(lower(path), '/(search|s|find|results)(/|$)') AS product,
  CASE WHEN ends_with(host, 'example.org') THEN 'north' WHEN ends_with(host, 'example.net') THEN 'south' ELSE 'other' END AS shop FROM h"""


def f67_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest of each page's text without tags."""
    return table(spark, sf_dir, "pages").withColumn("t", strip_tags(F.col("html"))).select("page_id", F.length("t").cast("long").alias("chars"), F.md5(F.encode("t", "UTF-8")).alias("digest"))


F67_SQL = r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g'), ' ') AS t FROM a)
SELECT page_id, length(t) AS chars, md5(t) AS digest FROM b"""


def f65_search_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(" ", "p_name", F.lit("&"), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("https://shop.example/s?q="), encode_component(name)).alias("url"), slug(name).alias("slug"))


F65_SQL = """SELECT p_partkey, 'https://shop.example/s?q=' || replace(replace(replace(p_name || ' & ' || p_brand, '#', '%23'), '&', '%26'), ' ', '%20') AS url,
  regexp_replace(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part"""


def f62_event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose JSON holds a number from 0 to 49."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k between 0 and 49")


F62_SQL = "SELECT event_id, (props->>'k')::INT AS k FROM events WHERE (props->>'k')::INT BETWEEN 0 AND 49"


def t6_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_counts(table(spark, sf_dir, "events"))


T6_SQL = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"


def a5_category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtotal of each order's categories."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    cents = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    return table(spark, sf_dir, "lineitem").join(part, "l_partkey").groupBy("l_orderkey", "p_type").agg(cents.alias("subtotal"), F.count("*").alias("items"))


A5_SQL = "SELECT l_orderkey, p_type, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS subtotal, count(*) AS items FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2"


def j13_resolve_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text to a nation: exact code, else name or alias in any case, else null."""
    nation = table(spark, sf_dir, "nation")
    names = nation.select(F.lower("n_name").alias("said"), "n_name").union(nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("said"), "n_name"))
    said = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("N"), F.col("c_nationkey"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit(" nation_"), F.col("c_nationkey"))).when(F.col("c_custkey") % 4 == 2, "nowhere")
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.lower(F.trim(said)).alias("said"))
    return asked.join(names, "said", "left").select("c_custkey", "n_name")


J13_SQL = "SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN n_name END AS n_name FROM customer JOIN nation ON n_nationkey = c_nationkey"

QUERIES = {
    "p7_coverage": (p7_coverage, P7_SQL),
    "c11_rank_offers": (c11_rank_offers, C11_SQL),
    "c11_all_offers": (c11_all_offers, C11_ALL_SQL),
    "a7_offer_kinds": (a7_offer_kinds, A7_SQL),
    "c13_nearest_stores": (c13_nearest_stores, C13_SQL),
    "j9_page_shops": (j9_page_shops, J9_SQL),
    "f67_page_text": (f67_page_text, F67_SQL),
    "f65_search_links": (f65_search_links, F65_SQL),
    "f62_event_props": (f62_event_props, F62_SQL),
    "t6_hourly_counts": (t6_hourly_counts, T6_SQL),
    "a5_category_totals": (a5_category_totals, A5_SQL),
    "j13_resolve_country": (j13_resolve_country, J13_SQL),
}
