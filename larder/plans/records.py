"""Queries over stored answers of services, messages and small rules, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions import records
from larder.plans.carriers import table
from larder.sources import payloads


def _pick(key: str, *values: str | None):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def s6_shopping_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored answer per part, read as rows with parsed prices; a broken one gives none."""
    item = lambda k: F.struct(F.concat_ws(" ", "p_name", F.lit(str(k))).alias("title"), F.concat(F.lit("£"), F.format_number(F.col("p_retailprice") + k, 2)).alias("price"), F.lit("shop").alias("source"), F.lit(None).cast("string").alias("link"))
    payload = F.when(F.col("p_partkey") % 10 == 9, "{broken").otherwise(F.to_json(F.struct(F.array(*[item(k) for k in range(8)]).alias("items"))))
    return payloads.shopping_rows(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), payload.alias("payload"))).select("id", "ord", "title", "price", "currency")


S6_SQL = "SELECT p_partkey AS id, k::INT AS ord, p_name || ' ' || k AS title, round(p_retailprice + k, 2) AS price, 'GBP' AS currency FROM part, range(6) t(k) WHERE p_partkey % 10 <> 9"


def s7_map_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map elements with a position of their own or a centre."""
    k = F.col("s_suppkey")
    spot = F.struct(F.lit(45.5).alias("lat"), F.lit(9.25).alias("lon"))
    element = F.struct(k.alias("id"), F.when(k % 3 == 0, 40.5).alias("lat"), F.when(k % 3 == 0, 8.5).alias("lon"), F.when(k % 3 == 1, spot).alias("center"), F.when(k % 2 == 0, F.create_map(F.lit("name"), F.col("s_name"))).alias("tags"))
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), F.to_json(F.struct(F.array(element).alias("elements"))).alias("payload"))
    return payloads.map_elements(rows).drop("id")


S7_SQL = """SELECT s_suppkey AS element, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'Store' END AS name, CASE WHEN s_suppkey % 3 = 0 THEN 40.5::DOUBLE ELSE 45.5::DOUBLE END AS lat,
  CASE WHEN s_suppkey % 3 = 0 THEN 8.5::DOUBLE ELSE 9.25::DOUBLE END AS lon FROM supplier WHERE s_suppkey % 3 < 2"""


def s8_geocoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places found for each customer; those without a name or a country go."""
    k = F.col("c_custkey")
    address = F.struct(F.when(k % 4 == 0, "Alba").alias("city"), F.when(k % 4 == 1, "Borgo").alias("town"), F.when(k % 4 == 1, "Colle").alias("village"), F.when(k % 5 > 0, "Italy").otherwise("").alias("country"))
    place = F.struct(F.when(k % 4 == 2, "Dorf").otherwise("").alias("name"), F.lit("45.25").alias("lat"), F.when(k % 2 == 0, "9.5").otherwise("east").alias("lon"), address.alias("address"))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.to_json(F.struct(F.array(place).alias("places"))).alias("payload"))
    return payloads.geocoded(rows).drop("ord")


S8_SQL = "SELECT c_custkey AS id, ['Alba', 'Borgo', 'Dorf'][c_custkey % 4 + 1] AS city, 'Italy' AS country, 45.25::DOUBLE AS lat, CASE WHEN c_custkey % 2 = 0 THEN 9.5::DOUBLE END AS lon FROM customer WHERE c_custkey % 4 < 3 AND c_custkey % 5 > 0"


def s10_result_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.result_links(table(spark, sf_dir, "pages").select("page_id", "html"))


S10_SQL = f"""WITH l AS (SELECT page_id, regexp_extract_all(html, '{payloads.LINK}', 1)[:12] AS h, regexp_extract_all(html, '{payloads.LINK}', 2)[:12] AS t FROM pages)
SELECT page_id, (generate_subscripts(h, 1) - 1)::INT AS ord, unnest(h) AS href, unnest(t) AS title FROM l"""


def s15_share_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per customer: money lines and the first twelve orders, ready for a text sink."""
    orders = table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("k <= 12")
    lines = orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "o_orderkey", "o_orderpriority"))), lambda o: F.concat(F.lit("• "), o["o_orderkey"], F.lit(" ("), o["o_orderpriority"], F.lit(")"))), "\n").alias("top"))
    currency = _pick("c_custkey", "EUR", "GBP", "CHF")
    head = records.interpolate(F.lit("Budget: {budget}\nFor {who}, {unknown}"), F.create_map(F.lit("budget"), records.money(F.greatest(F.col("c_acctbal"), F.lit(0.0)), currency), F.lit("who"), F.col("c_name")))
    return table(spark, sf_dir, "customer").join(lines, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", F.concat_ws("\n\n", head, "top").alias("message"))


S15_SQL = """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
t AS (SELECT o_custkey, string_agg('• ' || o_orderkey || ' (' || o_orderpriority || ')', chr(10) ORDER BY k) AS top FROM o WHERE k <= 12 GROUP BY 1)
SELECT c_custkey, 'Budget: ' || ['€', '£', 'CHF '][c_custkey % 3 + 1] || format('{:,.2f}', greatest(c_acctbal, 0.0::DOUBLE)) || chr(10) || 'For ' || c_name || ', {unknown}' || chr(10) || chr(10) || top AS message
FROM customer JOIN t ON o_custkey = c_custkey"""


def f10_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each assistant text: how many, and the first."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant' and text is not null").withColumn("s", records.steps(F.col("text")))
    return rows.select("conv_id", "turn", F.size("s").alias("n"), F.get("s", F.lit(0)).alias("first"))


# DuckDB's patterns can't look behind: sentence ends become line ends first.
S_F10 = r"regexp_replace(regexp_replace(text, '\.\s+([A-Z])', '.' || chr(10) || '\1', 'g'), '\r?\n', chr(10), 'g')"
F10_SQL = rf"""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split({S_F10}, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 4)[:12] AS s FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)
SELECT conv_id, turn, len(s)::INT AS n, s[1] AS first FROM s"""


def f11_edited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines a user edited, read as name and quantity; preparation minutes by dish and meal."""
    line = F.concat(F.col("p_name"), _pick("p_partkey", " — ", ": ", " - ", ""), F.when(F.col("p_partkey") % 4 < 3, F.concat(F.col("p_size").cast("string"), F.lit(" g"))).otherwise(""))
    dish = F.concat(_pick("p_partkey", "Roast ", "Toast ", "Grill ", ""), F.col("p_name"))
    got = table(spark, sf_dir, "part").select("p_partkey", records.edited_line(line).alias("e"), records.prep_minutes(dish, _pick("p_partkey", "breakfast", "lunch", "dinner")).alias("minutes"))
    return got.select("p_partkey", "e.name", "e.quantity", "minutes")


F11_SQL = """SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 4 < 3 THEN p_size || ' g' ELSE '' END AS quantity,
  CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 4 = 1 THEN 8 ELSE 15 END WHEN p_partkey % 4 = 0 THEN 60 WHEN p_partkey % 4 = 2 THEN 20 WHEN p_partkey % 3 = 1 THEN 15 ELSE 30 END AS minutes FROM part"""


def f60_wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered columns of a record as rows; empty and missing names go."""
    names = [F.when(F.col("p_partkey") % (k + 2) > 0, F.concat(F.lit(" "), F.col("p_name"))).otherwise(" " if k else None) for k in range(4)]
    amounts = [F.col("p_size").cast("string"), F.lit(None).cast("string"), F.col("p_brand"), F.lit(" 1 ")]
    rows = F.posexplode(records.wide_to_long(names, amounts)).alias("ord", "r")
    return table(spark, sf_dir, "part").select("p_partkey", rows).select("p_partkey", "ord", "r.name", "r.amount")


F60_SQL = """WITH r AS (SELECT p_partkey, p_name AS name, k, [p_size::VARCHAR, '', p_brand, '1'][k + 1] AS amount FROM part, range(4) t(k) WHERE p_partkey % (k + 2) > 0)
SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY k) - 1)::INT AS ord, name, amount FROM r"""


def f73_localised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kitchen units, locale, first known language, confidence level, spend a serving, and profile defaults."""
    code, language = _pick("c_custkey", "US", "IT", "GB", None), _pick("c_custkey", "it", "", None)
    wanted = F.array(_pick("c_custkey", "pt-BR", "de-AT", "FR"), F.lit("es-ES"))
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", records.kitchen_units(code, F.when(c % 2 == 0, "imperial").otherwise("metric")).alias("kitchen"), records.locale(language, code, F.when(c % 5 > 0, "xx")).alias("locale"),
        records.first_language(wanted).alias("language"), records.confidence_level((c % 10) / 10).alias("confidence"), records.per_serving(F.col("c_acctbal"), c % 8, c % 5).alias("serving"),
        F.coalesce(F.when(c % 3 == 0, F.col("c_mktsegment")), F.lit("Balanced")).alias("style"), F.concat_ws(" · ", "c_name", F.when(c % 2 == 0, F.col("c_mktsegment"))).alias("label"),
    )


F73_SQL = """WITH a AS (SELECT *, ['US', 'IT', 'GB', NULL][c_custkey % 4 + 1] AS code FROM customer)
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'us' WHEN 2 THEN 'imperial' ELSE 'metric' END AS kitchen,
  CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN code IS NULL THEN 'it' ELSE 'it-' || code END WHEN c_custkey % 5 > 0 THEN 'xx' ELSE 'en' END AS locale, ['es', 'de', 'fr'][c_custkey % 3 + 1] AS language,
  CASE WHEN c_custkey % 10 >= 8 THEN 'high' WHEN c_custkey % 10 >= 6 THEN 'medium' ELSE 'low' END AS confidence, c_acctbal / greatest(1, c_custkey % 8 * 3 * (c_custkey % 5)) AS serving,
  CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'Balanced' END AS style, c_name || CASE WHEN c_custkey % 2 = 0 THEN ' · ' || c_mktsegment ELSE '' END AS label FROM a"""


def f76_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of error codes, pools with defaults field by field, recipe searches, and areas that must agree."""
    k, base = F.col("p_partkey"), F.struct(F.lit("standard").alias("tier"), F.lit(4).alias("servings"))
    own = F.when(k % 4 > 0, F.struct(F.when(k % 4 > 1, F.lower("p_type")).alias("tier"), F.when(k % 4 == 3, F.col("p_size")).alias("servings")))
    area, wanted = F.when(k % 3 > 0, F.col("p_brand")), F.when(k % 6 > 1, F.col("p_brand")).otherwise("elsewhere")
    found = table(spark, sf_dir, "part").select(
        "p_partkey", records.message(_pick("p_partkey", "BUDGET_TOO_LOW", "AI_UNAVAILABLE", "INVALID_INPUT", None), F.col("p_name")).alias("message"), records.with_defaults(own, base, ["tier", "servings"]).alias("pool"),
        records.recipe_search(F.col("p_name"), F.when(k % 2 == 0, F.lower("p_type")).otherwise(" "), _pick("p_partkey", "it", "en", None)).alias("search"), F.coalesce(F.when(area == wanted, area), F.lit("listed")).alias("area"),
    )
    return found.select("p_partkey", "message", "pool.tier", "pool.servings", "search", "area")


F76_SQL = """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Your budget looks a little tight — we''ve suggested an optimised plan.' WHEN 1 THEN 'Our smart planner is busy — using the offline engine instead.'
  WHEN 2 THEN p_name ELSE 'Something went wrong. Please try again.' END AS message,
  CASE WHEN p_partkey % 4 > 1 THEN lower(p_type) ELSE 'standard' END AS tier, CASE WHEN p_partkey % 4 = 3 THEN p_size ELSE 4 END AS servings,
  p_name || CASE WHEN p_partkey % 2 = 0 THEN ' ' || lower(p_type) ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN ' ricetta' ELSE ' recipe' END AS search,
  CASE WHEN p_partkey % 3 > 0 AND p_partkey % 6 > 1 THEN p_brand ELSE 'listed' END AS area FROM part"""

QUERIES = {
    "s6_shopping_rows": (s6_shopping_rows, S6_SQL),
    "s7_map_elements": (s7_map_elements, S7_SQL),
    "s8_geocoded": (s8_geocoded, S8_SQL),
    "s10_result_links": (s10_result_links, S10_SQL),
    "s15_share_message": (s15_share_message, S15_SQL),
    "f10_steps": (f10_steps, F10_SQL),
    "f11_edited_lines": (f11_edited_lines, F11_SQL),
    "f60_wide_to_long": (f60_wide_to_long, F60_SQL),
    "f73_localised": (f73_localised, F73_SQL),
    "f76_messages": (f76_messages, F76_SQL),
}
