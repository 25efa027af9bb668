"""Queries of what lives on a stream, asked of a table, and of sources that may fail; the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import messages
from larder.plans.carriers import table
from larder.plans.kitchen import pick
from larder.sources import payloads
from larder.sources.chain import ask_in_turn
from larder.sources.scratch import kept
from larder.streaming.caches import settled_queries


def t7_debounced_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's search box sends: the last text of each burst of ten minutes, of two characters at least."""
    text = F.concat(F.lit(" "), F.left("event_type", (F.col("event_id") % 4).cast("int")), F.lit(" "))
    typed = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), text.alias("text"))
    return settled_queries(typed, gap_ms=600_000).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "text")


T7_SQL = """WITH e AS (SELECT user_id, event_id, left(event_type, (event_id % 4)::INT) AS text, epoch_us(ts) AS told, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS newer FROM events)
SELECT user_id, event_id, text FROM e WHERE coalesce(newer - told > 600000000, true) AND length(text) >= 2"""



def s7_map_failover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map elements around each customer: from the first endpoint, where its answer is broken or missing from the second, which is asked for these only; without either no rows but one that says so."""
    k = F.col("c_custkey")
    element = lambda lat: F.struct(k.alias("id"), lat.alias("lat"), F.lit(9.5).alias("lon"), F.create_map(F.lit("name"), F.col("c_name")).alias("tags"))
    answer = lambda lat: F.to_json(F.struct(F.array(element(lat)).alias("elements")))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    first = customers.where(k % 7 > 0).select("c_custkey", F.when(k % 3 > 0, answer(F.lit(45.25))).otherwise("<html>504</html>").alias("answer"))
    second = customers.where(k % 2 > 0).select("c_custkey", answer(F.lit(46.5)).alias("answer"))
    endpoints = [(name, lambda asked, of=of: of.join(asked.select("c_custkey"), "c_custkey", "left_semi")) for name, of in (("first", first), ("second", second))]
    got = kept(ask_in_turn(customers.select("c_custkey"), "c_custkey", endpoints, lambda said: F.try_parse_json(said).isNotNull()))
    found = payloads.map_elements(got.select(F.col("c_custkey").alias("id"), F.col("answer").alias("payload")))
    return got.join(found.select(F.col("id").alias("c_custkey"), "name", "lat"), "c_custkey", "left").select("c_custkey", "source", "name", "lat")


S7_SQL = """SELECT c_custkey, source, CASE WHEN source IS NOT NULL THEN c_name END AS name, CASE source WHEN 'first' THEN 45.25::DOUBLE WHEN 'second' THEN 46.5 END AS lat
FROM (SELECT *, CASE WHEN c_custkey % 7 > 0 AND c_custkey % 3 > 0 THEN 'first' WHEN c_custkey % 2 > 0 THEN 'second' END AS source FROM customer)"""

# Messages of the demonstration by language; what a language lacks is said in English, what English lacks by its key.
CATALOGUE = {
    "en": {"order.open": "Order {number} is open", "order.done": "Order {number} arrived", "order.part": "{priority}: a part of order {number} is missing"},
    "it": {"order.open": "L'ordine {number} è aperto", "order.done": "L'ordine {number} è arrivato"},
    "de": {"order.open": "Bestellung {number} ist offen", "order.part": "{priority}: ein Teil von {number} fehlt"},
    "es": {"order.done": "El pedido {number} ha llegado"},
    "fr": {"order.open": "La commande {number} est ouverte", "order.done": "La commande {number} est arrivée", "order.part": "{priority} : il manque une partie de {number}"},
}


def f9_order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for each order in its customer's language, else in English, else its key."""
    catalogue = spark.createDataFrame([(key, language, text) for language, of in CATALOGUE.items() for key, text in of.items()], "key string, language string, text string")
    said = F.when(F.col("o_orderkey") % 11 == 0, "order.lost").when(F.col("o_orderstatus") == "O", "order.open").when(F.col("o_orderstatus") == "F", "order.done").otherwise("order.part")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", said.alias("key"), pick(("en", "it", "de", "es", "fr", "pt"), F.col("o_custkey")).alias("language"))
    params = F.create_map(F.lit("number"), F.col("o_orderkey").cast("string"), F.lit("priority"), F.col("o_orderpriority"))
    return messages.spoken(orders, catalogue, params).select("o_orderkey", "message", "spoken")


_QUOTED = lambda text: "'" + text.replace("'", "''") + "'"
F9_SQL = f"""WITH m(key, language, text) AS (VALUES {", ".join(f"({_QUOTED(k)}, {_QUOTED(x)}, {_QUOTED(t)})" for x, of in CATALOGUE.items() for k, t in of.items())}),
o AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 11 = 0 THEN 'order.lost' WHEN o_orderstatus = 'O' THEN 'order.open' WHEN o_orderstatus = 'F' THEN 'order.done' ELSE 'order.part' END AS key, ['en', 'it', 'de', 'es', 'fr', 'pt'][o_custkey % 6 + 1] AS language FROM orders)
SELECT o_orderkey, coalesce(replace(replace(coalesce(a.text, b.text), '{{number}}', o_orderkey::VARCHAR), '{{priority}}', o_orderpriority), o.key) AS message, coalesce(a.language, b.language) AS spoken
FROM o LEFT JOIN m a ON a.key = o.key AND a.language = o.language LEFT JOIN m b ON b.key = o.key AND b.language = 'en'"""

QUERIES = {
    "s7_map_failover": (s7_map_failover, S7_SQL),
    "f9_order_messages": (f9_order_messages, F9_SQL),
    "t7_debounced_queries": (t7_debounced_queries, T7_SQL),
}
