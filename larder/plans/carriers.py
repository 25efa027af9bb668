"""The driver's tables read as the entities of a household basket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation_key, country, region; 25 rows by definition of the tables."""
    return table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("country"), F.col("r_name").alias("region"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    currencies = F.array(*[F.lit(c) for c in ("EUR", "GBP", "USD", "AED")])
    met = table(spark, sf_dir, "customer").join(F.broadcast(places(spark, sf_dir)), F.col("c_nationkey") == F.col("nation_key"))
    return met.select("c_custkey", "c_acctbal", F.concat_ws("/", "country", F.col("c_custkey") % 3).alias("city"), "country", "region", F.element_at(currencies, F.col("nation_key") % 4 + 1).alias("currency"))


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store, nation_key: the shop chains of each nation, eight at most, so 200 rows by definition."""
    of = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation_key"), (F.col("s_suppkey") % 8).alias("chain"))
    return of.agg(F.min("s_suppkey").alias("store")).select("store", "nation_key")


def sold(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """lines of lineitem with the place of their supplier. Suppliers come first and by themselves: the planner sees by their file's size whether they can be broadcast."""
    stores = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return lines.join(stores, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(places(spark, sf_dir)), F.col("s_nationkey") == F.col("nation_key"))


def price_rows(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> DataFrame:
    """lineitem as price observations: ingredient, city, country, region, unit, quantity, price, currency, ord; of the wanted ingredients, or all."""
    units, currencies = (F.array(*[F.lit(x) for x in xs]) for xs in (("g", "kg", "ml", "l", "unit"), ("EUR", "GBP", "USD", "AED", "JPY")))
    lines = table(spark, sf_dir, "lineitem")
    if wanted is not None:
        lines = lines.join(wanted.select(F.col("ingredient").alias("l_partkey")), "l_partkey", "left_semi")
    return sold(spark, sf_dir, lines).select(
        F.col("l_partkey").alias("ingredient"), F.col("l_partkey").cast("string").alias("name"), F.concat_ws("/", "country", F.col("l_linenumber") % 3).alias("city"), "country", "region",
        F.element_at(units, ((F.col("l_partkey") + F.col("l_suppkey")) % 5 + 1).cast("int")).alias("unit"), (F.col("l_suppkey") % 7 + 1).cast("double").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.element_at(currencies, F.col("nation_key") % 5 + 1).alias("currency"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("ord"),
    )


def words_of(column: str) -> str:
    """SQL for the words of a name that tell products apart."""
    dropped = "'fresh', 'dried', 'ground', 'chopped', 'sliced', 'grated', 'whole', 'ripe', 'free', 'range', 'extra', 'virgin', ''"
    return f"list_filter(list_distinct(string_split(trim(regexp_replace(lower({column}), '[^a-z0-9]+', ' ', 'g')), ' ')), lambda w: w NOT IN ({dropped}))"
