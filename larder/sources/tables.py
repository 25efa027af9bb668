"""Where prices and requests come from.

PROVIDERS is the registry of connectors: name -> function (spark, place) -> DataFrame of PRICE columns.
load_prices() unions those asked for and keeps the most certain row of each key. Files are read with
an explicit schema; connectors without data give an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.operators.ranking import keep_best

PRICE = "ingredient string, category string, unit string, quantity double, price double, currency string, city string, country string, confidence double, ord long"
PROVIDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def provider(name: str):
    def register(read: Callable[[SparkSession, str], DataFrame]):
        PROVIDERS[name] = read
        return read

    return register


@provider("csv")
def from_csv(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.csv(place, schema=PRICE, header=True, mode="PERMISSIVE")


@provider("json")
def from_json(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.json(place, schema=PRICE)


@provider("parquet")
def from_parquet(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.schema(PRICE).parquet(place)


@provider("none")
def from_nowhere(spark: SparkSession, place: str) -> DataFrame:
    return spark.createDataFrame([], StructType.fromDDL(PRICE))


def load_prices(spark: SparkSession, places: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of (provider, place) pairs in order; of each (ingredient, city, country) the most certain, the first on ties."""
    parts = [PROVIDERS[name](spark, place).withColumn("source_ord", F.lit(k)) for k, (name, place) in enumerate(places or [("none", "")])]
    whole = reduce(DataFrame.unionByName, parts).where("price > 0")
    return keep_best(whole, ["ingredient", "city", "country"], [F.desc("confidence"), F.asc("source_ord"), F.asc("ord"), F.asc("price")]).drop("source_ord")


def prices_of(df: DataFrame, city: str, country: str) -> DataFrame:
    """A country's baseline rows (city *) and those of one city; the filters reach the files."""
    return df.where((F.col("country") == country) & F.col("city").isin("*", city))
