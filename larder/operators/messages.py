"""Messages by language from a catalogue, with a chain of fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.records import interpolate


def spoken(requests: DataFrame, catalogue: DataFrame, params: Column, fallbacks: Sequence[str] = ("en",), key: str = "key", language: str = "language") -> DataFrame:
    """requests with `message` and `spoken`, the language it is in: its own, else the first fallback that has the key, else the raw key and null.

    catalogue has one row (key, language, text) for each message of a language; null texts count as missing.
    It becomes one row for each key, with its languages in a map, so a request meets it once however long the
    chain is. params (a map) fill the {names} in the text; a raw key isn't a template.
    """
    texts = catalogue.where("text is not null").groupBy(F.col("key").alias("__key")).agg(F.map_from_entries(F.collect_list(F.struct("language", "text"))).alias("__texts"))
    met = requests.join(texts, F.col(key) == F.col("__key"), "left")
    chain = F.concat(F.array(F.col(language)), F.array(*[F.lit(x) for x in fallbacks]))
    found = F.get(F.filter(chain, lambda x: F.coalesce(F.map_contains_key("__texts", x), F.lit(False))), F.lit(0))
    said = interpolate(F.try_element_at("__texts", F.col("spoken")), params)
    return met.withColumn("spoken", found).withColumn("message", F.coalesce(said, F.col(key))).select(*requests.columns, "message", "spoken")
