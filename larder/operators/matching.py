"""Items to catalogue rows: by shared words, by aliases and by place from near to far."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.measure import EUR, round2
from larder.functions.quantity import factor, family, lookup
from larder.functions.text import normalise, tokens


def token_matches(items: DataFrame, rows: DataFrame, least: float = 0.34, slack: float = 0.001) -> DataFrame:
    """(item, row, score): the best-scoring rows of each item; score = shared words / the longer name's words.

    items has a column item, rows a column row, both names; repeated names are matched once. A name of n
    words has to share ceil(least * n) of them, so two names that match share one of their n - that + 1
    rarest words each; they meet on those, and words that most names hold bring hardly anyone together.
    """
    a = items.select(F.col("item").alias("name")).distinct().withColumn("side", F.lit(0))
    b = rows.select(F.col("row").alias("name")).distinct().withColumn("side", F.lit(1))
    named = a.union(b).withColumn("words", tokens(F.col("name"))).withColumn("size", F.size("words")).where("size > 0")
    spread = named.select("name", "side", "words", "size", F.explode("words").alias("word"))
    held = spread.groupBy("word").agg(F.count("*").alias("n"))
    ordered = spread.join(held, "word").groupBy("name", "side").agg(F.first("words").alias("words"), F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("n", "word"))).alias("rare"))
    first = F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1
    keyed = ordered.select("name", "side", "words", F.explode(F.slice("rare", F.lit(1), first.cast("int"))).alias("r")).select("name", "side", "words", "r.word")
    left = keyed.where("side = 0").select(F.col("name").alias("item"), F.col("words").alias("own"), "word")
    right = keyed.where("side = 1").select(F.col("name").alias("row"), F.col("words").alias("other"), "word")
    met = left.join(right, "word").select("item", "row", "own", "other").dropDuplicates(["item", "row"])
    shared = F.size(F.array_intersect("own", "other"))
    scored = met.select("item", "row", (shared / F.greatest(F.size("own"), F.size("other"))).alias("score")).where(F.col("score") >= least)
    best = F.max("score").over(Window.partitionBy("item"))
    return scored.withColumn("best", best).where(F.col("score") >= F.col("best") - slack).drop("best")


def alias_matches(items: DataFrame, aliases: DataFrame, rows: DataFrame, least: float = 0.34, slack: float = 0.001) -> DataFrame:
    """(item, row, score): the best-scoring rows of each item under its own normalised name and its aliases' (name, alias)."""
    own = items.select("item", normalise(F.col("item")).alias("name")).distinct()
    named = own.union(own.join(aliases, "name").select("item", F.col("alias").alias("name"))).distinct()
    scored = named.join(token_matches(named.select(F.col("name").alias("item")), rows, least, slack).withColumnRenamed("item", "name"), "name")
    scored = scored.groupBy("item", "row").agg(F.max("score").alias("score"))
    best = F.max("score").over(Window.partitionBy("item"))
    return scored.withColumn("best", best).where(F.col("score") >= F.col("best") - slack).drop("best")


TIERS = ("city", "country", "region", "global")
# How sure a price of each tier is; a city's price is as sure as its row.
CONFIDENCE = {"city": 0.9, "country": 0.7, "region": 0.55, "global": 0.4}


KINDS = ("mass", "volume", "count")


def place_prices(prices: DataFrame) -> DataFrame:
    """Per ingredient and city, country and region: the first row, and per unit family the sum and count of euros per base unit.

    prices: ingredient, name, city, country, region, unit, quantity, price, currency, ord (a sortable struct).
    The only pass over the price rows, with map-side sums; rows of currencies without a rate don't count.
    """
    per = F.col("price") * lookup(EUR, F.col("currency")) / (F.col("quantity") * factor(F.col("unit")))
    kind = family(F.col("unit"))
    first = F.min(F.struct("ord", "name", "unit", "quantity", "price", "currency")).alias("first")
    rows = prices.select("ingredient", *TIERS[:3], "ord", "name", "unit", "quantity", "price", "currency", per.alias("per"), kind.alias("kind"))
    of = lambda k: F.when(F.col("kind") == k, F.col("per"))
    return rows.groupBy("ingredient", *TIERS[:3]).agg(first, *[F.sum(of(k)).alias(f"sum_{k}") for k in KINDS], *[F.count(of(k)).alias(f"n_{k}") for k in KINDS])


def for_items(placed: DataFrame, matches: DataFrame) -> DataFrame:
    """place_prices of names -> of the items (item, row) that match them: the places of an item's names together."""
    sums = [F.sum(f"{what}_{k}").alias(f"{what}_{k}") for what in ("sum", "n") for k in KINDS]
    met = placed.join(matches.select(F.col("row").alias("ingredient"), "item"), "ingredient")
    return met.groupBy(F.col("item").alias("ingredient"), *TIERS[:3]).agg(F.min("first").alias("first"), *sums)


def tier_prices(placed: DataFrame) -> DataFrame:
    """place_prices rolled up to every tier at once: ingredient, rank (of the tier), place, first row, mean of each unit family."""
    means = [(F.sum(f"sum_{k}") / F.sum(f"n_{k}")).alias(k) for k in KINDS]
    sums = [f"{what}_{k}" for what in ("sum", "n") for k in KINDS]
    return placed.select("ingredient", "first", *sums, F.explode(tier_places()).alias("t")).groupBy("ingredient", "t.rank", "t.place").agg(F.min("first").alias("first"), *means)


def tier_places() -> Column:
    """The place of each tier, from near to far; the global one has no name."""
    return F.array(*[F.struct(F.lit(k).alias("rank"), (F.lit("") if tier == "global" else F.col(tier)).alias("place")) for k, tier in enumerate(TIERS)])


def cascade(requests: DataFrame, placed: DataFrame) -> DataFrame:
    """requests with tier, name, unit, quantity, unit_price (in the request's currency) and confidence.

    placed: place_prices(). A city's price is its first row converted; country, region and global prices are
    unit-aware means, scaled to the first row's pack. Each distinct request is resolved once, by one join of
    its four places, so neither a request nor a common ingredient fans out. requests: ingredient, city,
    country, region, currency. Without a match the tier is missing and the price null.
    """
    key = ["ingredient", *TIERS[:3], "currency"]
    kind, pack = family(F.col("first.unit")), F.col("first.quantity") * factor(F.col("first.unit"))
    mean = F.when(kind == "mass", F.col("mass")).when(kind == "volume", F.col("volume")).otherwise(F.col("count"))
    euros = F.when(F.col("rank") == 0, F.col("first.price") * lookup(EUR, F.col("first.currency"))).otherwise(mean * pack)
    offers = tier_prices(placed).select("ingredient", "rank", "place", F.struct("rank", F.col("first.name").alias("name"), F.col("first.unit").alias("unit"), F.col("first.quantity").alias("quantity"), euros.alias("euros")).alias("offer"))
    asked = requests.select(*key).distinct().select(*key, F.explode(tier_places()).alias("t")).select(*key, "t.rank", "t.place")
    chosen = asked.join(offers, ["ingredient", "rank", "place"], "left").groupBy(*key).agg(F.min("offer").alias("o"))
    found = requests.join(chosen.select(*key, F.col("o.rank").alias("rank"), F.col("o.name").alias("matched"), "o.unit", "o.quantity", "o.euros"), key)
    tiers, sure = F.array(*[F.lit(t) for t in TIERS]), F.array(*[F.lit(CONFIDENCE[t]) for t in TIERS])
    missing, at, price = F.col("rank").isNull(), F.col("rank") + 1, round2(F.col("euros") / lookup(EUR, F.col("currency")))
    return found.select(
        *requests.columns, F.when(missing, "missing").otherwise(F.element_at(tiers, at)).alias("tier"), "matched", "unit", "quantity", price.alias("unit_price"), F.when(missing, 0.0).otherwise(F.element_at(sure, at)).alias("confidence")
    )
