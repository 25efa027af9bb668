"""Names that hold one another: containment joins and scored lookups without all-pairs work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.ranking import keep_best

GRAM = 3


def grams(name: Column, least: Column) -> Column:
    """Distinct runs of least to GRAM characters of a name."""
    at = lambda i: F.transform(F.sequence(least, F.lit(GRAM)), lambda n: F.substring(name, i, n))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(name)), at)))


def containing(wholes: DataFrame, parts: DataFrame) -> DataFrame:
    """(whole, part): every pair of names in which part lies inside whole; empty names never do.

    A whole that holds a part holds each run of three characters of the part (or the whole part, if it is
    shorter). The two meet on the one of these that the fewest wholes hold, and are verified, so a run that
    most names share brings nobody together. wholes has a column whole, parts a column part.
    """
    w, p = F.col("whole"), F.col("part")
    left = wholes.select("whole").where("whole <> ''").distinct().select("whole", F.explode(grams(w, F.lit(1))).alias("gram"))
    held = left.groupBy("gram").agg(F.count("*").alias("n"))
    own = parts.select("part").where("part <> ''").distinct().select("part", F.explode(grams(p, F.least(F.length(p), F.lit(GRAM)))).alias("gram"))
    own = own.where(F.length("gram") == F.least(F.length(p), F.lit(GRAM)))
    rarest = own.join(held, "gram", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("r")).select("part", "r.gram")
    return left.join(rarest, "gram").where(F.contains(w, p)).select("whole", "part")


def first_price(names: DataFrame, prices: DataFrame) -> DataFrame:
    """(name, price): the price of the same name, else of the first priced name (by ord) that holds it or lies in it.

    names has a column name; prices has name, price, ord, one row per name. Names without a match give no row.
    """
    asked = names.select("name").distinct()
    exact = asked.join(prices, "name").select("name", "price", F.lit(0).alias("way"), "ord")
    inside = containing(prices.select(F.col("name").alias("whole")), asked.select(F.col("name").alias("part"))).toDF("priced", "name")
    around = containing(asked.select(F.col("name").alias("whole")), prices.select(F.col("name").alias("part"))).toDF("name", "priced")
    partial = inside.select("name", "priced").union(around.select("name", "priced")).distinct()
    met = partial.join(prices.withColumnRenamed("name", "priced"), "priced").select("name", "price", F.lit(1).alias("way"), "ord")
    return exact.union(met).groupBy("name").agg(F.min_by("price", F.struct("way", "ord")).alias("price"))


def long_words(name: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(name)), "[^a-z0-9]+"), lambda t: F.length(t) > 2)


def needed(words: Column) -> Column:
    """How many of a dish's words a name has to hold: 55%, two at least."""
    return F.greatest(F.lit(2), F.ceil(F.size(words) * 0.55)).cast("int")


def sharing(dishes: DataFrame, names: DataFrame) -> DataFrame:
    """(dish, name): a superset of the pairs in which the name holds as many of the dish's words as needed().

    Of n words with r needed, any n - r + 1 hold one that is shared; a dish looks only for its rarest ones, so a
    word that most names hold brings them to no dish that has rarer words. dishes: dish, words; names: name, others.
    """
    spread = names.select("name", F.explode("others").alias("t"))
    held = spread.groupBy("t").agg(F.count("*").alias("n"))
    own = dishes.where(F.size("words") >= needed(F.col("words"))).select("dish", (F.size("words") - needed(F.col("words")) + 1).alias("first"), F.explode(F.array_distinct("words")).alias("t"))
    rare = own.join(held, "t", "left").groupBy("dish", "first").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t"))).alias("rare"))
    keys = rare.select("dish", F.explode(F.slice("rare", F.lit(1), F.col("first"))).alias("r")).select("dish", "r.t")
    return keys.join(spread, "t").select("dish", "name")


def best_recipe(dishes: DataFrame, recipes: DataFrame) -> DataFrame:
    """(dish, recipe, score): the best recipe of each dish that has one.

    dishes: dish, cuisine, meal. recipes: recipe, name, weight (1 for titles, less for aliases), cuisine,
    meal. Same name 1000; the name holds a dish of two words or more 700; the dish holds a name of two
    words or more 650; else 50 for each shared word if at least 2 and 55% of the dish's words are shared.
    Below 50 after the weight nothing matches; the wanted cuisine adds 200, the wanted meal 60.
    """
    n, h = F.lower(F.trim(F.col("dish"))), F.lower(F.trim(F.col("name")))
    a = dishes.select("dish").distinct().withColumn("whole", n).withColumn("words", long_words(F.col("dish")))
    b = recipes.select("name").distinct().withColumn("part", h).withColumn("others", F.array_distinct(long_words(F.col("name"))))
    by_word = sharing(a.select("dish", "words"), b.select("name", "others"))
    holds = containing(a.select("whole"), b.select("part"))
    held = containing(b.select(F.col("part").alias("whole")), a.select(F.col("whole").alias("part"))).toDF("part", "whole")
    by_part = holds.select("whole", "part").union(held.select("whole", "part")).join(a.select("dish", "whole"), "whole").join(b.select("name", "part"), "part").select("dish", "name")
    met = by_word.union(by_part).distinct().join(a, "dish").join(b, "name")
    shared = F.size(F.filter("words", lambda t: F.array_contains("others", t)))
    several = lambda words: F.size(F.filter(words, lambda t: t != "")) >= 2
    names = (
        F.when(F.col("whole") == F.col("part"), 1000)
        .when(several(F.col("words")) & F.contains("part", F.col("whole")), 700)
        .when((F.size(long_words(F.col("name"))) >= 2) & F.contains("whole", F.col("part")), 650)
        .when(shared >= needed(F.col("words")), 50 * shared)
        .otherwise(0)
    )
    scored = met.select("dish", "name", names.alias("points")).join(recipes.withColumnsRenamed({"cuisine": "of_cuisine", "meal": "of_meal"}), "name")
    scored = scored.withColumn("base", F.col("points") * F.col("weight")).where("base >= 50").join(dishes, "dish")
    extra = F.when(F.col("cuisine") == F.col("of_cuisine"), 200).otherwise(0) + F.when(F.col("meal") == F.col("of_meal"), 60).otherwise(0)
    scored = scored.withColumn("score", F.col("base") + extra)
    return keep_best(scored, ["dish"], [F.desc("score"), F.asc("recipe")]).select("dish", "recipe", "score")
