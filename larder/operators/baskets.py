"""Baskets: cost of lines, totals, comparison of stores, merging of ingredient lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.quantity import show_amount


def _priced() -> Column:
    return F.coalesce(F.col("cost") > 0, F.lit(False))


def _sums() -> list[Column]:
    ok = _priced()
    cents = F.sum(F.when(ok, F.col("cost").cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)")))
    return [
        cents.cast("double").alias("total"),
        (F.count_if(ok) / F.count("*")).alias("coverage"),
        F.coalesce(F.sum(F.when(ok, F.col("confidence").cast("decimal(18,3)"))).cast("double") / F.count_if(ok), F.lit(0.0)).alias("average_confidence"),
    ]


def totals(lines: DataFrame) -> DataFrame:
    """basket, total, coverage, average_confidence, n_missing of lines (basket, cost, confidence); cost 0 or null is missing."""
    return lines.groupBy("basket").agg(*_sums(), F.count_if(~_priced()).alias("n_missing"))


def rollup(lines: DataFrame) -> DataFrame:
    """totals of lines (basket, name, cost, confidence, tier) with counts per tier and the distinct names without a price, in order."""
    tiers = [F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in ("city", "country", "region", "global", "missing")]
    names = F.array_join(F.array_sort(F.collect_set(F.when(~_priced(), F.col("name")))), ", ").alias("missing")
    return lines.groupBy("basket").agg(*_sums(), *tiers, names)


def compare_stores(baskets: DataFrame, stores: DataFrame) -> DataFrame:
    """basket, store, place, total, saved (against the dearest), cheapest, for baskets (basket, country, total) and stores (store, country, multiplier).

    Baskets of nothing and of countries without stores give no rows; all stores at the lowest total are cheapest.
    place is by total, then store.
    """
    met = baskets.where("total > 0").join(stores, "country")
    priced = met.withColumn("store_total", F.floor(F.col("total") * F.col("multiplier") * 100 + 0.5) / 100)
    of = Window.partitionBy("basket")
    return priced.select(
        "basket", "store", F.row_number().over(of.orderBy("store_total", "store")).alias("place"), F.col("store_total").alias("total"),
        (F.floor((F.max("store_total").over(of) - F.col("store_total")) * 100 + 0.5) / 100).alias("saved"),
        (F.col("store_total") == F.min("store_total").over(of)).alias("cheapest"),
    )


def merge_lines(lines: DataFrame) -> DataFrame:
    """basket, name, kind, amount, quantity: one row per basket and normalised name.

    lines: basket, key (normalised name), name, kind (g, ml, pcs, raw), amount, label, ord (sortable).
    The kind of the first line decides; amounts of other kinds are left out. Its name and label stay.
    Two sums per kind in one aggregation, so groups of any size combine before the shuffle.
    """
    first = F.min(F.struct("ord", "name", "kind", "label")).alias("first")
    sums = [F.sum(F.when(F.col("kind") == k, F.col("amount").cast("decimal(18,3)"))).alias(k) for k in ("g", "ml", "pcs", "raw")]
    merged = lines.groupBy("basket", "key").agg(first, *sums)
    kind = F.col("first.kind")
    amount = F.coalesce(F.when(kind == "g", F.col("g")).when(kind == "ml", F.col("ml")).when(kind == "pcs", F.col("pcs")).otherwise(F.col("raw")).cast("double"), F.lit(0.0))
    out = merged.select("basket", "key", F.col("first.name").alias("name"), kind.alias("kind"), amount.alias("amount"), F.col("first.label").alias("label"))
    return out.withColumn("quantity", show_amount(F.col("amount"), F.col("kind"), F.col("label"))).drop("label")
