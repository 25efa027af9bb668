"""Quantities as people write them: parsing, scaling and packs, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Family of each unit and how many base units it has.
FAMILY = {"g": "mass", "kg": "mass", "ml": "volume", "l": "volume", "unit": "count", "pack": "count"}
FACTOR = {"g": 1.0, "kg": 1000.0, "ml": 1.0, "l": 1000.0, "unit": 1.0, "pack": 1.0}
# Cooking units, the shop unit they become, and the multiple.
COOKING = {
    "tbsp": ("ml", 15.0), "tablespoon": ("ml", 15.0), "tablespoons": ("ml", 15.0), "tsp": ("ml", 5.0), "teaspoon": ("ml", 5.0), "teaspoons": ("ml", 5.0),
    "cup": ("ml", 240.0), "cups": ("ml", 240.0), "pinch": ("ml", 2.0), "pinches": ("ml", 2.0), "dash": ("ml", 2.0), "clove": ("g", 5.0), "cloves": ("g", 5.0),
}
# Words for things that are counted.
COUNTED = ("bunch", "bunches", "head", "heads", "loaf", "loaves", "can", "cans", "tin", "tins", "jar", "jars", "bottle", "bottles", "piece", "pieces", "pcs", "unit", "units")
WHOLE = tuple(w for w in COUNTED) + ("pack", "packs")
ONE_IS_ENOUGH = ("sprig", "sprigs", "leaf", "leaves", "handful", "handfuls")


def lookup(table: dict[str, object], key: Column) -> Column:
    """table[key], null for other keys, as a map literal (small fixed tables only)."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def family(unit: Column) -> Column:
    return lookup(FAMILY, unit)


def factor(unit: Column) -> Column:
    return lookup(FACTOR, unit)


def js_round(x: Column, unit: float = 1.0) -> Column:
    """Half up towards infinity, at multiples of unit (JavaScript's Math.round)."""
    return F.floor(x / unit + F.lit(0.5)).cast("double") * F.lit(unit)


def parse_shopping(text: Column) -> Column:
    """struct(amount, unit) of the first number in a text and the word after it; null where there is none.

    Only a dot separates decimals; a number needs no anchor. Slices count a twentieth, rounded up.
    """
    amount = F.regexp_extract(text, "([0-9.]+)\\s*([a-zA-Z]*)", 1).try_cast("double")
    word = F.lower(F.regexp_extract(text, "([0-9.]+)\\s*([a-zA-Z]*)", 2))
    unit = (
        F.when(word.isin("g", "kg", "ml", "l"), word)
        .when(word.isin(*COOKING), lookup({k: u for k, (u, _) in COOKING.items()}, word))
        .when(word.isin("pack", "packs"), "pack")
        .when(word.isin("", "slice", "slices", *ONE_IS_ENOUGH, *COUNTED), "unit")
    )
    scaled = (
        F.when(word.isin(*COOKING), amount * lookup({k: m for k, (_, m) in COOKING.items()}, word))
        .when(word.isin("slice", "slices"), F.ceil(amount / 20).cast("double"))
        .when(word.isin(*ONE_IS_ENOUGH), 1.0)
        .otherwise(amount)
    )
    return F.when((amount > 0) & unit.isNotNull(), F.struct(scaled.alias("amount"), unit.alias("unit")))


def pack_count(need: Column, unit: Column, size: Column, piece_grams: Column) -> Column:
    """Whole packs (size in unit) that cover need (struct of parse_shopping), one at least; null if the units can't meet.

    Between counts and mass a piece's grams bridge the gap, between mass and volume water's density;
    a volume of something counted is one piece.
    """
    have, want, base = family(unit), family(need["unit"]), need["amount"] * factor(need["unit"])
    required = (
        F.when(have == want, base)
        .when((have == "mass") & (want == "count"), need["amount"] * piece_grams)
        .when((have == "count") & (want == "mass") & piece_grams.isNotNull(), F.greatest(F.lit(1.0), F.ceil(base / piece_grams).cast("double")))
        .when((have == "mass") & (want == "volume") | (have == "volume") & (want == "mass"), base)
        .when((have == "count") & (want == "volume"), 1.0)
    )
    return F.when(required.isNotNull(), F.greatest(F.lit(1).cast("long"), F.ceil(required / (size * factor(unit)))))


def read_template(text: Column) -> Column:
    """struct(n, unit) of a quantity text that begins with a number; n is null for the others."""
    part = lambda k: F.regexp_extract(text, "^([0-9.]+)\\s*(.*)$", k)
    return F.struct(part(1).try_cast("double").alias("n"), F.trim(part(2)).alias("unit"))


def scale_template(text: Column, by: Column, read: Column | None = None) -> Column:
    """A quantity text times a number: whole things in whole numbers, mass and volume in shopping steps. read: the text's read_template, where it was read before."""
    said = read_template(text) if read is None else read
    n, unit = said["n"], said["unit"]
    word, scaled = F.lower(unit), n * by
    value = (
        F.when(word.isin("", *WHOLE), F.greatest(F.lit(1.0), js_round(scaled)))
        .when(word.isin("g", "ml"), F.greatest(F.lit(50.0), js_round(scaled / 50) * 50))
        .when(word.isin("kg", "l") & (scaled >= 2), js_round(scaled * 2) / 2)
        .when(word.isin("kg", "l"), F.greatest(F.lit(0.1), js_round(scaled * 10) / 10))
        .when(scaled >= 10, js_round(scaled))
        .otherwise(js_round(scaled * 10) / 10)
    )
    shown = F.regexp_replace(value.cast("decimal(20,1)").cast("string"), "\\.0$", "")
    return F.when(n.isNull(), text).otherwise(F.trim(F.concat(shown, F.lit(" "), unit)))


def show_amount(amount: Column, kind: Column, label: Column) -> Column:
    """Shopping text of a summed amount: g and ml from 1000 on to a quarter kg or l, else up to 50; pieces whole, one at least; others to one decimal."""
    big = F.when(kind == "g", "kg").otherwise("l")
    quarter = F.regexp_replace((js_round(amount / 1000 * 4) / 4).cast("decimal(20,2)").cast("string"), "\\.?0+$", "")
    shown = F.when(kind == "pcs", F.greatest(F.lit(1.0), F.ceil(amount).cast("double"))).otherwise(js_round(amount * 10) / 10)
    named = F.regexp_replace(shown.cast("decimal(20,1)").cast("string"), "\\.0$", "")
    return (
        F.when(amount == 0, F.when(label == "", "to taste").otherwise(label))
        .when(kind.isin("g", "ml") & (amount >= 1000), F.concat(quarter, F.lit(" "), big))
        .when(kind.isin("g", "ml"), F.concat((F.ceil(amount / 50) * 50).cast("string"), F.lit(" "), kind))
        .otherwise(F.trim(F.concat(named, F.lit(" "), label)))
    )
