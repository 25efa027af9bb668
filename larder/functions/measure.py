"""Money, distance and seeded numbers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.quantity import lookup

# Euros for one unit of each currency known.
EUR = {"EUR": 1.0, "GBP": 1.16, "USD": 0.92, "AED": 0.25}
EARTH_KM = 6371.0


def round2(x: Column) -> Column:
    """Two decimals, half up on the double as it is."""
    return F.floor(x * 100 + 0.5) / 100


def in_euros(amount: Column, currency: Column) -> Column:
    """Null for a currency without a rate."""
    return amount * lookup(EUR, currency)


def convert(amount: Column, source: Column, target: Column) -> Column:
    return F.when(source == target, amount).otherwise(in_euros(amount, source) / lookup(EUR, target))


def sanitise(cost: Column, category: Column) -> Column:
    """Costs that can't be right are 0: null, NaN, not positive, or above the cap of the category."""
    cap = F.when(category == "Proteins", 90.0).otherwise(60.0)
    return F.when(cost.isNull() | F.isnan(cost) | (cost <= 0) | (cost > cap), 0.0).otherwise(round2(cost))


def parse_price(text: Column) -> Column:
    """struct(price, currency) of "£1,234.50" or "1.234,50 €": the last separator before two digits is the decimal one."""
    digits = F.regexp_replace(text, "[^0-9.,]", "")
    plain = F.when(digits.rlike(",[0-9]{1,2}$"), F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(digits, F.lit(","), F.lit("")))
    currency = F.when(F.contains(text, F.lit("£")), "GBP").when(F.contains(text, F.lit("€")), "EUR").when(F.contains(text, F.lit("$")), "USD").when(F.contains(F.upper(text), F.lit("AED")), "AED")
    return F.struct(plain.try_cast("double").alias("price"), currency.alias("currency"))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def lcg_states(seed: Column, n: int) -> Column:
    """The first n states of the linear congruential generator that starts at seed * 2654435761 mod 2 ** 32, at 1 where that is 0."""
    # Multipliers and modulus of the generator.
    start, by, plus, modulus = 2654435761, 1664525, 1013904223, 2**32
    first = F.pmod(seed.cast("long") * F.lit(start), F.lit(modulus))
    first = F.when(first == 0, F.lit(1).cast("long")).otherwise(first)
    step = lambda got, _: F.concat(got, F.array(F.pmod(F.element_at(got, -1) * F.lit(by) + F.lit(plus), F.lit(modulus))))
    return F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array(first), step), 2, n)


def draw(state: Column) -> Column:
    """A state as a number from 0 to 1, 1 included."""
    return state / F.lit(float(2**32 - 1))


def budget_tier(budget: Column, household: Column, weeks: Column) -> Column:
    """low, medium or premium by the budget for four people and a month; medium where there is none."""
    scaled = budget * F.when(weeks == "weekly", 30.0 / 7).otherwise(1.0) / F.least(F.greatest(household / 4, F.lit(0.5)), F.lit(2.0))
    return F.when((budget > 0) & (scaled < 300), "low").when((budget > 0) & (scaled >= 500), "premium").otherwise("medium")
