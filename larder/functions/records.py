"""Small rules over records: messages, steps, defaults, locales, labels, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.quantity import lookup
from larder.functions.text import encode_component

# Signs of currencies shown before the amount.
SIGNS = {"EUR": "€", "GBP": "£", "USD": "$"}
# Countries whose kitchens don't follow their unit system.
KITCHEN = {"US": "us", "LR": "us", "MM": "us", "GB": "imperial"}
# Texts shown for error codes.
ERRORS = {
    "BUDGET_TOO_LOW": "Your budget looks a little tight — we've suggested an optimised plan.",
    "PRICING_UNAVAILABLE": "We couldn't fetch live prices right now — showing our best estimate.",
    "NO_MEALS_FOR_STYLE": "We don't have meals for that style yet. Try another preference.",
    "STORAGE_UNAVAILABLE": "We couldn't save your plan. It's still in this session.",
    "AI_UNAVAILABLE": "Our smart planner is busy — using the offline engine instead.",
}
GENERAL_ERROR = "Something went wrong. Please try again."
# Words of quick breakfasts, of slow dishes and of brisk ones.
PREP_WORDS = (("smoothie", "toast", "yogurt", "oats", "porridge"), ("roast", "tagine", "risotto", "ragu", "slow", "stew", "shepherd", "sukiyaki"), ("grill", "pan", "stir fry", "salad", "wrap", "bowl"))
# Languages with messages.
LANGUAGES = ("en", "it", "de", "es", "fr")


def interpolate(template: Column, params: Column) -> Column:
    """A template with each {key} replaced by params[key] (map of strings); unknown keys stay."""
    return F.aggregate(F.map_entries(params), template, lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def steps(text: Column, most: int = 12) -> Column:
    """Lines and sentences of over four characters, the first `most` (F10). A sentence ends in a full stop before a capital."""
    parts = F.transform(F.split(text, r"\r?\n|(?<=\.)\s+(?=[A-Z])"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.slice(F.filter(parts, lambda s: F.length(s) > 4), 1, most)


def edited_line(line: Column) -> Column:
    """struct(name, quantity) of "name — quantity"; a dash, a colon or a hyphen parts them, the quantity may be missing."""
    parts = F.split(line, "[—:-]", 2)
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("name"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("quantity"))


def prep_minutes(name: Column, meal: Column) -> Column:
    """Minutes of work by words of the dish and the meal."""
    n = F.lower(name)
    quick, slow, brisk = ("|".join(words) for words in PREP_WORDS)
    return (
        F.when(meal == "breakfast", F.when(n.rlike(quick), 8).otherwise(15))
        .when(n.rlike(slow), 60)
        .when(n.rlike(brisk), 20)
        .when(meal == "lunch", 15)
        .otherwise(30)
    )


def money(amount: Column, currency: Column) -> Column:
    """Two decimals, thousands grouped, with the currency's sign, else its code and a blank."""
    return F.concat(F.coalesce(lookup(SIGNS, currency), F.concat(currency, F.lit(" "))), F.format_number(amount, 2))


def local_money(amount: Column, currency: Column, language: Column) -> Column:
    """An amount as a language writes it, with the currency's sign; a currency without a sign as its code and two decimals."""
    sign, plain = lookup(SIGNS, currency), F.format_number(amount, 2)
    after = lambda written: F.concat(written, F.lit("\u00a0"), sign)
    shown = F.when(language == "en", F.concat(sign, plain)).when(language == "fr", after(F.translate(plain, ",.", "\u202f,"))).otherwise(after(F.translate(plain, ",.", ".,")))
    return F.coalesce(shown, F.concat(currency, F.lit(" "), F.replace(plain, F.lit(","), F.lit(""))))


def kitchen_units(code: Column, system: Column) -> Column:
    """Cooking units of a country: its own convention, else by its unit system."""
    return F.coalesce(lookup(KITCHEN, code), F.when(system == "imperial", "imperial").otherwise("metric"))


def locale(language: Column, code: Column, own: Column) -> Column:
    """language-CODE where both are known, else the language, else the country's own locale, else en."""
    said, known = F.nullif(language, F.lit("")), F.nullif(code, F.lit(""))
    return F.coalesce(F.concat(said, F.lit("-"), known), said, own, F.lit("en"))


def first_language(candidates: Column) -> Column:
    """The first candidate whose prefix before a hyphen is a language with messages, else en."""
    prefixes = F.transform(candidates, lambda c: F.lower(F.substring_index(c, "-", 1)))
    return F.coalesce(F.get(F.filter(prefixes, lambda p: p.isin(*LANGUAGES)), F.lit(0)), F.lit("en"))


def confidence_level(confidence: Column) -> Column:
    """high from .8, medium from .55, else low; null is low."""
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.55, "medium").otherwise("low")


def per_serving(spend: Column, days: Column, household: Column) -> Column:
    return spend / F.greatest(F.lit(1), days * 3 * household)


def wide_to_long(names: list[Column], amounts: list[Column]) -> Column:
    """array<struct(name, amount)> of numbered columns; those without a name go."""
    rows = F.array(*[F.struct(F.trim(n).alias("name"), F.trim(F.coalesce(a, F.lit(""))).alias("amount")) for n, a in zip(names, amounts, strict=True)])
    return F.filter(rows, lambda r: F.coalesce(r["name"] != "", F.lit(False)))


def message(code: Column, own: Column | None = None) -> Column:
    """The text of an error code, the error's own for INVALID_INPUT, else a general one."""
    said = lookup(ERRORS, code) if own is None else F.coalesce(lookup(ERRORS, code), F.when(code == "INVALID_INPUT", own))
    return F.coalesce(said, F.lit(GENERAL_ERROR))


def with_defaults(own: Column, base: Column, fields: list[str]) -> Column:
    """struct of fields, each from own, else from base; a missing own struct is base."""
    return F.struct(*[F.coalesce(own[f], base[f]).alias(f) for f in fields])


# What a recipe record has where its source says nothing, and where its picture is looked for.
RECIPE_DEFAULTS = {"servings": 4, "difficulty": "easy", "nutrition": {"calories": 480, "protein": 22, "carbs": 55, "fat": 16}}
PICTURES = "https://source.unsplash.com/featured/800x600/?food,"


def recipe_record(id_: Column, title: Column, prep: Column, cook: Column, difficulty: Column, nutrition: Column, allergens: Column, query: Column) -> Column:
    """struct(id, title, image, servings, minutes, difficulty, nutrition, allergens, source) of a local recipe.

    A missing difficulty, nutrition struct or allergen list has its default; the picture's words are those of the
    query or, where that is missing or empty, of the title, joined by commas.
    """
    words = F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(F.nullif(query, F.lit("")), title)), "[^a-z0-9 ]", " ")), " +", ",")
    facts = F.struct(*[F.lit(v).alias(k) for k, v in RECIPE_DEFAULTS["nutrition"].items()])
    return F.struct(
        F.concat(F.lit("local-"), id_).alias("id"), title.alias("title"), F.concat(F.lit(PICTURES), encode_component(words)).alias("image"), F.lit(RECIPE_DEFAULTS["servings"]).alias("servings"), (prep + cook).alias("minutes"),
        F.coalesce(difficulty, F.lit(RECIPE_DEFAULTS["difficulty"])).alias("difficulty"), F.coalesce(nutrition, facts).alias("nutrition"), F.coalesce(allergens, F.array().cast("array<string>")).alias("allergens"), F.lit("themealdb").alias("source"),
    )


def recipe_search(dish: Column, cuisine: Column, language: Column) -> Column:
    """Words of a search for a recipe, without the parts that are missing or empty."""
    return F.concat_ws(" ", *[F.nullif(F.trim(x), F.lit("")) for x in (dish, cuisine)], F.when(language == "it", "ricetta").otherwise("recipe"))
