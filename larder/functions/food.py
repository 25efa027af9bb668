"""Ingredient texts: names, kinds of food, quantities of recipes, rules on recipes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.quantity import js_round, lookup

# Words that don't tell merged ingredients apart.
PLAIN_WORDS = ("fresh", "dried", "chopped", "ground", "sliced", "grated", "whole", "baby", "raw", "cooked", "extra virgin")
# Names that are never bought.
NEVER_BOUGHT = ("salt", "black pepper", "pepper", "water", "ice", "to taste")
# Categories by parts of names, the first that fits; the order is the order of a list.
CATEGORIES = {
    "Proteins": ("chicken", "beef", "pork", "lamb", "turkey", "fish", "salmon", "tuna", "cod", "prawn", "shrimp", "egg", "tofu", "lentil", "bean", "chickpea", "tempeh", "guanciale", "bacon", "sausage"),
    "Vegetables": (
        "tomato", "onion", "garlic", "carrot", "celery", "pepper", "zucchini", "cucumber", "spinach", "cabbage", "salad", "greens", "lettuce", "broccoli", "cauliflower", "mushroom", "asparagus", "potato", "avocado",
        "berry", "berries", "banana", "fruit", "herb", "basil", "parsley", "mint", "spring onion", "leek", "bok choy", "ginger", "chilli", "chili",
    ),
    "Carbohydrates": ("pasta", "rice", "bread", "toast", "flour", "oat", "noodle", "pita", "wrap", "tortilla", "cornetto", "panko", "bulgur", "quinoa", "cous", "grain"),
}
OTHER_CATEGORY = "Healthy Fats"
# Grams of one piece by patterns of its name, the first that fits.
PIECES = (
    ("garlic", 60), ("lemon|lime", 100), ("onion", 150), ("pepper(s)?$|bell pepper", 160), ("tomato", 120), ("zucchini|courgette|eggplant|aubergine", 200), ("carrot", 80), ("potato", 180), ("cucumber", 300),
    ("avocado", 200), ("banana", 120), ("apple|pear|orange|peach", 160), ("broccoli|cauliflower|cabbage", 500), ("herb|parsley|mint|basil|coriander", 30), ("chicken breast|fillet|steak", 180),
    ("pita|tortilla|flatbread", 60), ("bread|loaf|sourdough", 400), ("egg", 60), ("canned|can of|tuna|beans|chickpea|tomatoes$", 400),
)
# Units of recipes as (kind, multiple), and words for pieces.
UNITS = {"g": ("g", 1.0), "gram": ("g", 1.0), "grams": ("g", 1.0), "kg": ("g", 1000.0), "ml": ("ml", 1.0), "l": ("ml", 1000.0), "litre": ("ml", 1000.0), "litres": ("ml", 1000.0), "liter": ("ml", 1000.0), "tsp": ("ml", 5.0), "tbsp": ("ml", 15.0)}
PIECE_WORDS = (
    "", "pcs", "piece", "pieces", "unit", "units", "loaf", "loaves", "slice", "slices", "can", "cans", "tin", "tins", "jar", "jars", "bottle", "bottles", "pack", "packs", "clove", "cloves", "leaf", "leaves",
    "sprig", "sprigs", "bunch", "bunches", "head", "heads", "stalk", "stalks", "sheet", "sheets", "shot", "shots",
)
# What each diet rules out, by parts of names.
DIETS = {
    "Vegan": ("chicken", "salmon", "tuna", "beef", "feta", "yogurt", "butter", "egg", "parmesan"), "Vegetarian": ("chicken", "salmon", "tuna", "beef"),
    "Lactose Free": ("yogurt", "butter", "feta", "parmesan"), "Gluten Free": ("bread", "pasta", "flour", "sourdough"),
}
# Allergens by parts of names, of written recipes and of recipes found.
ALLERGENS = {
    "Egg": ("egg", "eggs"), "Milk": ("milk", "cheese", "mozzarella", "feta", "yogurt", "butter", "parmesan"), "Gluten": ("bread", "toast", "pasta", "flour", "couscous", "pita", "noodle", "wrap", "tortilla"),
    "Fish/Shellfish": ("salmon", "tuna", "cod", "fish", "prawn", "shrimp"), "Soy": ("soy", "tofu", "miso"), "Nuts": ("nut", "almond", "walnut", "peanut"),
}
FOUND_ALLERGENS = {
    "Milk": ("milk", "cheese", "butter", "yogurt", "cream", "mozzarella", "parmesan", "feta", "ricotta"), "Gluten": ("flour", "bread", "pasta", "noodle", "couscous", "wheat", "barley", "rye", "semolina"), "Egg": ("egg",),
    "Nuts": ("peanut", "almond", "cashew", "walnut", "hazelnut", "pistachio"), "Fish/Shellfish": ("salmon", "tuna", "cod", "shrimp", "prawn", "fish", "anchovy"), "Soy": ("soy",),
}
# Calories, protein, carbohydrates and fat of a serving, and what each ingredient of a group adds.
SERVING = (250, 12, 30, 8)
ADDS = (
    (("chicken", "beef", "pork", "lamb", "salmon", "tuna", "fish", "egg"), (80, 10, 0, 4)), (("rice", "pasta", "bread", "flour", "potato", "noodle"), (90, 0, 18, 0)),
    (("cheese", "butter", "cream", "oil"), (60, 0, 0, 6)), (("bean", "lentil", "chickpea"), (40, 5, 6, 0)),
)
# Words that tie a dish to rows of a shopping list.
DISH_WORDS = (
    "pasta", "rice", "bread", "toast", "oats", "porridge", "quinoa", "noodle", "pizza", "flour", "chicken", "salmon", "tuna", "beef", "lamb", "cod", "egg", "lentil", "chickpea", "bean", "feta", "parmesan", "yogurt", "cheese",
    "tomato", "salad", "pepper", "mushroom", "carrot", "onion", "garlic", "avocado", "asparagus", "veg", "olive oil", "butter", "nut",
)
# Dinners of a day on which nothing is bought.
NO_SPEND = ("zero spend", "leftovers reheated", "pantry")
# Shop tags of the map and the category each stands for.
SHOP_TAGS = {
    "supermarket": "supermarket", "convenience": "convenience", "butcher": "butcher", "seafood": "seafood", "fishmonger": "seafood", "bakery": "bakery", "greengrocer": "greengrocer", "organic": "organic", "deli": "deli",
    "farm": "farm", "grocery": "grocery", "general": "grocery",
}
# Savings of one dinner out and one coffee.
DINNER, COFFEE = 25.0, 3.5


def has_any(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether a text holds one of the parts, in any case."""
    return F.lower(text).rlike("|".join(parts))


def holding(names: Column, parts: tuple[str, ...]) -> Column:
    """The names of an array that hold one of the parts."""
    return F.filter(names, lambda n: has_any(n, parts))


def plain_name(name: Column) -> Column:
    """Name under which ingredient lines are merged: without brackets, plain words and signs."""
    out = F.regexp_replace(F.lower(name), r"\(.*?\)", "")
    out = F.regexp_replace(out, r"\b(" + "|".join(PLAIN_WORDS) + r")\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[^a-z0-9 ]", " "), " +", " "))


def is_bought(key: Column) -> Column:
    """Whether a plain name is one to shop for."""
    return (key != "") & ~key.isin(*NEVER_BOUGHT)


def category(name: Column) -> Column:
    """Category of a name, the last one for names that fit none."""
    out = F.lit(OTHER_CATEGORY)
    for label, parts in reversed(CATEGORIES.items()):
        out = F.when(has_any(name, parts), label).otherwise(out)
    return out


def category_place(label: Column) -> Column:
    """Place of a category in a list (O1)."""
    return F.array_position(F.array(*[F.lit(c) for c in (*CATEGORIES, OTHER_CATEGORY)]), label)


# Categories of a priced list in their order.
LIST_ORDER = ("Proteins", "Vegetables", "Carbohydrates", "Healthy Fats", "Fruit", "Pantry", "Other")


def list_place(label: Column) -> Column:
    """Place of a category in a priced list, 0 if the list doesn't know it (A5)."""
    return F.coalesce(F.array_position(F.array(*[F.lit(c) for c in LIST_ORDER]), label), F.lit(0))


def piece_grams(name: Column) -> Column:
    """Grams of one piece, null for what isn't known (F21). name is normalised."""
    out = F.lit(None).cast("double")
    for pattern, grams in reversed(PIECES):
        out = F.when(name.rlike(pattern), float(grams)).otherwise(out)
    return out


def recipe_quantity(text: Column) -> Column:
    """struct(amount, kind, label) of a recipe's quantity: kind g, ml, pcs or raw; null without text or number."""
    said = F.lower(F.trim(text))
    number = F.regexp_extract(said, r"^([\d.,]+)\s*(.*)$", 1)
    unit = F.trim(F.regexp_extract(said, r"^([\d.,]+)\s*(.*)$", 2))
    n = F.regexp_extract(F.regexp_replace(number, "^([^,]*),", "$1."), r"^(\d*\.?\d*)", 1).try_cast("double")
    known = unit.isin(*UNITS)
    amount = F.when(known, n * lookup({u: m for u, (_, m) in UNITS.items()}, unit)).otherwise(n)
    kind = F.when(known, lookup({u: k for u, (k, _) in UNITS.items()}, unit)).when(unit.isin(*PIECE_WORDS), "pcs").otherwise("raw")
    label = F.when(known, kind).otherwise(unit)
    row = lambda a, k, u: F.struct(a.alias("amount"), k.alias("kind"), u.alias("label"))
    loose = said.rlike("to taste|to serve") | (number == "")
    return F.when(F.coalesce(text, F.lit("")) == "", None).when(loose, row(F.lit(0.0), F.lit("raw"), said)).when(n.isNotNull(), row(amount, kind, label))


def scale_quantity(text: Column, by: Column) -> Column:
    """A recipe's quantity for other servings: whole from 10 on, else one decimal; other texts stay."""
    number = F.regexp_extract(text, r"^([\d.,]+)\s*(.*)$", 1)
    unit = F.regexp_extract(text, r"^([\d.,]+)\s*(.*)$", 2)
    scaled = F.regexp_extract(F.regexp_replace(number, "^([^,]*),", "$1."), r"^(\d*\.?\d*)", 1).try_cast("double") * by
    value = F.when(scaled >= 10, js_round(scaled)).otherwise(js_round(scaled * 10) / 10)
    shown = F.regexp_replace(value.cast("decimal(20,1)").cast("string"), r"\.0$", "")
    return F.when((number == "") | scaled.isNull(), text).otherwise(F.concat(shown, F.when(unit != "", F.concat(F.lit(" "), unit)).otherwise("")))


def split_quantity(text: Column) -> Column:
    """struct(quantity, unit) of an offer's text; a text without a leading number is all quantity."""
    pattern = r"^([\d.,/\s]+)\s*([a-zA-Z]+)?"
    number, unit = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.struct(F.nullif(F.when(number == "", text).otherwise(F.trim(number)), F.lit("")).alias("quantity"), F.when(number != "", F.nullif(unit, F.lit(""))).alias("unit"))


def pack_text(quantity: Column, unit: Column) -> Column:
    """A pack as its size and unit; pieces have no unit."""
    shown = F.regexp_replace(quantity.cast("decimal(20,3)").cast("string"), r"\.?0+$", "")
    return F.concat(shown, F.when(unit == "unit", "").otherwise(F.concat(F.lit(" "), unit)))


def household(text: Column) -> Column:
    """People of "4+": the leading number, 4 where there is none or it is 0, 1 at least."""
    n = F.regexp_extract(F.replace(F.coalesce(text, F.lit("")), F.lit("+"), F.lit("")), r"^\s*(-?\d+)", 1).try_cast("int")
    return F.greatest(F.lit(1), F.coalesce(F.nullif(n, F.lit(0)), F.lit(4)))


def fits_diets(name: Column, diets: Column) -> Column:
    """Whether none of the diets asked for rules a name out."""
    out = F.lit(True)
    for diet, parts in DIETS.items():
        out = out & ~(F.array_contains(diets, diet) & has_any(name, parts))
    return out


def is_complete(ingredients: Column, steps: Column, calories: Column) -> Column:
    """A recipe that can be cooked: four ingredients, three steps, calories above 0 (P10)."""
    return F.coalesce((F.size(ingredients) >= 4) & (F.size(steps) >= 3) & (calories > 0), F.lit(False))


def spends(dinner: Column) -> Column:
    """Whether a day's dinner is one to shop for."""
    return ~F.coalesce(has_any(dinner, NO_SPEND), F.lit(False))


def allergens(names: Column, found: bool = False) -> Column:
    """Allergens of an array of ingredient names, of a written recipe or of one found."""
    table = FOUND_ALLERGENS if found else ALLERGENS
    return F.array_compact(F.array(*[F.when(F.size(holding(names, parts)) > 0, label) for label, parts in table.items()]))


def nutrition(names: Column) -> Column:
    """struct(calories, protein, carbs, fat) guessed from ingredient names."""
    counts = [F.size(holding(names, parts)) for parts, _ in ADDS]
    total = lambda k: F.lit(SERVING[k]) + sum((n * adds[k] for n, (_, adds) in zip(counts, ADDS, strict=True)), F.lit(0))
    return F.struct(*[total(k).cast("int").alias(label) for k, label in enumerate(("calories", "protein", "carbs", "fat"))])


def belongs(dish: Column, name: Column) -> Column:
    """Whether a row of a shopping list shares a word with a dish."""
    return F.exists(F.array(*[F.lit(w) for w in DISH_WORDS]), lambda w: F.contains(F.lower(dish), w) & F.contains(F.lower(name), w))


def equivalent(savings: Column) -> Column:
    """Savings told as dinners out, else as three coffees or more, else null."""
    dinners, coffees = F.floor(savings / DINNER), F.floor(savings / COFFEE)
    return F.when(dinners >= 1, F.concat(dinners.cast("string"), F.lit(" dinners"))).when(coffees >= 3, F.concat(coffees.cast("string"), F.lit(" coffees")))


def shop_category(tag: Column) -> Column:
    """Category of a shop tag, other for unknown ones (F64)."""
    return F.coalesce(lookup(SHOP_TAGS, tag), F.lit("other"))
