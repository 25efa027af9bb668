"""A plan's report as rows: sections in order, each line with its label and value, ready for any sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.records import local_money

COLUMNS = ("report", "section", "ord", "label", "value")
# Words of a report by language.
WORDS = {
    "en": {"budget": "Budget", "spend": "Estimated spend", "savings": "Expected savings", "zero": "Zero Spend Day", "breakfast": "Breakfast", "lunch": "Lunch", "dinner": "Dinner", "cheapest": "Cheapest", "yes": "Yes", "no": "No"},
    "it": {"budget": "Budget", "spend": "Spesa stimata", "savings": "Risparmio previsto", "zero": "Giorno a Zero Spese", "breakfast": "Colazione", "lunch": "Pranzo", "dinner": "Cena", "cheapest": "Più economico", "yes": "Sì", "no": "No"},
    "fr": {"budget": "Budget", "spend": "Dépense estimée", "savings": "Économies prévues", "zero": "Jour sans dépense", "breakfast": "Petit-déjeuner", "lunch": "Déjeuner", "dinner": "Dîner", "cheapest": "Le moins cher", "yes": "Oui", "no": "Non"},
    "es": {"budget": "Presupuesto", "spend": "Gasto estimado", "savings": "Ahorro previsto", "zero": "Día sin gasto", "breakfast": "Desayuno", "lunch": "Almuerzo", "dinner": "Cena", "cheapest": "Más barato", "yes": "Sí", "no": "No"},
    "de": {"budget": "Budget", "spend": "Geschätzte Ausgaben", "savings": "Erwartete Ersparnis", "zero": "Null-Ausgaben-Tag", "breakfast": "Frühstück", "lunch": "Mittagessen", "dinner": "Abendessen", "cheapest": "Am günstigsten", "yes": "Ja", "no": "Nein"},
}


def word(key: str) -> Column:
    """The word of the row's language; other languages speak English."""
    said = F.lit(WORDS["en"][key])
    for language, words in WORDS.items():
        said = F.when(F.col("language") == language, words[key]).otherwise(said)
    return said


def report_rows(reports: DataFrame, meals: DataFrame, groceries: DataFrame, stores: DataFrame) -> DataFrame:
    """report, section, ord, label, value of every report's lines.

    reports: report, language, currency, city, country, budget, spend, savings, zero_day. meals: report, day,
    breakfast, lunch, dinner. groceries: report, place, name, quantity, category. stores: report, place, name,
    total, cheapest. Section 1 is the place, 2 money, 3 meals, 4 the shopping list, 5 the stores; a report
    without rows of a kind lacks that section, rows without a report go. Each table meets the reports once, by
    the report; lines are laid out by arrays inside their row, so nothing else is shuffled.
    """
    head = reports.select("report", "language", "currency")
    money = lambda amount: local_money(amount, F.col("currency"), F.col("language"))
    line = lambda section, ord_, label, value: F.struct(F.lit(section).alias("section"), ord_.cast("int").alias("ord"), label.alias("label"), value.alias("value"))
    place = F.concat_ws(" · ", F.nullif(F.col("city"), F.lit("")), F.coalesce("country", F.lit("")))
    amounts = [("budget", F.col("budget")), ("spend", F.col("spend")), ("savings", F.greatest(F.lit(0.0), F.col("savings")))]
    first = F.array(
        line(1, F.lit(0), place, F.lit(None).cast("string")),
        *[line(2, F.lit(k), word(key), money(F.coalesce(amount, F.lit(0.0)))) for k, (key, amount) in enumerate(amounts)],
        line(2, F.lit(3), word("zero"), F.when(F.col("zero_day"), word("yes")).otherwise(word("no"))),
    )
    eaten = F.array(*[line(3, F.col("day") * 3 + k, word(m), F.col(m)) for k, m in enumerate(("breakfast", "lunch", "dinner"))])
    bought = F.array(line(4, F.col("place"), F.concat(F.lit("• "), F.col("name"), F.lit(" — "), F.coalesce("quantity", F.lit(""))), F.col("category")))
    shop = F.array(line(5, F.col("place"), F.concat(F.col("name"), F.when(F.col("cheapest"), F.concat(F.lit(" · "), word("cheapest"))).otherwise("")), money(F.col("total"))))
    parts = [reports.select("report", F.inline(first)), *[rows.join(head, "report").select("report", F.inline(lines)) for rows, lines in ((meals, eaten), (groceries, bought), (stores, shop))]]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.toDF(*COLUMNS)
