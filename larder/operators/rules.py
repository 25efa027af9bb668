"""Rule tables over texts: every text is read once for the words of all rules, and rules meet texts on words.

A rule has a book, a place in it, alternatives of words that a text must all hold, and a pattern that decides.
One expression finds the words of all rules at every place of a text; only rules whose words are there test
their pattern. The number of rules adds nothing to the texts' reading but a longer expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: book, pattern, value of one rule; rules of a book are in order.
Rule = tuple[str, str, str]


def alternatives(pattern: str) -> list[list[str]]:
    """The words of a pattern of the form a.*b|c: for each alternative those that a text has to hold."""
    return [[w for w in part.split(".*") if w] for part in pattern.split("|")]


def table_of(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """book, place, alternative, word, words (how many), pattern, value: a row for each word of each alternative."""
    rows, places = [], {}
    for book, pattern, value in rules:
        places[book] = place = places.get(book, -1) + 1
        for number, words in enumerate(alternatives(pattern)):
            if not words or any(re.search(r"[^a-z' -]", w) for w in words):
                raise ValueError(f"a rule's alternatives are words in lower case joined by .*: {pattern}")
            rows += [(book, place, number, word, len(set(words)), pattern, value) for word in set(words)]
    return spark.createDataFrame(rows, "book string, place int, alternative int, word string, words int, pattern string, value string")


def all_fits(texts: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """text, book, place, value of every rule that fits a distinct text, in any case. Null texts fit none.

    Texts meet rules on the words found, so a word that most texts hold costs a row for each of its rules. The rules
    are fixed values of the library, far below any limit of a broadcast.
    """
    spark = texts.sparkSession
    table = table_of(spark, rules)
    words = sorted({w for _, p, _ in rules for of in alternatives(p) for w in of}, key=lambda w: (-len(w), w))
    inside = {w: [o for o in words if w.startswith(o)] for w in words}  # the longest word at a place stands for those it begins with
    grown = F.create_map(*[x for w, of in inside.items() for x in (F.lit(w), F.array(*[F.lit(o) for o in of]))])
    lower = texts.select(F.col(text).alias("text")).where("text is not null").distinct().withColumn("lower", F.lower("text"))
    seen = F.regexp_extract_all("lower", F.lit(f"(?=({'|'.join(words)}))"), F.lit(1))
    found = F.array_distinct(F.flatten(F.transform(seen, lambda w: F.try_element_at(grown, w))))
    met = lower.select("text", "lower", F.explode(found).alias("word")).join(F.broadcast(table), "word")
    whole = met.groupBy("text", "lower", "book", "place", "alternative", "words", "pattern", "value").agg(F.count("*").alias("n")).where("n = words and lower rlike pattern")
    return whole.select("text", "book", "place", "value").distinct()


def first_fits(texts: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """text and a map `fits` from each book to the value of its first rule that fits; texts that fit nothing are left out."""
    best = all_fits(texts, rules, text).groupBy("text", "book").agg(F.min(F.struct("place", "value")).alias("first"))
    return best.groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("book", "first.value"))).alias("fits"))
