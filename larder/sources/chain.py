"""Sources that are asked in turn: the next one only for what the ones before could not answer."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.sources.scratch import kept


def ask_in_turn(requests: DataFrame, key: str, sources: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], usable: Callable[[Column], Column]) -> DataFrame:
    """requests with `source` and `answer`: the first source whose answer is usable; both null where every one failed.

    A source takes a table of requests and gives rows (key, answer) for some of them, one each; it is asked with
    the requests that are still open and not at all when none is. A missing row and an answer that isn't usable
    are failures alike. Keys that are null are never answered.
    """
    answered, waiting = [], requests
    for number, (name, ask) in enumerate(sources):
        if number and waiting.isEmpty():
            break
        said = ask(waiting).select(F.col(key).alias("__key"), F.col("answer"))
        met = kept(waiting.join(said, F.col(key) == F.col("__key"), "left").drop("__key").withColumn("__ok", F.coalesce(F.col("answer").isNotNull() & usable(F.col("answer")), F.lit(False))))
        answered.append(met.where("__ok").select(*requests.columns, F.lit(name).alias("source"), "answer"))
        waiting = met.where("not __ok").select(*requests.columns)
    kind = answered[0].schema["answer"].dataType if answered else "string"
    answered.append(waiting.select(*requests.columns, F.lit(None).cast("string").alias("source"), F.lit(None).cast(kind).alias("answer")))
    return reduce(DataFrame.unionByName, answered)
