"""One row per key and ranked options."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.sources.scratch import kept


def keep_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in a total order. Spark limits groups by rank before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int, name: str = "rank") -> DataFrame:
    """The first `most` rows of each key with their rank from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= most)


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    """Every row with its place from 1 in the order of its key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def latest(df: DataFrame, keys: Sequence[str], generation: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of the greatest generation of each key: one hash aggregate, no sort."""
    return df.groupBy(*keys).agg(F.max(F.struct(*generation, *values)).alias("last")).select(*keys, *[F.col(f"last.{c}") for c in (*generation, *values)])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """`placed` for keys of any size: rows are dealt to parts by range, so a large key spreads over many tasks.

    A row's place is the number of its key's rows in the parts before plus its place in its own part; of a key only
    the counts of its parts come together. Rows that are equal in keys and order may take each other's places.
    """
    parts = kept(df.withColumn("__equal", F.monotonically_increasing_id()).repartitionByRange(*keys, *order, "__equal").withColumn("__part", F.spark_partition_id()))
    counts = parts.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = parts.withColumn("__own", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order, "__equal")))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("__part") == F.col("__of"))
    return own.join(base, same).withColumn(name, F.col("__base") + F.col("__own")).select(*df.columns, name)
