"""A store of saved plans in files: rows are appended, deleted ones are left out when read, and compacted away."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLANS = "id string, created_at timestamp, label string, plan string"


def append(plans: DataFrame, place: str) -> None:
    plans.select("id", "created_at", "label", "plan").withColumn("deleted", F.lit(False)).write.mode("append").parquet(place)


def delete(ids: DataFrame, place: str) -> None:
    """Marks ids (a column id) as deleted; a plan saved again under the id later counts anew."""
    none = F.lit(None).cast("string")
    ids.select("id", F.current_timestamp().alias("created_at"), none.alias("label"), none.alias("plan"), F.lit(True).alias("deleted")).write.mode("append").parquet(place)


def read(spark: SparkSession, place: str) -> DataFrame:
    """The last row of each id, if it isn't a deletion: id, created_at, label, plan."""
    rows = spark.read.schema(f"{PLANS}, deleted boolean").parquet(place)
    last = rows.groupBy("id").agg(F.max(F.struct("created_at", "deleted", "label", "plan")).alias("r"))
    return last.where("not r.deleted").select("id", "r.created_at", "r.label", "r.plan")


def compact(spark: SparkSession, place: str, into: str) -> None:
    """Writes what read() gives to a new place."""
    append(read(spark, place), into)
