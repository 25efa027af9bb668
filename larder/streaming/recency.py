"""Caches that expire and bursts that settle, over rows with a time: state as bounded time buckets.

What decides a row lies within `gap` seconds of it, so a row is sent to its own bucket of that length
and to the one neighbour it can decide something in. A busy key is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucketed(rows: DataFrame, gap: int, neighbour: int, sent: Column) -> DataFrame:
    home = F.floor(F.unix_micros("at") / (gap * 1_000_000))
    both = F.when(sent, F.array(home, home + neighbour)).otherwise(F.array(home))
    return rows.withColumn("__home", home).withColumn("__bucket", F.explode(both))


def cache_hits(rows: DataFrame, ttl: int) -> DataFrame:
    """rows (key, id, at, put boolean) that ask (not put), with hit: a put of the key came at most ttl seconds earlier.

    Rows of one time are ordered by id. A key's last put counts, as it replaces the earlier ones.
    """
    micros = F.unix_micros("at")
    of = Window.partitionBy("key", "__bucket").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("put"), micros)).over(of)
    seen = _bucketed(rows, ttl, 1, F.col("put")).withColumn("hit", F.coalesce(micros - last <= ttl * 1_000_000, F.lit(False)))
    return seen.where("__bucket = __home and not put").select("key", "id", "hit")


def settled(rows: DataFrame, gap: int) -> DataFrame:
    """rows (key, id, at) after which the key is quiet for more than gap seconds: the newest of each burst."""
    micros = F.unix_micros("at")
    following = F.lead(micros).over(Window.partitionBy("key", "__bucket").orderBy("at", "id"))
    seen = _bucketed(rows, gap, -1, F.lit(True)).withColumn("quiet", F.coalesce(following - micros > gap * 1_000_000, F.lit(True)))
    return seen.where("__bucket = __home and quiet").select("key", "id")
