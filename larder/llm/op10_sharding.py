"""Sharding by jump consistent hashing (Lamping and Veach): no ring table, minimal movement.

jump_shard(key, n) depends on the key and n alone. Going from n to n + 1 shards, a key either
keeps its shard or moves to the new one, with probability 1 / (n + 1).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.storage import cut
from larder.llm.text import mix


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each uint64 key. All keys step together until each has jumped past the last shard."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    target = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = target[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (state[live] >> np.uint64(33)).astype(np.float64) + 1
        target[live] = ((shard[live] + 1) * (2147483648.0 / step)).astype(np.int64)
        live = live[target[live] < shards]
    return shard


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 .. shards - 1 of a long key column, its bits mixed first; null keys count as key 0."""

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(mix(k.to_numpy(np.int64).view(np.uint64)), shards), dtype="int32")

    return place(F.coalesce(key, F.lit(0).cast("long")))


def shard_documents(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key (as long), size (UTF-8 bytes + 16), text_crc32, shard, slot, grown_shard of every row.

    Slots number the rows of a shard by key, text_crc32 and size, without gaps: rows are dealt to parts by
    range (equal ones too), each shard's rows of a part are counted, and a row's slot is what the parts
    before hold plus its place in its own. So no task holds a shard. Null texts count as empty; null keys
    go where key 0 goes. An empty table gives an empty result; further columns are left out.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    slim = cut(
        docs.select(
            F.col(key).cast("long").alias("doc_id"),
            (F.octet_length(raw).cast("long") + 16).alias("size"),
            F.crc32(F.encode(raw, "UTF-8")).alias("text_crc32"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "sizes",
    )
    order = ["doc_id", "text_crc32", "size", "place"]
    placed = slim.withColumns({"shard": jump_shard(F.col("doc_id"), shards), "grown_shard": jump_shard(F.col("doc_id"), shards + 1)})
    placed = cut(placed.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "placed")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard", "part").orderBy(*order)
    return (
        placed.join(base, ["shard", "part"])
        .withColumn("slot", F.col("base") + F.row_number().over(own) - 1)
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
    )
