"""Caches and debounced input as state on a stream.

A cache is keyed state with a timer: an answer that was found is stored with the time it expires, a failed one
isn't stored; the timer clears what has expired, so state holds live entries only. Every row is answered in the
order of its time: rows wait in their key's state until the watermark has passed them, as late ones may come.
What the batch queries of `recency` say of a table, these say of the stream of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a stream's session needs: state in RocksDB, which transformWithState works on.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class LevelledCache(StatefulProcessor):
    """Rows (id, micros, put, ok) of a key -> key, id and the level that answers each row that isn't a put.

    A put that is ok is stored in all levels, each with its own time to live; it replaces what was there. A put
    that failed stores nothing and leaves what is there. A level answers to the very end of its time.
    """

    def __init__(self, levels: tuple[tuple[str, int], ...]):
        self.levels = levels
        self.longest = max(ttl for _, ttl in levels)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id bigint, micros bigint, put boolean, ok boolean")
        self.entry = handle.getValueState("entry", "stored bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.id), int(r.micros), bool(r.put), bool(r.ok)) for frame in rows for r in frame.itertuples()]
        self.waiting.appendList(new)
        for due in {1 + micros // 1000 for _, micros, _, _ in new}:  # a timer fires once the watermark has passed it
            self.handle.registerTimer(due)
        yield self._answers(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: (r[1], r[0])) if self.waiting.exists() else []
        ready, left = [r for r in rows if r[1] < due], [r for r in rows if r[1] >= due]
        stored, said = self.entry.get()[0] if self.entry.exists() else None, []
        for id_, micros, put, ok in ready:
            if put:
                stored = micros if ok else stored
                continue
            age = None if stored is None else micros - stored
            said.append((id_, next((name for name, ttl in self.levels if age is not None and age <= ttl * 1_000_000), "none")))
        if stored is not None and due > stored + self.longest * 1_000_000:
            self.entry.clear()
        elif stored is not None:
            self.entry.update((stored,))
            self.handle.registerTimer(2 + stored // 1000 + self.longest * 1000)
        if ready:
            self.waiting.clear()
            if left:
                self.waiting.put(left)
        yield self._answers(key, said)

    def _answers(self, key, said: list[tuple[int, str]]) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([key[0]] * len(said), dtype="int64"), "id": pd.Series([i for i, _ in said], dtype="int64"), "level": pd.Series([v for _, v in said], dtype="object")})

    def close(self) -> None:
        pass


def cache_levels(rows: DataFrame, levels: tuple[tuple[str, int], ...], late: str) -> DataFrame:
    """A stream of rows (key, id, at, put boolean, ok boolean) -> key, id, level of each row that asks.

    level names the first of `levels` (name and seconds to live, shortest first) in which the key's last stored put
    still lives, or is 'none'. Rows later than `late` behind the newest are dropped. A row is answered once the
    watermark has passed it: the newest rows of a stream that ends wait.
    """
    timed = rows.withWatermark("at", late).select("key", "id", "at", F.unix_micros("at").alias("micros"), "put", F.coalesce("ok", F.lit(True)).alias("ok"))
    return timed.groupBy("key").transformWithStateInPandas(LevelledCache(levels), "key bigint, id bigint, level string", "append", "eventTime")


def settled_queries(typed: DataFrame, gap_ms: int = 250, least: int = 2, late: str = "1 minute") -> DataFrame:
    """Rows (key, id, at, text) -> key, id, at, text of those after which the key is quiet for gap_ms: what a debounced search box sends.

    A row whose trimmed text is shorter than `least` sends nothing but ends the wait of the row before, as any newer
    row does. On a stream a burst comes out once the watermark has passed it, and rows later than `late` are dropped.
    """
    timed = typed.withWatermark("at", late) if typed.isStreaming else typed
    gap = F.lit(f"{gap_ms * 1000 + 1} microseconds")  # a session ends before its gap does: one microsecond more lets equal gaps join
    burst = timed.groupBy("key", F.session_window("at", gap).alias("burst")).agg(F.max(F.struct("at", "id", "text")).alias("last"))
    return burst.select("key", "last.id", "last.at", F.trim("last.text").alias("text")).where(F.char_length("text") >= least)
