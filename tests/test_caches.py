"""Streams of caches and debounced input against the batch and against plain loops; late rows and restarts included."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from larder.streaming import caches, recency

SF = "/root/testdata/sf0.001"
LEVELS = (("memory", 600), ("session", 3600))
START = datetime(2024, 1, 1, tzinfo=timezone.utc)
ROWS = "key long, id long, at timestamp, put boolean, ok boolean"


@pytest.fixture
def rocks(spark):
    for name, value in caches.STATE.items():
        spark.conf.set(name, value)
    yield spark
    for name in caches.STATE:
        spark.conf.unset(name)


def play(spark, tmp_path, batches, schema, transform, stops=1):
    """The rows that a stream over the batches writes, one batch a trigger, stopped and started again `stops` times."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    cuts = [len(batches) * k // stops for k in range(stops + 1)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        for rows in batches[a:b]:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        run = transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        assert run.awaitTermination(240) and run.exception() is None
    return spark.read.parquet(out)


def plain_levels(rows):
    stored, out = {}, {}
    for key, id_, at, put, ok in sorted(rows, key=lambda r: (r[2], r[1])):
        if put:
            stored[key] = at if ok else stored.get(key)
        else:
            age = (at - stored[key]).total_seconds() if stored.get(key) else None
            out[id_] = next((name for name, ttl in LEVELS if age is not None and age <= ttl), "none")
    return out


def test_a_cached_stream_answers_like_a_plain_loop_over_restarts_and_late_rows(rocks, tmp_path):
    rng = random.Random(4)
    rows = []
    for k in range(300):
        rows.append((rng.randint(1, 6), k, START + timedelta(seconds=37 * k + rng.randint(0, 30)), rng.random() < 0.3, rng.random() < 0.6))
    rows += [(9, 1000, START, True, True), (9, 1001, START + timedelta(seconds=600), False, True), (9, 1002, START + timedelta(seconds=600, microseconds=1), False, True), (9, 1003, START + timedelta(seconds=3600), False, True), (9, 1004, START + timedelta(seconds=3601), False, True)]
    rows.sort(key=lambda r: r[2])
    shuffled = [*rows]
    for k in range(0, len(rows) - 8, 8):  # late by a few minutes, inside what is waited for
        part = shuffled[k : k + 8]
        rng.shuffle(part)
        shuffled[k : k + 8] = part
    end = START + timedelta(days=1)
    batches = [shuffled[k : k + 60] for k in range(0, len(shuffled), 60)] + [[(77, 5000, end, True, True)], [(77, 5001, end + timedelta(hours=1), True, True)], [(1, 6000, START, False, True)]]  # the last one comes too late
    got = play(rocks, tmp_path, batches, ROWS, lambda s: caches.cache_levels(s, LEVELS, "20 minutes"), stops=3).collect()
    assert len(got) == len({r.id for r in got}) and {r.id: r.level for r in got} == plain_levels(rows)


def test_a_stream_of_events_ends_where_the_batch_does(rocks, tmp_path):
    events = rocks.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").isin("signup", "purchase").alias("put"))
    near, far = ({r.id: r.hit for r in recency.cache_hits(events, ttl).collect()} for ttl in (600, 3600))
    want = {i: "memory" if near[i] else "session" if far[i] else "none" for i in near}
    rows = [(r.key, r.id, r["at"].replace(tzinfo=timezone.utc) if r["at"].tzinfo is None else r["at"], r.put, True) for r in events.orderBy("at").collect()]
    batches = [rows[: len(rows) // 2], rows[len(rows) // 2 :], [(-1, -1, rows[-1][2] + timedelta(days=2), True, True)], [(-1, -2, rows[-1][2] + timedelta(days=3), True, True)]]
    got = play(rocks, tmp_path, batches, ROWS, lambda s: caches.cache_levels(s, LEVELS, "1 hour"), stops=2)
    assert {r.id: r.level for r in got.collect()} == want


def plain_settled(rows, gap_ms):
    out = []
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1]))
        for r, after in zip(own, [*own[1:], None], strict=True):
            if (after is None or (after[2] - r[2]) > timedelta(milliseconds=gap_ms)) and len(r[3].strip()) >= 2:
                out.append((key, r[1], r[3].strip()))
    return sorted(out)


def test_a_debounced_stream_sends_what_the_batch_sends(spark, tmp_path):
    rng = random.Random(8)
    at, rows = START, []
    for k in range(400):
        at += timedelta(milliseconds=rng.choice([0, 40, 120, 249, 250, 251, 600, 4000]))
        rows.append((rng.randint(1, 3), k, at, rng.choice(["r", " ro", "rom", "  ", "", " x ", "roma"])))
    schema = "key long, id long, at timestamp, text string"
    batch = caches.settled_queries(spark.createDataFrame(rows, schema))
    want = plain_settled(rows, 250)
    assert sorted((r.key, r.id, r.text) for r in batch.collect()) == want
    quiet = START + timedelta(days=1)
    batches = [rows[k : k + 100] for k in range(0, 400, 100)] + [[(7, 900, quiet, "")], [(7, 901, quiet + timedelta(hours=1), "")], [(1, 902, START, "too late")]]
    got = play(spark, tmp_path, batches, schema, lambda s: caches.settled_queries(s, late="5 seconds"), stops=2)
    assert sorted((r.key, r.id, r.text) for r in got.collect()) == want
