import pytest
from pyspark.sql import functions as F

from larder.operators import messages, ranking
from larder.sources.chain import ask_in_turn
from larder.sources.scratch import kept


def test_the_next_source_is_asked_for_what_failed_only(spark):
    requests = spark.createDataFrame([(k, f"r{k}") for k in range(10)] + [(None, "no key")], "id long, said string")
    asked = {}

    def source(name, rows):
        def ask(open_requests):
            asked[name] = sorted(r.id for r in open_requests.where("id is not null").collect())
            return spark.createDataFrame(rows, "id long, answer string").join(open_requests.select("id"), "id", "left_semi")

        return name, ask

    first = source("first", [(k, None if k == 3 else "<html>" if k == 4 else f"a{k}") for k in range(6)])
    second = source("second", [(k, f"b{k}") for k in range(3, 9)])
    got = ask_in_turn(requests, "id", [first, second], lambda a: ~a.startswith("<")).collect()
    assert {r.id: (r.source, r.answer) for r in got} == {0: ("first", "a0"), 1: ("first", "a1"), 2: ("first", "a2"), 5: ("first", "a5"), **{k: ("second", f"b{k}") for k in (3, 4, 6, 7, 8)}, 9: (None, None), None: (None, None)}
    assert asked == {"first": list(range(10)), "second": [3, 4, 6, 7, 8, 9]} and len(got) == 11
    asked.clear()
    some = ask_in_turn(requests.where("id < 3"), "id", [first, second], lambda a: F.lit(True))
    assert some.where("source = 'first'").count() == 3 and "second" not in asked


def test_messages_fall_back_to_english_and_to_the_key(spark):
    catalogue = spark.createDataFrame([("hi", "it", "Ciao {name}"), ("hi", "en", "Hello {name}"), ("bye", "en", "Bye {name} {rest}"), ("bye", "fr", None), ("only", "de", "Nur")], "key string, language string, text string")
    requests = spark.createDataFrame([(1, "hi", "it"), (2, "hi", "fr"), (3, "bye", "fr"), (4, "only", "es"), (5, "none", "it"), (6, None, "it"), (7, "hi", None)], "id int, key string, language string")
    got = messages.spoken(requests, catalogue, F.create_map(F.lit("name"), F.lit("Ada")))
    assert sorted((r.id, r.message, r.spoken) for r in got.collect()) == [(1, "Ciao Ada", "it"), (2, "Hello Ada", "en"), (3, "Bye Ada {rest}", "en"), (4, "only", None), (5, "none", None), (6, None, None), (7, "Hello Ada", "en")]


def test_a_key_of_nine_tenths_spreads_over_tasks(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 > 0, "cold").alias("k"), F.hash("id").alias("h"), F.lit("x").alias("place2"))
    got = ranking.numbered(rows, ["k"], ["h"])
    want = ranking.placed(rows, ["k"], [F.asc("h")])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table would be put together again
    try:
        seen = []
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(ranking, "kept", lambda df: seen.append(kept(df)) or seen[-1])
            ranking.numbered(rows, ["k"], ["h"])
        most = seen[0].groupBy("k", "__part").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most < 6000  # no task ranks the 18,000 rows of the hot key


def test_equal_rows_are_numbered_without_gaps(spark):
    rows = spark.range(500).select(F.lit(1).alias("k"), F.lit(2).alias("h"))
    assert sorted(r.place for r in ranking.numbered(rows, ["k"], ["h"]).collect()) == list(range(1, 501))
    assert ranking.numbered(rows.limit(0), ["k"], ["h"]).collect() == []
