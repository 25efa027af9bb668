from larder.streaming.events import hourly_counts, latest_values, start_sink

SF = "/root/testdata/sf0.001"


def test_a_stream_ends_where_the_batch_does(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, transform in (("counts", lambda df: hourly_counts(df, "60 days")), ("latest", latest_values)):
        run = transform(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, transform(events).collect()))


def test_a_sink_holds_each_known_event_once(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        start_sink(stream, str(tmp_path / "out"), str(tmp_path / "state"), ("signup", "purchase")).awaitTermination(120)
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert kept.count() == kept.select("event_id").distinct().count() == events.where("event_type in ('signup', 'purchase')").count() > 0
