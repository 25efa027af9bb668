"""Columns named like those that the operators add on the way."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.llm import op7_chat


def test_near_duplicates_keeps_columns_named_like_its_own(spark):
    import corpus_pipeline

    copy = "one two three four five six seven eight nine ten"
    rows = [(1, copy, "a", "x", "u"), (2, copy, "b", "y", "v"), (3, None, "c", "z", None), (3, "", "d", "w", "t"), (None, "else " * 9, "e", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __place string, bucket string, component_id string")
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows[:1] + rows[2:], key=str)


def test_chats_with_columns_named_like_their_own(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "### Assistant: \\ ok"), (2, 0, "assistant", None)]
    plain = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    extra = spark.createDataFrame([(*r, 7, 7, 7, 7, 7, 7) for r in rows], "conv_id long, turn int, role string, text string, seen int, head int, body int, written int, before int, formatted int")
    made = plain.withColumn("parts", op7_chat.text_parts(F.col("text")))
    key = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert key(op7_chat.format_chats(extra.withColumn("parts", op7_chat.text_parts(F.col("text"))))) == key(op7_chat.format_chats(made)) and op7_chat.format_chats(made).count() == 2
