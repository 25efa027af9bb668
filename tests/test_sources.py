from larder.sources.tables import load_prices, prices_of


def test_prices_of_several_sources(spark, tmp_path):
    rows = [("rice", "Grains", "kg", 1.0, 2.0, "EUR", "*", "Italy", 0.8, 1), ("rice", "Grains", "kg", 1.0, 3.0, "EUR", "Rome", "Italy", 0.9, 2), ("oil", "Fats", "l", 1.0, 0.0, "EUR", "*", "Italy", 0.8, 3)]
    names = ["ingredient", "category", "unit", "quantity", "price", "currency", "city", "country", "confidence", "ord"]
    df = spark.createDataFrame(rows, names)
    df.write.parquet(str(tmp_path / "p"))
    df.withColumn("price", df.price + 5).write.csv(str(tmp_path / "c"), header=True)
    got = load_prices(spark, [("parquet", str(tmp_path / "p")), ("csv", str(tmp_path / "c"))])
    assert sorted((r.ingredient, r.city, r.price) for r in got.collect()) == [("oil", "*", 5.0), ("rice", "*", 2.0), ("rice", "Rome", 3.0)]
    assert prices_of(got, "Rome", "Italy").count() == 3 and prices_of(got, "Milan", "Italy").count() == 2
    assert load_prices(spark, []).count() == 0


def test_a_store_forgets_what_is_deleted(spark, tmp_path):
    from larder.sources import store

    place, row = str(tmp_path / "plans"), "select '{0}' as id, timestamp '{1} 00:00:00' as created_at, '{2}' as label, '{{}}' as plan"
    for i, day, label in (("a", "2024-01-01", "one"), ("b", "2024-01-02", "two"), ("a", "2024-01-03", "one again")):
        store.append(spark.sql(row.format(i, day, label)), place)
    assert sorted((r.id, r.label) for r in store.read(spark, place).collect()) == [("a", "one again"), ("b", "two")]
    store.delete(spark.sql("select 'b' as id"), place)
    store.compact(spark, place, str(tmp_path / "new"))
    assert [(r.id, r.label) for r in store.read(spark, str(tmp_path / "new")).collect()] == [("a", "one again")]
