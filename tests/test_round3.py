"""Plans and results of the third round's findings: each would have failed before its change."""

import pytest

from larder.plans import catalogue
from tests.conftest import SF


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def run(spark, name, folder=SF):
    return catalogue.queries()[name](spark, str(folder))


def test_a_record_is_parsed_once(spark):
    assert plan_of(run(spark, "s9_wide_recipes")).count("from_json") == 1


@pytest.mark.parametrize("name", ["s1_catalogue_prices", "s2_place_prices", "s2_market_prices", "c1_load_prices"])
def test_key_zero_and_repeated_keys_of_the_catalogue(name, spark, same, tmp_path):
    import duckdb

    parts = [(0, "ring", 50, 900.0), (1, "bolt", 50, 901.0), (10, "gear", 50, 902.0), (7, "anvil", 3, 903.0), (7, "anvil", 3, 903.0)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    for other in ("nation", "lineitem"):
        spark.read.parquet(f"{SF}/{other}.parquet").where("true" if other == "nation" else "l_partkey < 11").write.parquet(f"{tmp_path}/{other}.parquet")
        con.execute(f"CREATE VIEW {other} AS SELECT * FROM '{tmp_path}/{other}.parquet/*.parquet'")
    same(run(spark, name, tmp_path), con, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", ["c7_week_groceries", "c7_week_plan", "s9_wide_recipes"])
def test_one_file_is_many_tasks(name, spark):
    assert run(spark, name).rdd.getNumPartitions() > 8


def test_diets_and_quantities_are_not_read_for_each_customer(spark):
    assert "regexp_extract" not in plan_of(run(spark, "c7_week_groceries")).lower()


def test_texts_are_priced_once_for_each_kind(spark):
    assert "regexp" not in plan_of(run(spark, "c2_price_texts")).lower()


@pytest.mark.parametrize("name", ["j3_cascade", "c2_price_baskets", "c3_cheaper_alternatives"])
def test_only_prices_of_asked_ingredients_are_grouped(name, spark):
    assert "LeftSemi" in plan_of(run(spark, name))


def test_a_spend_of_minus_zero_shows_as_in_sql(spark, same, tmp_path):
    import duckdb

    con = duckdb.connect()
    for name in ("nation", "region", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    people = [(k, k % 5, balance) for k, balance in enumerate((-0.0, 0.0, -0.01, 0.01, 12.5, -0.0, 1000.0))]
    spark.createDataFrame(people, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    same(run(spark, "s16_report_rows", tmp_path), con, catalogue.oracle_sql()["s16_report_rows"])


def test_plans_are_nested_after_one_shuffle(spark):
    df = run(spark, "a8_import_stats")
    df.collect()
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_options_are_made_after_one_shuffle_without_a_window(spark):
    plan = plan_of(run(spark, "c11_buy_options"))
    assert "Window" not in plan and "posexplode(o" in plan


def test_documents_are_read_one_level_at_a_time_by_many_tasks(spark):
    from larder.plans.cook import plan_texts
    from larder.sources import documents

    texts = [(1, "7"), (2, "null"), (3, "[]"), (4, '{"a": null, "b": [{"c": 1}, null, 3]}'), (5, '{"b": {}}'), (6, None)]
    contract = (documents.Field("a", "string", optional=True), documents.Field("b", "array", items="object", fields=(documents.Field("c", "number"),)))
    good, broken = documents.checked(spark.createDataFrame(texts, "id int, document string"), contract, "struct<a: string>")
    assert good.count() == 0 and sorted(map(tuple, broken.collect())) == [
        (1, "$", "expected object"), (2, "$", "expected object"), (3, "$", "expected object"), (4, "$.a", "expected string"), (4, "$.b[1]", "expected object"), (4, "$.b[2]", "expected object"), (5, "$.b", "expected array"), (6, "$", "no JSON"),
    ]
    assert plan_texts(spark, SF).rdd.getNumPartitions() > 8
