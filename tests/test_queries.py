import pytest

from larder.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_says_what_its_sql_says(name, spark, duck, same):
    same(catalogue.queries()[name](spark, SF), duck, catalogue.oracle_sql()[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_offer_is_ranked(spark):
    rows = catalogue.queries()["c11_all_offers"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/lineitem.parquet").count() and max(r["rank"] for r in rows) > 5
    assert len({r.l_partkey for r in rows if r.kind < 2}) == sum(r.fastest for r in rows)


def test_words_far_into_a_page_score(spark, tmp_path):
    html = "<title>x</title><p>" + "a " * 300 + "th er</p>"
    spark.createDataFrame([(1, "https://a.example.com/p", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    score = lambda name: catalogue.queries()[name](spark, str(tmp_path)).first().score
    assert (score("w4_score_hits"), score("w4_score_pages")) == (0, 5)


def test_all_parts_are_recipes_and_prices(spark, tmp_path):
    part = spark.createDataFrame([(3, "red ring", "STANDARD", 20, 30.0), (6, "blue bolt", "STANDARD", 20, 60.0)], "p_partkey long, p_name string, p_type string, p_size int, p_retailprice double")
    part.write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 3), (1, 6)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda name: sorted(map(tuple, catalogue.queries()[name](spark, str(tmp_path)).collect()))
    assert run("w3_best_recipe") == [] and [r[:2] for r in run("w3_best_of_all")] == [("blue bolt", 6), ("red ring", 3)]
    assert {r[1] for r in run("c8_recipe_waterfall")} == {"rule"} and {r[1] for r in run("c8_waterfall_of_all")} == {"cache"}
    assert run("c15_recipe_cost") == [(1, 0, 250.0)] and run("c15_cost_of_all") == [(1, 2, 30.0)]
