import pytest
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(rows, names):
    """Rows as sorted tuples in the order of their column names, numbers rounded to 10 digits."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: format(float(v), ".10g") if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(row[i]) for i in order) for row in rows)


@pytest.fixture(scope="session")
def same():
    def check(df, con, sql):
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(df.columns) == sorted(names)
        assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), names)

    return check
