"""Every registered query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from skerry.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return f"{float(value):.6g}" if type(value).__name__ in ("float", "Decimal") else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).limit(1).count() == 1


def test_chunks_and_embeddings_follow_their_texts(spark):
    from skerry.operators import vectors
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "text string").select("text", vectors.hash_embedding(F.col("text")).alias("e")).collect()
    assert rows[0]["e"] == rows[2]["e"] != rows[1]["e"] and all(-1 <= x <= 1 for x in rows[0]["e"])


def test_entry_module_has_all_queries(spark):
    import __spark_entry__

    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(catalogue.ORACLES) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).columns == ["doc_id", "source", "n_chars"]
