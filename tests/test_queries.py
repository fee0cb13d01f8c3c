"""Every named query with an oracle returns the oracle's rows; the others return rows."""

import os

import duckdb
import pytest

from stratalex.plans import catalog

DIR = os.environ.get("STRATALEX_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DIR):
        if name.endswith(".parquet"):
            c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DIR}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR)
    want = duck.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert plain(got.select(*columns).collect()) == plain([r[i] for i in at] for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_golden_scores(spark):
    """Two published scores of a 102-unit corpus follow from its document frequencies: tf x idf, idf once."""
    from pyspark.sql import functions as F

    from stratalex.operators.sparse import idf

    df = {"xe": 73, "ô": 5, "tô": 10, "phạt": 58, "tiền": 55}
    rows = [(unit, t, n) for unit, tf in ((1, (4, 2, 2, 2, 1)), (2, (3, 2, 2, 1, 0))) for t, n in zip(df, tf)]
    counts = spark.createDataFrame(rows, "unit_id int, token string, tf int")
    vocab = spark.createDataFrame(list(df.items()), "token string, df int").withColumn("idf", idf(F.lit(102), F.col("df")))
    scores = counts.join(vocab, "token").groupBy("unit_id").agg(F.round(F.sum(F.col("tf") * F.col("idf")), 4).alias("s"))
    assert {r.unit_id: r.s for r in scores.collect()} == {1: 13.5262, 2: 12.0047}
