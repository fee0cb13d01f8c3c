"""Bounded sparse search and the dense index against exhaustive search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalex.operators import search as se
from stratalex.operators import sparse as sp
from stratalex.operators.dense_index import DenseIndex, in_blocks
from stratalex.operators.impact import ImpactIndex, block_of


def plain(df):
    return sorted((r.query_id, r["rank"], r.unit_id, r.score) for r in df.collect())


def corpus(spark, units, seed):
    """Words by Zipf's law in texts of very different lengths, some texts equal."""
    r = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(400)])
    p = 1 / np.arange(1, 401)
    rows = []
    for u in range(units):
        found, n = np.unique(r.choice(words, int(r.lognormal(4, 1.2)) + 1, p=p / p.sum()), return_counts=True)
        rows += [(u, str(t), int(c)) for t, c in zip(found, n)]
    rows += [(units + u, t, c) for u, t, c in rows if u < 40]
    counts = spark.createDataFrame(rows, "unit_id long, token string, tf long")
    asked = [(q, str(t), 1 + int(q % 3 == 0)) for q in range(25) for t in set(r.choice(words, 1 + q, p=p / p.sum()))] + [(90, "unknown", 1), (91, "w399", 1), (91, "unknown", 2)]
    return counts, sp.vocabulary(counts, units + 40).cache(), spark.createDataFrame(asked, "query_id long, token string, qtf long")


@pytest.mark.parametrize("units, k", [(2000, 10), (15, 100)])
def test_bounded_search(spark, units, k):
    counts, vocab, asked = corpus(spark, units, units)
    stats = {}
    got = plain(ImpactIndex(counts, vocab).top_k(asked, k, stats))
    assert got == plain(sp.top_k(counts, asked, vocab, k)) and got
    if units == 2000:
        assert sum(stats.values()) < counts.join(asked, "token").count() / 4


def test_blocks(spark):
    rows = spark.range(1, 5000).select(F.col("id"), block_of(F.col("id")).alias("b")).collect()
    for r in rows:
        assert 2 ** (r.b / 4) <= r.id * (1 + 1e-9) and r.id < 2 ** ((r.b + 1) / 4) * (1 + 1e-9)


def test_nothing_to_search(spark):
    counts, vocab, asked = corpus(spark, 20, 1)
    assert ImpactIndex(counts, vocab).top_k(asked.limit(0), 5).count() == 0
    assert ImpactIndex(counts.limit(0), vocab.limit(0)).top_k(asked, 5).count() == 0


def clustered(n, seed, size=16):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 4, (30, size))
    return [(i, [float(x) for x in centres[i % 30] + r.normal(0, 1, size)]) for i in range(n)]


def test_dense_index(spark):
    rows = clustered(1500, 1) + [(9000, None), (9001, [1.0] * 5), (9002, [0.0] * 16), (9003, clustered(1, 1)[0][1])]
    vectors = spark.createDataFrame(rows, "unit_id long, embedding array<double>").repartition(6)
    asked = vectors.filter("unit_id % 30 = 0").withColumnRenamed("unit_id", "query_id")
    true = plain(se.dense_top_k(asked, vectors, 10, 16))
    index = DenseIndex(vectors, 16)
    assert index.listed.count() == 1502  # every vector of the right length
    probes = index.tuned(10)
    assert 1 <= probes < index.n_lists / 3  # clusters pay
    found = plain(index.top_k(asked, 10))
    hits = {(q, u) for q, _, u, _ in found} & {(q, u) for q, _, u, _ in true}
    assert len(hits) >= 0.9 * len(true)
    scores = {(q, u): x for q, _, u, x in true}
    assert all(scores[q, u] == x for q, _, u, x in found if (q, u) in scores)
    # All lists: the exhaustive result, also where lists and queries are dealt to many tasks.
    assert plain(index.top_k(asked, 10, index.n_lists)) == true
    assert plain(index.top_k(asked, 10, index.n_lists, rows=7, most=3)) == true
    assert plain(se.dense_top_k(asked, vectors, 10, 16, per_pass=20)) == true


def test_small_dense_indexes(spark):
    schema = "unit_id long, embedding array<double>"
    none = spark.createDataFrame([], schema)
    one = spark.createDataFrame([(1, [1.0, 2.0])], schema)
    ask = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert DenseIndex(none, 2).top_k(ask, 3).count() == 0
    assert [(r.query_id, r.unit_id) for r in DenseIndex(one, 2).top_k(ask, 3).collect()] == [(2, 1)]
    assert DenseIndex(one, 2).top_k(ask.limit(0), 3).count() == 0
    listed = [spark.createDataFrame([], f"list int, {schema}") for _ in range(2)]
    assert in_blocks(*listed, 3).count() == 0


def test_counts_of_texts(spark):
    """Texts that share a key or have none are counted together, as one row a token would be."""
    texts = [(1, "b a b  B"), (2, "x"), (2, "x y"), (None, "n m"), (None, "m"), (3, ""), (4, None), (5, "ß É e\u0301 é 12 c")]
    units = spark.createDataFrame(texts, "id long, text string")
    plain = lambda df: sorted((tuple(r) for r in df.select("unit_id", "token", "tf").collect()), key=str)
    for rows in (units, units.filter("id != 2")):
        assert plain(sp.text_counts(rows, "id", "text")) == plain(sp.term_counts(sp.token_rows(rows, "id", "text"))) != []


@pytest.mark.parametrize("kind", ["long", "string"])
def test_search_with_queries_in_the_tasks(spark, kind):
    """The k best kept in each task and the join of queries as a table give the same rows, ties and units over many batches included."""
    r = random.Random(12)
    rows = [(u, f"t{t}", r.randint(1, 3)) for u in range(400) for t in r.sample(range(40), 12)] + [(None, "t1", 2)]
    counts = spark.createDataFrame(rows, "unit_id long, token string, tf long").withColumn("unit_id", F.col("unit_id").cast(kind)).repartition(3)
    vocab = sp.vocabulary(counts, 400)
    asked = spark.createDataFrame([(q, f"t{t}", r.randint(1, 2)) for q in range(9) for t in r.sample(range(44), 6)], "query_id long, token string, qtf int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(map(str, sp.top_k(counts, asked, vocab, 11).select("query_id", "unit_id", "score", "rank").collect()))
        assert got == sorted(map(str, sp.top_k(counts, asked, vocab, 11, most=5).select("query_id", "unit_id", "score", "rank").collect())) and len(got) == 99
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sp.top_k(counts, asked.limit(0), vocab, 3).count() == 0 and sp.top_k(counts.limit(0), asked, vocab, 3).count() == 0


def test_evidence_recall_takes_one_pass(spark):
    """Required pairs are marked where they were found without a join; nulls are never found, repeats count once."""
    from stratalex.operators import evaluation as ev

    required = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 5), (3, None), (None, 7)], "query_id int, item int")
    found = spark.createDataFrame([(1, 1), (1, 1), (2, 5), (3, None), (None, 7), (4, 1)], "query_id int, item int")
    out = ev.evidence_recall(required, found)
    assert {r.query_id: (r.recall, r.complete) for r in out.collect()} == {1: (0.5, False), 2: (1.0, True), 3: (0.0, False), None: (0.0, False)}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_bounded_search_shuffles_wanted_postings_only(spark):
    """Tokens of the queries travel to the postings, none of which are copied; with more queries than may travel the rows are the same."""
    counts, vocab, asked = corpus(spark, 300, 5)
    index = ImpactIndex(counts, vocab)
    assert "Repartition" not in index.postings._jdf.queryExecution().optimizedPlan().toString()
    got = index.top_k(asked, 5)
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
    assert plain(got) == plain(index.top_k(asked, 5, most=3)) == plain(sp.top_k(counts, asked, vocab, 5))
