"""Queries of encoding, ranking, fusion, evidence and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.functions.text import tokens
from stratalex.operators import evaluation as ev
from stratalex.operators import search as se
from stratalex.operators import sparse as sp
from stratalex.operators.dense_index import DenseIndex
from stratalex.operators.impact import ImpactIndex
from stratalex.session import table
from stratalex.sources.stored import stored, stored_once

from . import views as v
from .catalog import query

TERMS = ("the", "of", "and")


def _counts(s: SparkSession, d: str) -> DataFrame:
    """Term counts of all texts, built once for each input: all queries read the table."""
    return stored_once(s, "term-counts", f"{d}/documents.parquet", lambda: sp.text_counts(v.documents(s, d), "doc_id", "text"))


def _total(s: SparkSession, d: str) -> int:
    return v.documents(s, d).count()


def _vocab(s: SparkSession, d: str, counts: DataFrame) -> DataFrame:
    """A table of its own: joins with the counts then shuffle both sides plainly, and the rows of a common token are split."""
    return stored_once(s, "vocabulary", f"{d}/documents.parquet", lambda: sp.vocabulary(counts, _total(s, d)))


def _queries(s: SparkSession, d: str) -> DataFrame:
    rows = sp.token_rows(table(s, d, "benchmark"), "item_id", "text")
    return rows.groupBy(F.col("unit_id").alias("query_id"), "token").agg(F.count("*").alias("qtf"))


_NORMS = """norms AS (SELECT vec_id, label, embedding, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)"""
_VALID = "valid AS (SELECT doc_id FROM documents WHERE DATE '2020-01-01' + CAST(doc_id % 900 AS INTEGER) <= DATE '2021-06-01' AND (doc_id % 4 = 0 OR DATE '2021-06-01' < DATE '2020-01-01' + CAST(doc_id % 900 + 400 AS INTEGER)))"


@query(
    rf"""WITH {v.TOKENS}, {_VALID}, {_NORMS}, sparse AS (SELECT unit_id, row_number() OVER (ORDER BY round(sum(tf * idf), 6) DESC, unit_id) AS rank FROM tf JOIN vocab USING (token) WHERE token IN ('the', 'of', 'and') AND unit_id IN (SELECT doc_id FROM valid) GROUP BY unit_id QUALIFY rank <= 30),
    dense AS (SELECT u.vec_id AS unit_id, row_number() OVER (ORDER BY round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(u.embedding AS DOUBLE[])) / (q.n * u.n), 6) DESC, u.vec_id) AS rank FROM norms q, norms u WHERE q.vec_id = 0 AND u.vec_id != 0 AND u.vec_id IN (SELECT doc_id FROM valid) QUALIFY rank <= 30),
    parts AS (SELECT unit_id, 1.0 / (60 + rank) AS part FROM sparse UNION ALL SELECT unit_id, 1.0 / (60 + rank) FROM dense)
    SELECT unit_id, round(sum(part), 6) AS score, count(*) AS lists, CAST(row_number() OVER (ORDER BY round(sum(part), 6) DESC, unit_id) AS INTEGER) AS rank FROM parts GROUP BY unit_id QUALIFY rank <= 10"""
)
def hybrid_valid_at(s: SparkSession, d: str) -> DataFrame:
    """Ten best units among those valid on a date: tf-idf of given terms and cosine to a given vector, fused by rank."""
    from stratalex.operators.temporal import valid_on

    docs, e = v.documents(s, d), table(s, d, "embeddings")
    dated = docs.select("doc_id", F.date_add(F.to_date(F.lit("2020-01-01")), (F.col("doc_id") % 900).cast("int")).alias("effective_from")).withColumn("effective_to", F.when(F.col("doc_id") % 4 != 0, F.date_add("effective_from", 400)))
    valid = dated.filter(valid_on(F.to_date(F.lit("2021-06-01")))).select(F.col("doc_id").alias("unit_id"))
    counts = stored(sp.counts_of(docs, "doc_id", "text", TERMS), "given-counts")
    ask = s.createDataFrame([(0, t, 1) for t in TERMS], "query_id bigint, token string, qtf int")
    sparse = sp.top_k(counts.join(valid, "unit_id", "left_semi"), ask, sp.vocabulary(counts, docs.count()), 30)
    dense = se.dense_top_k(e.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("unit_id"), "embedding").join(valid, "unit_id", "left_semi"), 30, 64)
    return se.fuse([x.select("query_id", "unit_id", "rank") for x in (sparse, dense)], limit=10).select("unit_id", "score", "lists", "rank")


@query(rf"WITH {v.TOKENS} SELECT token, count(DISTINCT unit_id) AS df, count(*) AS cf FROM tokens GROUP BY token")
def tokenize_df(s: SparkSession, d: str) -> DataFrame:
    return _counts(s, d).groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(rf"WITH {v.TOKENS} SELECT token, df, round(idf, 6) AS idf, row_number() OVER (ORDER BY token) AS token_id FROM vocab")
def idf_table(s: SparkSession, d: str) -> DataFrame:
    return sp.numbered(_vocab(s, d, _counts(s, d))).select("token", "df", F.round("idf", 6).alias("idf"), "token_id")


@query(rf"WITH {v.TOKENS} SELECT unit_id, token, round(tf * idf, 6) AS weight FROM tf JOIN vocab USING (token)")
def sparse_weights(s: SparkSession, d: str) -> DataFrame:
    counts = _counts(s, d)
    return sp.weights(counts, _vocab(s, d, counts)).withColumn("weight", F.round("weight", 6))


@query(
    rf"""WITH {v.TOKENS}, numbered AS (SELECT token, idf, row_number() OVER (ORDER BY token) AS token_id FROM vocab)
    SELECT unit_id, string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY token_id) AS indices, count(*) AS n FROM tf JOIN numbered USING (token) GROUP BY unit_id"""
)
def sparse_wire_format(s: SparkSession, d: str) -> DataFrame:
    counts = _counts(s, d)
    vocab = stored(sp.numbered(_vocab(s, d, counts)), "numbered")
    wire = sp.wire(counts.join(vocab, "token").select("unit_id", "token_id", (F.col("tf") * F.col("idf")).alias("weight")))
    return wire.select("unit_id", F.concat_ws(",", F.transform("indices", lambda x: x.cast("string"))).alias("indices"), F.size("values").cast("long").alias("n"))


@query(
    rf"""WITH {v.TOKENS}, frozen AS (SELECT token FROM (SELECT DISTINCT token FROM tokens WHERE unit_id % 2 = 0) UNION SELECT 'zzzunseen'), half AS (SELECT token, count(*) AS df FROM tf WHERE unit_id % 2 = 1 GROUP BY token)
    SELECT f.token, coalesce(df, 0) AS df, CASE WHEN df IS NULL THEN 1.0 ELSE round(ln(1 + ((SELECT count(*) FROM documents WHERE doc_id % 2 = 1) - df + 0.5) / (df + 0.5)), 6) END AS idf FROM frozen f LEFT JOIN half USING (token)"""
)
def frozen_vocabulary(s: SparkSession, d: str) -> DataFrame:
    counts = _counts(s, d)
    frozen = counts.filter("unit_id % 2 = 0").select("token").union(s.createDataFrame([("zzzunseen",)], "token string")).distinct()
    today = v.documents(s, d).filter("doc_id % 2 = 1").count()
    return sp.refreshed(frozen, counts.filter("unit_id % 2 = 1"), today).select("token", "df", F.round("idf", 6).alias("idf"))


_SPARSE = rf"""{v.TOKENS}, {v.QUERIES}, sparse AS (SELECT query_id, unit_id, round(sum(tf * idf * qtf), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(tf * idf * qtf), 6) DESC, unit_id) AS rank
    FROM tf JOIN vocab USING (token) JOIN query USING (token) GROUP BY query_id, unit_id QUALIFY rank <= 30)"""


@query(rf"WITH {_SPARSE} SELECT query_id, unit_id, score, CAST(rank AS INTEGER) AS rank FROM sparse WHERE rank <= 10")
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    counts = _counts(s, d)
    return sp.top_k(counts, _queries(s, d), _vocab(s, d, counts), 10).select("query_id", "unit_id", "score", "rank")


_DENSE = f"""{_NORMS}, dense AS (SELECT q.vec_id AS query_id, u.vec_id AS unit_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(u.embedding AS DOUBLE[])) / (q.n * u.n), 6) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(u.embedding AS DOUBLE[])) / (q.n * u.n), 6) DESC, u.vec_id) AS rank
    FROM norms q JOIN norms u ON q.vec_id != u.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 30)"""


def _dense(s: SparkSession, d: str, k: int) -> DataFrame:
    e = table(s, d, "embeddings")
    return se.dense_top_k(e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("unit_id"), "embedding"), k, 64)


@query(f"WITH {_DENSE} SELECT query_id, unit_id, score, CAST(rank AS INTEGER) AS rank FROM dense WHERE rank <= 10")
def dense_topk(s: SparkSession, d: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 100, held against all vectors."""
    return _dense(s, d, 10)


_NEAR = """near AS (SELECT i.item_id AS query_id, u.vec_id AS unit_id, row_number() OVER (PARTITION BY i.item_id ORDER BY round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(u.embedding AS DOUBLE[])) / (q.n * u.n), 6) DESC, u.vec_id) AS rank
    FROM benchmark i JOIN norms q ON q.vec_id = i.item_id JOIN norms u ON u.vec_id != q.vec_id QUALIFY rank <= 30)"""
_FUSED = rf"""{_SPARSE}, {_NORMS}, {_NEAR}, parts AS (SELECT query_id, unit_id, 0 AS source, 1.0 / (60 + rank) AS part, rank FROM sparse UNION ALL SELECT query_id, unit_id, 1, 1.0 / (60 + rank), rank FROM near),
    fused AS (SELECT query_id, unit_id, round(sum(part), 6) AS score, count(*) AS lists, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(part), 6) DESC, unit_id) AS place FROM parts GROUP BY query_id, unit_id QUALIFY place <= 20)"""


def _sparse_list(s: SparkSession, d: str) -> DataFrame:
    counts = _counts(s, d)
    return sp.top_k(counts, _queries(s, d), _vocab(s, d, counts), 30).select("query_id", "unit_id", "rank")


def _lists(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The best units of each benchmark item by its words, and by the vector that has the item's id."""
    e = table(s, d, "embeddings")
    asked = e.join(table(s, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    return _sparse_list(s, d), se.dense_top_k(asked, e.select(F.col("vec_id").alias("unit_id"), "embedding"), 30, 64).select("query_id", "unit_id", "rank")


@query(rf"WITH {_FUSED} SELECT query_id, unit_id, score, lists, CAST(place AS INTEGER) AS rank FROM fused")
def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    return se.fuse(list(_lists(s, d)))


@query(rf"WITH {_FUSED} SELECT query_id, unit_id % 50 AS provision_id, CAST(min(rank) AS INTEGER) AS rank, string_agg(DISTINCT CASE source WHEN 0 THEN 'a' ELSE 'b' END, ',' ORDER BY CASE source WHEN 0 THEN 'a' ELSE 'b' END) AS sources FROM parts GROUP BY 1, 2")
def candidate_dedupe(s: SparkSession, d: str) -> DataFrame:
    a, b = _lists(s, d)
    every = a.withColumn("source", F.lit("a")).unionByName(b.withColumn("source", F.lit("b"))).withColumn("provision_id", F.col("unit_id") % 50)
    return se.dedupe_candidates(every).withColumn("sources", F.concat_ws(",", "sources"))


@query(rf"WITH {_SPARSE} SELECT query_id, unit_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN unit_id % 7 = query_id % 7 THEN 0 ELSE 1 END, rank, unit_id) AS INTEGER) AS promoted FROM sparse")
def exact_promotion(s: SparkSession, d: str) -> DataFrame:
    return se.promote_exact(_sparse_list(s, d), F.col("unit_id") % 7 == F.col("query_id") % 7).select("query_id", "unit_id", "promoted")


@query(
    rf"""WITH {_SPARSE}, sized AS (SELECT query_id, unit_id, rank, n_chars // 4 AS tokens FROM sparse JOIN documents ON unit_id = doc_id), run AS (SELECT *, sum(tokens) OVER w AS running, count(*) OVER w AS place FROM sized WINDOW w AS (PARTITION BY query_id ORDER BY rank, unit_id ROWS UNBOUNDED PRECEDING))
    SELECT query_id, unit_id, CAST(running AS BIGINT) AS running FROM run WHERE running <= 12000 AND place <= 10"""
)
def context_budget(s: SparkSession, d: str) -> DataFrame:
    sizes = v.documents(s, d).select(F.col("doc_id").alias("unit_id"), F.expr("n_chars div 4").alias("tokens"))
    return se.within_budget(_sparse_list(s, d).join(sizes, "unit_id")).select("query_id", "unit_id", "running")


_EVIDENCE = {"amount": r"[0-9]+", "reference": r"(?i)\bthe\b", "definition": r"(?i)\bis\b", "exception": r"(?i)\bnot\b", "period": r"(?i)\bon\b", "subject": r"(?i)\bfor\b", "sanction": r"[#*$%]"}


@query(
    "WITH c AS (SELECT doc_id, "
    + ", ".join(f"regexp_matches(text, '{p.replace(chr(92) + 'b', chr(92) + 'b')}') AS {n}" for n, p in _EVIDENCE.items())
    + " FROM documents) SELECT doc_id, concat_ws(',', "
    + ", ".join(f"CASE WHEN NOT {n} THEN '{n}' END" for n in sorted(("amount", "definition", "reference")))
    + ") AS missing, amount AND definition AND reference AS complete FROM c"
)
def evidence_gate(s: SparkSession, d: str) -> DataFrame:
    covered = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for n, p in _EVIDENCE.items()]))
    gap = se.evidence_gap(F.array(*[F.lit(n) for n in ("amount", "reference", "definition")]), covered)
    return v.documents(s, d).select("doc_id", gap.alias("gap")).select("doc_id", F.concat_ws(",", "gap").alias("missing"), (F.size("gap") == 0).alias("complete"))


@query(
    """SELECT d.doc_id, coalesce(n_chars > 300, false) AND coalesce(lang = 'en', false) AND coalesce(quality = 1, false) AND coalesce(toxic = 0, false) AND text NOT LIKE '%token%' AND coalesce(n_chars < 5000, false) AS passed FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def verification_layers(s: SparkSession, d: str) -> DataFrame:
    joined = v.documents(s, d).join(table(s, d, "labels"), "doc_id", "left")
    layers = (F.col("n_chars") > 300, F.col("lang") == "en", F.col("quality") == 1, F.col("toxic") == 0, ~F.col("text").contains("token"), F.col("n_chars") < 5000)
    return joined.select("doc_id", se.verified(*layers).alias("passed"))


@query(rf"WITH {_SPARSE} SELECT query_id, unit_id, score, CAST(rank AS INTEGER) AS rank FROM sparse WHERE rank <= 10")
def bounded_topk(s: SparkSession, d: str) -> DataFrame:
    """The rows of ``bm25_topk`` by blocks of impact and a threshold for each query."""
    counts = _counts(s, d)
    return ImpactIndex(counts, _vocab(s, d, counts)).top_k(_queries(s, d), 10).select("query_id", "unit_id", "score", "rank")


@query(
    rf"""WITH {v.TOKENS}, {v.QUERIES} SELECT CAST((SELECT count(*) FROM tf JOIN query USING (token)) AS BIGINT) AS exhaustive, true AS fewer"""
)
def bounded_topk_rows(s: SparkSession, d: str) -> DataFrame:
    """Rows that the exhaustive search joins, and whether the bounded one joins fewer; its own number depends on the plan, not the data alone."""
    counts, asked = _counts(s, d), _queries(s, d)
    stats: dict[str, int] = {}
    vocab = _vocab(s, d, counts)
    ImpactIndex(counts, vocab).top_k(asked, 10, stats)
    # A query's token joins as many postings as units have it.
    exhaustive = vocab.join(asked, "token").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("exhaustive"))
    return exhaustive.withColumn("fewer", F.lit(sum(stats.values())) < F.col("exhaustive"))


@query(
    """WITH q AS (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0 AND len(embedding) = 64), n AS (SELECT count(*) AS n FROM embeddings WHERE len(embedding) = 64) SELECT count(*) AS queries, CAST(sum(least(10, n - 1)) AS BIGINT) AS neighbours, true AS enough FROM q, n"""
)
def dense_index_recall(s: SparkSession, d: str) -> DataFrame:
    """Whether the inverted lists, every vector in them, find nine tenths of the true neighbours of the stated queries."""
    e = table(s, d, "embeddings")
    asked, vectors = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("unit_id"), "embedding")
    true = stored(se.dense_top_k(asked, vectors, 10, 64).select("query_id", "unit_id"), "dense-true")
    found = DenseIndex(vectors, 64).top_k(asked, 10).select("query_id", "unit_id", F.lit(1).alias("hit"))
    each = true.join(found, ["query_id", "unit_id"], "left").agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("neighbours"), F.count("hit").alias("hits"))
    return each.select("queries", "neighbours", (F.col("hits") >= 0.9 * F.col("neighbours")).alias("enough"))


@query(None)
def dense_index_topk(s: SparkSession, d: str) -> DataFrame:
    """The nearest vectors of the stated queries by inverted lists; scores are exact, the candidates are not all."""
    e = table(s, d, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return DenseIndex(e.select(F.col("vec_id").alias("unit_id"), "embedding"), 64).top_k(asked, 10)


_RELEVANT = "relevant AS (SELECT q.vec_id AS query_id, u.vec_id AS unit_id FROM embeddings q JOIN embeddings u ON q.label = u.label AND q.vec_id != u.vec_id WHERE q.vec_id % 100 = 0)"


@query(
    f"""WITH {_DENSE}, {_RELEVANT}, hits AS (SELECT query_id, count(*) AS hits, min(rank) AS best, sum(1 / log2(rank + 1)) AS dcg FROM dense JOIN relevant USING (query_id, unit_id) WHERE rank <= 10 GROUP BY query_id),
    total AS (SELECT query_id, count(*) AS total FROM relevant GROUP BY query_id), ideal AS (SELECT query_id, sum(1 / log2(i + 1)) AS ideal FROM (SELECT query_id, unnest(range(1, least(10, total) + 1)) AS i FROM total) GROUP BY query_id)
    SELECT query_id, round(coalesce(hits, 0) / total, 6) AS recall, round(coalesce(1 / best, 0.0), 6) AS mrr, round(coalesce(dcg / ideal, 0.0), 6) AS ndcg FROM total JOIN ideal USING (query_id) LEFT JOIN hits USING (query_id)"""
)
def retrieval_metrics(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select("vec_id", "label")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return ev.scores_by_label(_dense(s, d, 10), asked, e.select(F.col("vec_id").alias("unit_id"), "label"))


@query(
    """WITH g AS (SELECT DISTINCT o_orderpriority AS priority, o_custkey FROM orders WHERE o_orderkey % 2 = 0), f AS (SELECT DISTINCT o_orderpriority AS priority, o_custkey FROM orders WHERE o_orderkey % 3 = 0),
    b AS (SELECT coalesce(g.priority, f.priority) AS priority, g.o_custkey IS NOT NULL AS ing, f.o_custkey IS NOT NULL AS inf FROM g FULL JOIN f ON g.priority = f.priority AND g.o_custkey = f.o_custkey),
    c AS (SELECT priority, count(*) FILTER (ing AND inf) AS tp, count(*) FILTER (NOT ing AND inf) AS fp, count(*) FILTER (ing AND NOT inf) AS fn FROM b GROUP BY priority)
    SELECT priority, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""
)
def prf_by_level(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_orderpriority").alias("priority"), "o_custkey", "o_orderkey")
    return ev.set_scores(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0"), "priority", "o_custkey")


@query("SELECT source, round(sum(a) / sum(b), 6) AS pooled, round(avg(a / b), 6) AS mean, count(*) AS n FROM (SELECT source, CAST(n_chars % 97 AS DOUBLE) AS a, n_chars % 101 AS b FROM documents) WHERE b > 0 GROUP BY source")
def pooled_metrics(s: SparkSession, d: str) -> DataFrame:
    m = v.documents(s, d).select("source", (F.col("n_chars") % 97).cast("double").alias("numerator"), (F.col("n_chars") % 101).alias("denominator"))
    return ev.pooled(m, "source")


@query(
    """WITH r AS (SELECT quality = 0 AS truth, n_chars < 600 AS guess FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (truth AND guess) AS tp, count(*) FILTER (NOT truth AND guess) AS fp, count(*) FILTER (truth AND NOT guess) AS fn, count(*) FILTER (NOT truth AND NOT guess) AS tn FROM r)
    SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""
)
def abstention_metrics(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "labels").join(v.documents(s, d), "doc_id")
    return ev.confusion(rows, F.col("quality") == 0, F.col("n_chars") < 600)


@query(
    """WITH q AS (SELECT DISTINCT l_orderkey AS query_id, l_suppkey AS item FROM lineitem), f AS (SELECT DISTINCT l_orderkey AS query_id, l_suppkey AS item FROM lineitem WHERE l_linenumber != 2)
    SELECT query_id, round(avg(CASE WHEN f.item IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS recall, count(f.item) = count(*) AS complete FROM q LEFT JOIN f USING (query_id, item) GROUP BY query_id"""
)
def citation_metrics(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("item"), "l_linenumber")
    return ev.evidence_recall(lines.select("query_id", "item"), lines.filter("l_linenumber != 2"))


@query(f"WITH {v.PROVISIONS} SELECT priority, round(avg(CASE WHEN effective_from <= DATE '{v.DAY}' AND (effective_to IS NULL OR DATE '{v.DAY}' < effective_to) THEN 1.0 ELSE 0.0 END), 6) AS validity, count(*) AS n FROM provisions WHERE review_status = 'ACCEPTED' GROUP BY priority")
def temporal_metrics(s: SparkSession, d: str) -> DataFrame:
    from stratalex.operators.temporal import valid_on

    p = v.provisions(s, d).filter("review_status = 'ACCEPTED'")
    return p.groupBy("priority").agg(F.round(F.avg(F.coalesce(valid_on(F.to_date(F.lit(v.DAY))), F.lit(False)).cast("double")), 6).alias("validity"), F.count("*").alias("n"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(s: SparkSession, d: str) -> DataFrame:
    return ev.latency(table(s, d, "events"), "event_type", "value")


@query(r"SELECT conv_id, CAST(sum(len(regexp_extract_all(lower(text), '([\p{L}\p{Nl}\p{No}]+)', 1))) AS BIGINT) AS tokens, count(*) AS turns, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS requests FROM conversations GROUP BY conv_id")
def usage_accounting(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "conversations")
    return t.groupBy("conv_id").agg(F.sum(F.size(tokens(F.col("text"))).cast("long")).alias("tokens"), F.count("*").alias("turns"), F.sum((F.col("role") == "user").cast("long")).alias("requests"))
