"""Queries over versions, relations, constraints, the index and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.operators import index as ix
from stratalex.operators import temporal as tm
from stratalex.operators import validation as va
from stratalex.session import table
from stratalex.sources.stored import shared_folder
from stratalex.streaming import jobs

from . import views as v
from .catalog import query

DAY = f"DATE '{v.DAY}'"
VALID = f"review_status = 'ACCEPTED' AND effective_from <= {DAY} AND (effective_to IS NULL OR {DAY} < effective_to)"


def day():
    return F.to_date(F.lit(v.DAY))


@query(f"WITH {v.PROVISIONS} SELECT provision_id, version, row_id FROM provisions WHERE {VALID}")
def valid_at(s: SparkSession, d: str) -> DataFrame:
    return tm.valid_versions(v.provisions(s, d), day()).select("provision_id", "version", "row_id")


@query(
    f"""WITH {v.PROVISIONS}, points AS (SELECT o_orderkey AS point_id, 'nd-' || (o_custkey % 100) || '-2024__dieu-' || o_custkey AS provision_id, CAST(o_orderdate AS DATE) + 40 AS day FROM orders)
    SELECT point_id, p.provision_id, day, version FROM points p LEFT JOIN provisions q ON p.provision_id = q.provision_id AND q.review_status = 'ACCEPTED' AND q.effective_from <= day AND (q.effective_to IS NULL OR day < q.effective_to)"""
)
def asof_join(s: SparkSession, d: str) -> DataFrame:
    p = v.provisions(s, d)
    points = p.select(F.col("row_id").alias("point_id"), "provision_id", F.date_add("effective_from", 40).alias("day"))
    one_a_day = F.row_number().over(tm.W.partitionBy("provision_id", "effective_from", "review_status").orderBy(F.desc("version")))
    return tm.as_of(points, p.withColumn("_n", one_a_day).filter("effective_to is null or effective_to > effective_from").drop("_n"), "provision_id", "day")


@query(f"WITH {v.PROVISIONS}, {v.EDGES} SELECT DISTINCT source_row FROM edges e WHERE review_status = 'ACCEPTED' AND EXISTS (SELECT 1 FROM provisions WHERE row_id = e.target_row AND {VALID})")
def valid_versions_semi(s: SparkSession, d: str) -> DataFrame:
    good = tm.valid_versions(v.provisions(s, d), day()).select(F.col("row_id").alias("target_row"))
    return v.edges(s, d).filter("review_status = 'ACCEPTED'").join(good, "target_row", "left_semi").select("source_row").distinct()


@query(f"WITH {v.PROVISIONS} SELECT provision_id, CAST(coalesce(max(version) + 1, 1) AS INTEGER) AS next_version FROM provisions GROUP BY 1")
def next_version(s: SparkSession, d: str) -> DataFrame:
    return tm.next_version(v.provisions(s, d))


@query(f"WITH {v.PROVISIONS} SELECT provision_id, version, row_id FROM provisions QUALIFY row_number() OVER (PARTITION BY provision_id ORDER BY effective_from DESC, row_id DESC) = 1")
def latest_version(s: SparkSession, d: str) -> DataFrame:
    return tm.latest(v.provisions(s, d), "provision_id", "effective_from", "row_id").select("provision_id", "version", "row_id")


_SHIFTED = "shifted AS (SELECT *, CASE WHEN row_id % 9 = 0 THEN effective_to + 30 ELSE effective_to END AS new_to FROM provisions WHERE review_status = 'ACCEPTED')"


@query(f"""WITH {v.PROVISIONS}, {_SHIFTED}, reach AS (SELECT *, max(coalesce(new_to, DATE '9999-12-31')) OVER (PARTITION BY provision_id ORDER BY effective_from, version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM shifted)
    SELECT provision_id, version FROM reach WHERE effective_from < reach""")
def overlap_violations(s: SparkSession, d: str) -> DataFrame:
    p = v.provisions(s, d).withColumn("effective_to", F.when(F.col("row_id") % 9 == 0, F.date_add("effective_to", 30)).otherwise(F.col("effective_to")))
    return tm.overlaps(p).select("provision_id", "version")


@query(f"WITH {v.PROVISIONS} SELECT provision_id, version, effective_from, lead(effective_from) OVER w AS effective_to, lead(version) OVER w AS superseded_by_version FROM provisions WINDOW w AS (PARTITION BY provision_id ORDER BY effective_from, version)")
def supersede_intervals(s: SparkSession, d: str) -> DataFrame:
    return tm.superseded(v.provisions(s, d).drop("effective_to")).select("provision_id", "version", "effective_from", "effective_to", "superseded_by_version")


_RELATED = f"""good AS (SELECT source_row, target_row, relation_type FROM edges WHERE review_status = 'ACCEPTED' AND resolution_status = 'RESOLVED'), ends AS (SELECT row_id FROM provisions WHERE {VALID}),
    steps AS (SELECT source_row AS seed, target_row AS other, relation_type, 'outbound' AS direction FROM good UNION ALL SELECT target_row, source_row, relation_type, 'inbound' FROM good),
    valid_steps AS (SELECT * FROM steps WHERE other IN (SELECT row_id FROM ends))"""


@query(f"WITH {v.PROVISIONS}, {v.EDGES}, {_RELATED} SELECT seed, other, relation_type, direction FROM valid_steps WHERE seed IN (SELECT row_id FROM ends)")
def related_provisions(s: SparkSession, d: str) -> DataFrame:
    p = v.provisions(s, d)
    return tm.related(tm.valid_versions(p, day()).select("row_id"), v.edges(s, d), p, day())


@query(
    f"""WITH {v.PROVISIONS}, {v.EDGES}, {_RELATED}, capped AS (SELECT DISTINCT seed, other FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY relation_type, direction, other) AS n FROM valid_steps) WHERE n <= 5),
    one AS (SELECT seed AS origin, other AS row_id, 1 AS depth FROM capped WHERE seed IN (SELECT row_id FROM ends WHERE row_id % 5 = 0)), two AS (SELECT o.origin, c.other AS row_id, 2 AS depth FROM one o JOIN capped c ON o.row_id = c.seed),
    every AS (SELECT origin, row_id, min(depth) AS depth FROM (SELECT * FROM one UNION ALL SELECT * FROM two) WHERE origin != row_id GROUP BY ALL)
    SELECT origin, row_id, depth, CAST(row_number() OVER (PARTITION BY origin ORDER BY depth, row_id) AS INTEGER) AS place FROM every QUALIFY place <= 10"""
)
def expand_depth2(s: SparkSession, d: str) -> DataFrame:
    p = v.provisions(s, d)
    return tm.expand(tm.valid_versions(p, day()).filter("row_id % 5 = 0").select("row_id"), v.edges(s, d), p, day())


@query(
    f"""WITH {v.PROVISIONS}, {v.EDGES}, docs AS (SELECT e.*, p.document_no AS source_doc, q.document_no AS target_doc FROM edges e JOIN provisions p ON e.source_row = p.row_id JOIN provisions q ON e.target_row = q.row_id WHERE e.review_status = 'ACCEPTED'
    AND q.review_status = 'ACCEPTED' AND q.effective_from <= {DAY} AND (q.effective_to IS NULL OR {DAY} < q.effective_to)) SELECT source_doc, target_doc, relation_type, count(*) AS n FROM docs GROUP BY ALL"""
)
def related_documents(s: SparkSession, d: str) -> DataFrame:
    p = v.provisions(s, d)
    source = p.select(F.col("row_id").alias("source_row"), F.col("document_no").alias("source_doc"))
    target = tm.valid_versions(p, day()).select(F.col("row_id").alias("target_row"), F.col("document_no").alias("target_doc"))
    e = v.edges(s, d).filter("review_status = 'ACCEPTED'")
    return e.join(source, "source_row").join(target, "target_row").groupBy("source_doc", "target_doc", "relation_type").agg(F.count("*").alias("n"))


@query(
    f"""WITH {v.EDGES} SELECT 'repeated' AS rule, count(*) AS n FROM (SELECT source_row, target_row, relation_type FROM edges WHERE resolution_status = 'RESOLVED' GROUP BY ALL HAVING count(*) > 1)
    UNION ALL SELECT 'dangling', count(*) FROM edges WHERE target_row NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 != 0)"""
)
def constraint_violations(s: SparkSession, d: str) -> DataFrame:
    e = v.edges(s, d)
    twice = va.repeated(e.filter("resolution_status = 'RESOLVED'"), "source_row", "target_row", "relation_type").agg(F.count("*").alias("n")).select(F.lit("repeated").alias("rule"), "n")
    lost = va.dangling(e, "target_row", table(s, d, "orders").filter("o_orderkey % 3 != 0"), "o_orderkey").agg(F.count("*").alias("n")).select(F.lit("dangling").alias("rule"), "n")
    return twice.unionByName(lost)


@query(f"WITH {v.INDEX} SELECT coalesce(a.point_id, i.point_id) AS point_id, CASE WHEN i.point_id IS NULL THEN 'missing' WHEN a.point_id IS NULL THEN 'extra' ELSE 'stale' END AS state FROM authority a FULL JOIN snapshot i ON a.point_id = i.point_id WHERE i.point_id IS NULL OR a.point_id IS NULL OR i.content_hash IS NULL OR a.content_hash != i.content_hash")
def index_diff(s: SparkSession, d: str) -> DataFrame:
    return ix.diff(v.authority(s, d), v.index_snapshot(s, d))


@query(f"WITH {v.INDEX} SELECT point_id, content_hash FROM authority")
def index_reconcile(s: SparkSession, d: str) -> DataFrame:
    return ix.reconciled(v.authority(s, d), v.index_snapshot(s, d))


@query(f"WITH {v.INDEX} SELECT count(*) AS expected, (SELECT count(*) FROM snapshot s WHERE EXISTS (SELECT 1 FROM authority a WHERE a.point_id = s.point_id AND a.content_hash = s.content_hash)) AS current, count(*) = (SELECT count(*) FROM snapshot) AS complete FROM authority")
def index_rebuild_check(s: SparkSession, d: str) -> DataFrame:
    a, i = v.authority(s, d).withColumn("side", F.lit(1)), v.index_snapshot(s, d).withColumn("side", F.lit(2))
    both = a.unionByName(i).groupBy("point_id").agg(F.sum((F.col("side") == 1).cast("long")).alias("a"), F.sum((F.col("side") == 2).cast("long")).alias("i"), F.count("content_hash").alias("h"), F.countDistinct("content_hash").alias("kinds"))
    same = (F.col("a") == 1) & (F.col("i") == 1) & (F.col("h") == 2) & (F.col("kinds") == 1)
    return both.agg(F.sum("a").alias("expected"), F.sum(same.cast("long")).alias("current"), (F.sum("a") == F.sum("i")).alias("complete"))


@query(f"WITH {v.PROVISIONS} SELECT provision_id || '__v' || version AS unit_id, sha256(provision_id || '__v' || version) AS point_id, split_part(provision_id, '__', 1) AS document_id, content_hash FROM provisions WHERE review_status = 'ACCEPTED'")
def unit_projection(s: SparkSession, d: str) -> DataFrame:
    return ix.units(v.provisions(s, d)).select("unit_id", "point_id", "document_id", "content_hash")


@query("SELECT text AS unit_text, min(doc_id) AS position, max(doc_id) AS doc_id FROM documents GROUP BY text")
def last_wins_dedupe(s: SparkSession, d: str) -> DataFrame:
    docs = v.documents(s, d).select(F.col("text").alias("unit_text"), "doc_id")
    return ix.last_wins(docs, "unit_text", "doc_id").select("unit_text", "position", "doc_id")


@query("SELECT doc_id, sha256('m1' || chr(0) || text) AS cache_key FROM documents WHERE doc_id % 3 != 0")
def embedding_cache_misses(s: SparkSession, d: str) -> DataFrame:
    from stratalex.functions.text import cache_key

    docs = v.documents(s, d).select("doc_id", cache_key(F.lit("m1"), F.col("text")).alias("cache_key"))
    known = v.documents(s, d).filter("doc_id % 3 = 0").select("doc_id")
    return docs.join(known, "doc_id", "left_anti")


@query(
    f"""WITH {v.MESSAGES}, marked AS (SELECT *, max(place) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= place AS old FROM messages)
    SELECT job_id, ['RECEIVED', 'PARSED', 'NORMALIZED', 'EXTRACTED', 'STAGED'][max(place) + 1] AS stage, count(*) AS messages, CAST(sum(CASE WHEN old THEN 1 ELSE 0 END) AS BIGINT) AS redeliveries FROM marked GROUP BY job_id"""
)
def job_status(s: SparkSession, d: str) -> DataFrame:
    return jobs.job_status(v.messages(s, d))


@query(
    f"""WITH {v.MESSAGES}, f AS (SELECT event_id, job_id, stage, ts, value < 50 AS transient, row_number() OVER (PARTITION BY job_id, stage ORDER BY ts, event_id) AS attempt FROM messages WHERE stage = 'STAGED')
    SELECT event_id, CAST(attempt AS INTEGER) AS attempt, CASE WHEN transient AND attempt < 3 THEN 'retry' ELSE 'dead_letter' END AS outcome, CASE WHEN transient AND attempt < 3 THEN CAST(15 * pow(2, attempt - 1) AS BIGINT) END AS wait_s FROM f"""
)
def job_retry_dlq(s: SparkSession, d: str) -> DataFrame:
    failures = v.messages(s, d).filter("stage = 'STAGED'").withColumn("transient", F.col("value") < 50)
    return jobs.retry_plan(failures).select("event_id", "attempt", "outcome", "wait_s")


@query(f"WITH {v.MESSAGES} SELECT event_id, job_id, stage FROM messages QUALIFY row_number() OVER (PARTITION BY job_id, stage, date_trunc('minute', ts) ORDER BY ts, event_id) = 1")
def job_dedupe(s: SparkSession, d: str) -> DataFrame:
    return jobs.without_redelivery(v.messages(s, d)).select("event_id", "job_id", "stage")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(s: SparkSession, d: str) -> DataFrame:
    w = jobs.windowed(table(s, d, "events"))
    return w.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    r AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM r GROUP BY user_id, run"""
)
def event_sessions(s: SparkSession, d: str) -> DataFrame:
    return jobs.sessions(table(s, d, "events")).withColumn("session_start", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH {v.MESSAGES} SELECT job_id, ['RECEIVED', 'PARSED', 'NORMALIZED', 'EXTRACTED', 'STAGED'][max(place) + 1] AS stage, count(*) AS messages FROM messages GROUP BY job_id")
def stream_job_state(s: SparkSession, d: str) -> DataFrame:
    """The stage machine as a stream over the events file, run to its end; the last state of each job.

    Every batch is one folder of states in the shared folder, so a batch that is run again replaces its own.
    """
    import uuid

    root = f"{shared_folder(s)}/job-state-{uuid.uuid4().hex}"
    raw = s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    kind = F.col("event_type")
    stage = F.when(kind == "signup", "RECEIVED").when(kind == "view", "PARSED").when(kind == "click", "NORMALIZED").when(kind == "purchase", "EXTRACTED").otherwise("STAGED")
    states = jobs.job_states(raw.select("event_id", "ts", F.col("user_id").alias("job_id"), stage.alias("stage")))
    sink = states.writeStream.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{root}/states/batch={number}"))
    sink.option("checkpointLocation", f"{root}/checkpoint").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(states.schema).parquet(f"{root}/states").groupBy("job_id").agg(F.max_by("stage", "messages").alias("stage"), F.max("messages").alias("messages"))
