"""Registered queries of the training-data operators and, where SQL expresses them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_groups
from .jaccard_join import jaccard_components
from .line_dedup import LEAST as COMMON, drop_common_lines
from .mixing import mix
from .paragraph_dedup import repeated_paragraphs
from .quality import FEATURES, LEVEL, RISK, RULES, quality
from .secret_scan import secret_digest
from .sentencepiece_codec import encode
from .sharding import shard_by_bytes
from .suffix_dedup import repeated_passages
from .token_alignment import token_alignment
from .token_counts import token_counts
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, vector_codes


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents")).withColumnRenamed("group", "source")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *FEATURES[:5], "base_failed", "kept", *FEATURES[5:])


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 6).alias("position")).orderBy("position", "doc_id")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    spans = F.concat_ws(",", F.transform("spans", lambda x: F.concat_ws("-", x["begin"].cast("string"), x["end"].cast("string"))))
    others = F.concat_ws(",", F.transform("others", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words_repeated", spans.alias("spans"), F.least("doc_id", F.element_at("others", 1)).alias("class_id"), F.size("others").cast("long").alias("n_others"), others.alias("others"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("_id", "_row")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = drop_common_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_quality_rules, op3_source_mixing, op4_sentencepiece, op5_paragraph_dedup, op6_secret_scan, op7_suffix_dedup, op8_exact_dedup, op9_jaccard_join, op10_sharding, op11_line_dedup, op12_vector_codes, op13_token_alignment)}

_WORDS = r"words AS (SELECT doc_id, lang, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(text, '') AS text FROM documents)"
_FLAT = "flat AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM words)"


def _quality_oracle() -> str:
    """The features by windows over words and lines, and each cutoff's binomial tail by log-gamma."""
    tries = ", ".join(f"('{rule}', {i}, {float(c)})" for rule, (_, cutoffs) in RULES.items() for i, c in enumerate(cutoffs))
    rates = " ".join(f"WHEN '{rule}' THEN {rate}" for rule, (rate, _) in RULES.items())
    p = RISK / len(RULES)
    over = " OR ".join(f"coalesce({rate} > (SELECT min(cutoff) FROM certified c WHERE c.lang IS NOT DISTINCT FROM j.lang AND rule = '{rule}'), false)" for rule, (rate, _) in RULES.items())
    return rf"""WITH {_WORDS}, {_FLAT},
    tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, b, c) AS n FROM (SELECT doc_id, i, x, lead(x) OVER o AS b, lead(x, 2) OVER o AS c FROM flat WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE c IS NOT NULL),
    rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM tri, (SELECT unnest(range(3)) AS k) WHERE n > 1 GROUP BY doc_id),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words), dup AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS d FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    scored AS (SELECT w.doc_id, lang, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.d, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
      CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_shouts, coalesce(dup.n, 0) AS n_lines FROM words w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN dup ON dup.doc_id = w.doc_id),
    judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM scored),
    held AS (SELECT DISTINCT ON (lang, text) * FROM judged WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
    counted AS (SELECT lang, rule, place, cutoff, count(*) AS n, count(*) FILTER ((CASE rule {rates} END) > cutoff) AS k FROM held, (VALUES {tries}) t(rule, place, cutoff) GROUP BY ALL),
    tail AS (SELECT lang, rule, place, cutoff, CASE WHEN k >= n * {p} THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))) FROM (SELECT unnest(range(k + 1)) AS i)) END AS p FROM counted),
    passed AS (SELECT lang, rule, cutoff, min(CASE WHEN p <= {LEVEL} / (SELECT {len(RULES)} * count(DISTINCT coalesce(lang, chr(0))) FROM held) THEN 1 ELSE 0 END) OVER (PARTITION BY lang, rule ORDER BY place) AS ok FROM tail),
    certified AS (SELECT lang, rule, min(cutoff) AS cutoff FROM passed WHERE ok = 1 GROUP BY ALL)
    SELECT doc_id, {", ".join(FEATURES[:5])}, base_failed, NOT base_failed AND NOT ({over}) AS kept, {", ".join(FEATURES[5:])} FROM judged j"""


def _vector_oracle() -> str:
    """Every part against every entry of its position, round by round, in integers."""
    rounds = ""
    for i in range(ROUNDS + 1):
        rounds += f"""far{i} AS (SELECT v.vec_id, v.p, e.entry, CAST(sum((v.x - e.x) * (v.x - e.x)) AS BIGINT) AS d FROM flat v JOIN book{i} e ON e.p = v.p AND e.j = v.j GROUP BY ALL),
    near{i} AS (SELECT vec_id, p, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM far{i} GROUP BY ALL),
    """
        if i < ROUNDS:
            rounds += f"""mean{i} AS (SELECT n.p, n.entry, v.j, CAST(floor(sum(v.x)::DOUBLE / count(*)) AS BIGINT) AS x FROM near{i} n JOIN flat v ON v.vec_id = n.vec_id AND v.p = n.p GROUP BY ALL),
    book{i + 1} AS (SELECT b.p, b.entry, b.j, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN mean{i} m ON m.p = b.p AND m.entry = b.entry AND m.j = b.j),
    """
    return f"""WITH kept AS (SELECT vec_id, label, embedding AS e, row_number() OVER (ORDER BY vec_id) - 1 AS rank FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    flat AS (SELECT vec_id, rank, i // (n // {PARTS}) AS p, i % (n // {PARTS}) AS j, CAST(floor({SCALE}::DOUBLE * e[i + 1]) AS BIGINT) AS x FROM (SELECT *, len(e) AS n, unnest(range(len(e))) AS i FROM kept)),
    book0 AS (SELECT p, rank AS entry, j, x FROM flat WHERE rank < {ENTRIES}),
    {rounds}coded AS (SELECT vec_id, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY vec_id)
    SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, entry, j)) FROM book{ROUNDS}) AS codebooks_sha256 FROM coded c JOIN kept k ON k.vec_id = c.vec_id"""


ORACLES = {
    "op2_quality_rules": _quality_oracle(),
    "op3_source_mixing": rf"""WITH {_WORDS}, sized AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR) || ':mix') AS mark FROM words),
    src AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source), w AS (SELECT *, [5.0, 2.0, 1.0][CAST(rank % 3 AS INTEGER) + 1] AS weight, 3.0 * source_size AS cap FROM src),
    s AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS left_, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open_ FROM w WINDOW o AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT *, cap * open_ <= left_ * weight AS stopped FROM s), u AS (SELECT *, CASE WHEN stopped THEN cap ELSE CAST(weight AS DOUBLE) * (sum(source_size) OVER () - sum(CASE WHEN stopped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER () END AS target FROM t),
    placed AS (SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target, rank, CAST(sum(size) OVER (PARTITION BY z.source ORDER BY mark, doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start FROM sized z JOIN u ON z.source IS NOT DISTINCT FROM u.source),
    took AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS passes FROM placed),
    v AS (SELECT *, CAST(passes * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - passes * source_size - start)) AS BIGINT) AS taken FROM took), y AS (SELECT *, CASE WHEN taken > 0 THEN least(1.0, CAST(start AS DOUBLE) / target) END AS y FROM v)
    SELECT doc_id, size, source_size, round(target, 6) AS target, taken, round(CASE rank % 3 WHEN 0 THEN 2 * y / (1.5 + sqrt(2.25 - 2 * y)) WHEN 1 THEN y
      ELSE CASE WHEN y < 0.25 / 0.875 THEN 0.875 * y / 0.5 ELSE 0.5 + 2 * (y - 0.25 / 0.875) / (0.5 / 0.875 + sqrt(0.25 / 0.765625 + 2 * (3 / 0.875) * (y - 0.25 / 0.875))) END END, 6) AS position FROM y""",
    "op7_suffix_dedup": rf"""WITH {_WORDS}, runs AS (SELECT doc_id, i - 1 AS place, md5(array_to_string(w[i:i + 49], ' ')) AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
    stars AS (SELECT run, min(doc_id) AS low, max(doc_id) AS high FROM runs GROUP BY run HAVING min(doc_id) < max(doc_id)), m AS (SELECT DISTINCT doc_id, place, CASE WHEN doc_id = low THEN high ELSE low END AS other FROM runs JOIN stars USING (run)),
    p AS (SELECT doc_id, place, CASE WHEN place > lag(place) OVER (PARTITION BY doc_id ORDER BY place) + 50 THEN 1 ELSE 0 END AS new FROM (SELECT DISTINCT doc_id, place FROM m)), q AS (SELECT doc_id, place, sum(new) OVER (PARTITION BY doc_id ORDER BY place) AS island FROM p),
    s AS (SELECT doc_id, min(place) AS a, max(place) + 50 AS b FROM q GROUP BY doc_id, island), t AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_words_repeated, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM s GROUP BY doc_id),
    o AS (SELECT doc_id, min(least(doc_id, other)) AS class_id, count(DISTINCT other) AS n_others, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) AS others FROM (SELECT DISTINCT doc_id, other FROM m) GROUP BY doc_id) SELECT t.*, class_id, n_others, others FROM t JOIN o USING (doc_id)""",
    "op8_exact_dedup": r"""WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size, doc_id = first_value(doc_id) OVER w AS kept, sha256(bare) AS text_sha256 FROM n WINDOW w AS (PARTITION BY bare ORDER BY c DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "op9_jaccard_join": rf"""WITH RECURSIVE low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM low WHERE len(w) > 0)), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * pairs.n >= 75 * (x.n + y.n - pairs.n)), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON reach.r = ways.a)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) m ON m.doc_id = d.doc_id""",
    "op11_line_dedup": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l), common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= {COMMON})
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.key IS NULL), '')) AS kept_sha256 FROM k LEFT JOIN common c ON c.key = k.key GROUP BY r""",
    "op12_vector_codes": _vector_oracle(),
}
