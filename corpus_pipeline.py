"""From raw documents to token ids: rules, copies, near copies, mixing and encoding, each a stage over all it is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalex.llm.common import Workspace, table
from stratalex.llm.exact_dedup import drop_copies
from stratalex.llm.jaccard_join import one_of_each
from stratalex.llm.mixing import in_order, training_order
from stratalex.llm.quality import keep_good
from stratalex.llm.sentencepiece_codec import encode


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified cutoff go.

    Null and empty texts fail the base; a text of any length is judged whole; repeated rows are judged each; a null
    language is a stratum; an empty table stays empty; without labels only the base rules act.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the longest stays, then the least doc_id.

    Null texts equal empty ones; a null doc_id comes last; of repeated rows one stays; an empty table stays empty.
    """
    return drop_copies(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity 0.75 connect, the least doc_id stays.

    Rows with a null doc_id, null texts and texts without words are linked with nothing and stay; rows that share a
    doc_id stay or go together; an empty table stays empty.
    """
    return one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, in training order: by file number, then by row.

    Null and blank texts have no words and go; a null source is a source; every row has copies of its own, repeated
    ones and those without a doc_id included; an empty table stays empty.
    """
    return training_order(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of every document of the mix, and its place in the training order, from 0.

    A null text has no ids; texts of any length are encoded whole; an empty table gives no rows; further columns of
    ``docs``, whatever their names, are not read.
    """
    return encode(in_order(docs), carried=("place",))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: Near copies and the Viterbi search are not expressible in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again, and its working tables are deleted."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        opened = len(Workspace.opened)
        docs = space.save(stage(spark, docs, sf_dir), name)
        Workspace.close_since(opened)
    return STAGES[-1][1](spark, docs, sf_dir)
