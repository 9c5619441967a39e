"""A corpus pipeline of five of the training-data operators.

``run`` applies the stages to the table documents.  Every stage works on all rows that the
stage before it kept, and all but the last return the columns of documents.  Stages' tables
are written to the shared folder; ``shiftscope.llm.common.release`` deletes them once the
result has been written.

Defined results: null and empty texts are scored like any other, are copies of each other, link
with nothing, have no tokens and come out at the rate of their domain; a null id stays unless
its text goes as a copy; rows that repeat id and text are one document after the second stage;
an empty table gives an empty result; extra columns are carried to the fourth stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shiftscope.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from shiftscope.llm.common import new_folder, table

#: Mixing in the pipeline keeps every document: rates are 1 at least, and the total is the
#: least at which no domain has to shrink.
TARGETS = {"quality=1,toxic=0": 0.85, "quality=0,toxic=0": 0.15}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject; a null id is scored like any other."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the rate says that brings its domains to the target weights."""
    return mixing.resample(docs, table(spark, sf_dir, "labels"), TARGETS, total="cover", least=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that came so far."""
    return bpe.encode_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: The toxicity model, the join and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
