"""Corpus preparation: toxicity, near-duplicates, secrets, mixture, encoding, each stage on what the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes every
stage's result to the shared folder and reads it back as the next one's documents. All stages but the last
return the columns they were given. The mixture takes nine tenths of the tokens and repeats nothing, so that small
sources stay whole and only what is over its weight is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwright.llm.common import materialise, read_table
from driftwright.llm.mixing import select_mixture
from driftwright.llm.near_duplicates import drop_near_duplicates
from driftwright.llm.piece_encoding import encode_documents
from driftwright.llm.secret_scan import redact_documents
from driftwright.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer, trained on the labels that are not held out, puts below one half."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"), training_docs=read_table(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with confirmed secrets replaced in the text."""
    return redact_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A selection within nine tenths of the tokens, by weights of domains, languages and sources."""
    return select_mixture(docs, budget_share=0.9, max_epochs=1)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return encode_documents(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("encoding", encoding)]

#: SQL cannot express the scorer, the forest or the encoder; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
