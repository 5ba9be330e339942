"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

In every stage null and empty texts, rows without an id, rows that repeat, empty tables and further columns are as its
operator's docstring says; all stages but the last return the columns they got.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import gumbel, mixing, pii, quality_rules, simhash
from siltstone.llm.common import deleted, read, shared_folder

#: Wanted weights of the languages. The total grows until none has to shrink, so the stage repeats documents and loses none.
TARGETS = {"en": 0.6, "fr": 0.15, "de": 0.15, "es": 0.1}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the voted quality rules keep. Short ones go by the votes alone: fewer than 50 words do not make a clean text bad.

    Null and empty texts, and texts without a word, go; rows that repeat stay or go together; an empty table stays empty.
    """
    return quality_rules.keep(docs, min_words=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links connect, sets of 5-word shingles of similarity 0.8 or more, the one with the smallest id.

    Null and empty texts are equal to each other; of rows with equal ids the one with the smallest text stays; of a group
    without ids one row stays; rows without an id leave groups that have ids; an empty table stays empty.
    """
    return simhash.keep_one(docs, shingle_words=5, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted anew.

    Null texts stay null; where spans overlap they become one, named by the first; every row comes out once.
    """
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its rate says, at least once; copies follow each other.

    Null and empty texts have the priors as their domains; without labelled rows, or for an empty table, docs stay as they are.
    """
    return mixing.drawn(docs, read(spark, sf_dir, "labels"), TARGETS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document; copies of a document draw anew.

    Null and empty texts have one segmentation, without pieces; an empty table gives an empty one.
    """
    return gumbel.sample(docs, k=2, number_copies=True)


STAGES = [("quality_rules", quality), ("simhash", near_duplicates), ("pii", personal_data), ("mixing", mix), ("sentencepiece", encode)]

#: SQL can express neither the rules' expectation-maximisation nor the stages that follow.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents in turn. All but the last are written to the shared folder, each of which goes when the next is there, but for the last one's input."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            deleted(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
