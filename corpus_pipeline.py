"""From raw documents to packed training bins: toxicity, exact and near duplicates, source mix, packing.

Each stage reads what the stage before it has written, and its decisions take
effect: rejected documents and duplicates go, and the mix keeps the documents
that it takes. All but the last return the columns of documents.

Defined results, for all stages: null texts are empty, null ids and sources are
ids and sources; rows are judged each by its own text, whatever other rows hold
their id; of rows equal in id and text one stays; extra columns are carried
along unread, with any names; an empty table passes through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plotweave.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from plotweave.llm.common import remove, scratch, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of these documents, does not reject; empty texts stay."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space the longest row, then the one of the smallest id; all empty texts are equal."""
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 connect; texts without words stay."""
    return near_dedup.drop_near(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to three times, or not at all where its source has too many words."""
    return mixing.take(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of at most 2048 words with its bin; repeats of a document never share a bin."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_bins),
]

#: The classifier has no SQL form; a test holds all stages together against a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of `documents` after all stages; every stage but the last is written and read again.

    Tables that a stage has staged go when it is written, and so does the stage before it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/plotweave/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{i}-{name}")
        if i:
            remove(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
