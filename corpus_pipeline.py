"""A corpus pipeline of five stages, each one operator of ``partgraph.llm``.

Every stage takes (spark, docs, sf_dir) and returns what it keeps; all but the
last return the columns of ``docs``. A stage's result is written as Parquet and
read again as the next one's documents; it is deleted when the next is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from partgraph.llm.common import documents, release, shared_folder, table
from partgraph.llm.decontaminate import decontaminate
from partgraph.llm.line_dedup import PASSAGE_WORDS, without_copied_lines
from partgraph.llm.mix import emit, mix
from partgraph.llm.ngram_join import Join, keep_one
from partgraph.llm.quality import keep_good
from partgraph.plans.lineage import discard


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs and of single passages deleted; documents of nothing else go."""
    return without_copied_lines(docs, passage_words=PASSAGE_WORDS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares five-word shingles at a similarity of 0.8 or more."""
    return keep_one(docs, Join(width=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks, numbered in ``copy``."""
    return emit(mix(docs))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

#: The classifier can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs, folder = documents(spark, sf_dir), f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs.write.parquet(f"{folder}/stage{number}.parquet")
            docs = spark.read.parquet(f"{folder}/stage{number}.parquet")
            discard(f"{folder}/stage{number - 1}.parquet", spark)
            release(spark)
    return docs
