"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents.  Packing has no SQL
equivalent, nor have the fitted classifier and the edit-distance search, so
ORACLE_SQL is None and the stages are tested against brute-force versions.

All stages take null and empty texts, repeated rows, null ids and empty tables;
what becomes of them is said with each.  Rows that repeat an id and a text
share their fate in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenvec.llm import decontam, linededup, ngramjoin, packing, quality
from lumenvec.llm.common import table
from lumenvec.shared import remove, scratch_scope, shared_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored like others; without labels of both kinds all stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals but for one word go; so do documents left without words by that.

    Ties fall to the least id, then line.  Null and empty texts and rows without an id stay as they are.
    """
    return linededup.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked on five-word shingles at 0.8 stays, the one with the least id.

    Null, empty and wordless texts and rows without an id stay; of rows that repeat the kept id all stay.
    """
    return ngramjoin.keep_one(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to its edits, go.

    Null and empty texts and items hold nothing; an empty benchmark keeps all.
    """
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences; a null or empty text is one piece."""
    return packing.pack(docs, packing.word_bpe_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again before the next.

    What a stage leaves on its way goes once its result is written, and that
    once the next one's is.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{root}/{k}"
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
