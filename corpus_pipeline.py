"""The corpus pipeline: quality rules, language, near duplicates, packing.

Each stage gets what its predecessor kept, written as Parquet and read again.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emberfield.llm import best_two_fit, jaccard_tiles, language_backoff, line_crf
from emberfield.session import materialize

#: A document goes when its language is undetermined or barely ahead of the others.
MIN_LANGUAGE_SCORE = 0.4


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the base rule and the line labels accept."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = line_crf.judge(docs, line_crf.fit(docs, labels))
    return judged.where("kept").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language can be told."""
    learned = docs.where(~language_backoff.held_out()).select("doc_id", "text", "lang")
    found = language_backoff.predict(docs, language_backoff.fit(learned))
    return found.where((found.lang_pred != "und") & (found.score >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near duplicates.

    Rows that share that doc_id are all kept, as are rows without a doc_id.
    """
    groups = jaccard_tiles.shingle_components(docs)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the remaining documents into sequences of at most 1024 tokens."""
    return best_two_fit.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end=2)


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", packing),
]

#: The stages train models and encode tokens, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
