"""A training corpus from documents: quality, lines, near duplicates, passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame, written as Parquet and read again as the
next one's documents. All but the last return the columns of documents; a changed text brings its
``n_chars`` along.

Order among equals is by ``doc_id``: the smallest of a group of near duplicates stays, and of
repeated lines and passages the first. A document that loses all its words to ``line_dedup`` is a copy
throughout; it stays there as an empty one, so that the rows are accounted for, and is dropped by
``near_duplicates``. One that ``substring_dedup`` empties is dropped there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm import jaccard, lines, packing, quality, substrings
from signalloom.llm.shared import WORD, Scratch, table, text_or_empty


def _with_words(docs: DataFrame) -> DataFrame:
    """Without the documents that a stage has emptied."""
    return docs.where(text_or_empty().rlike(WORD))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the certified cutoffs."""
    return quality.judged(docs, table(spark, sf_dir, "labels")).where("_kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats go: runs of three lines, and of one or two lines with 13 words or more."""
    return lines.without_repeated_lines(docs, least_words=lines.LEAST_WORDS).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with similarity 0.8 or more.

    Documents without words are copies of nothing that is left, and go. Rows without id are in no
    component and stay; so do all rows of the id that is kept.
    """
    docs = _with_words(docs)
    gone = jaccard.near_duplicates(docs, size=5, least=80, of=100).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 13-word windows that also start in an earlier document go."""
    return _with_words(substrings.without_repeated_words(docs).select(*docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Binomial bounds, near-duplicate components and tokenizers are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.store(docs, name)
    return docs
