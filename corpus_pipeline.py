"""Corpus cleaning pipeline: each stage works on all that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the
columns of ``documents``.  Every stage takes nulls in any column, empty and very long
texts, repeated rows and further columns of any name, and gives an empty table for one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainsignals.llm import common, decontaminate, near_dups, packing, quality, site_lines


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are judged on zero features and their source and language, null
    ones of which form sites of their own; equal rows go or stay together.
    """
    return quality.keep_quality(docs, common.table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on over a tenth of their source's documents, and on five at least, go; n_chars follows the text.

    Null texts stay null, texts of boilerplate alone become empty, a line on exactly a tenth
    stays, repeated rows count as documents of their own, and rows without a source form one.
    """
    cleaned = site_lines.drop_boilerplate(docs, host="source", max_ratio=0.1, min_pages=5)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id (five-word shingles, similarity 0.8).

    Texts without words, null ones too, and rows without an id are no duplicates; rows
    that repeat a kept id stay.
    """
    return near_dups.drop_near_duplicates(docs, shingle=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts and items hold nothing; rows without an id are judged by their
    text; equal rows go or stay together.
    """
    return decontaminate.drop_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents left, with its place in a sequence of 4096 tokens.

    A null or empty text is its end id alone; rows that repeat an id, null ones too, are
    packed each; a text of over 4096 tokens is cut into pieces, no other is.
    """
    return packing.pack_documents(docs, capacity=4096)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: Stages 1 and 3 to 5 can't be said in SQL; tests/llm holds each against a brute-force version, and stage 2 against SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)
