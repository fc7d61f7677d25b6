"""The corpus pipeline: toxicity, quality rules, near duplicates, repeated passages, packing.

Each stage takes the documents that the one before it kept and returns a
DataFrame; between stages the rows are written as Parquet and read again. All
stages but the last return the columns that they were given, extra ones
included; an empty table gives an empty result in every stage, and rows with
null ids or texts crash none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import jaccard_join, packing, quality_rules, substring_dedup, toxicity
from textquarry.llm.scratch import Scratch


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not mark (score under 0.5).

    Null and empty texts have the score of a text without features; repeated
    rows share their text's fate.
    """
    return toxicity.keep_civil(docs, _labels(spark, sf_dir))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts fail the base rules; a null language is a
    stratum of its own; repeated rows are judged each by its own text.
    """
    return quality_rules.keep_good(docs, _labels(spark, sf_dir))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Null and empty texts are in no group and stay, as do rows with a null id;
    rows that repeat an id are one document and share its fate.
    """
    return jaccard_join.keep_one(docs)


def cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document with a smaller id has too.

    Null, empty and short texts stay as they are, as do rows with a null id;
    rows that repeat an id take nothing from each other.
    """
    return substring_dedup.cut_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their windows.

    Null and empty texts are one end id; repeated rows are packed each.
    """
    return packing.packed(docs)


STAGES = [("toxicity", civil), ("quality", good), ("near_duplicates", distinct), ("passages", cut), ("packing", pack)]

#: SQL can express neither the classifier nor the differencing; tests compare each stage, and all in a row, with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if i < len(STAGES) - 1:
            rows = scratch.keep(rows)
            scratch.drop(i)  # what the stage before wrote has been read
    return rows
