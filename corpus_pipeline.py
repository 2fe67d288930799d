"""The corpus pipeline: quality rules, line dedup, near-dedup, source mixing and packing, each stage on what the one before kept.

In every stage an empty table gives an empty result, texts are taken whole however long they are, and columns beyond those of
documents are kept under their own names, up to packing, which has columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from streamtable.llm import line_dedup, mixing, packing, quality_rules, simhash
from streamtable.llm.common import stage, work_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy. Null and empty texts have too few words and go; repeated rows are judged alike."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least three of them share, but in the last one; emptied documents go.

    Rows with one id count as one document, and so do all null ids, which come before any other; repeated rows lose the same lines.
    """
    return line_dedup.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by shingles of five words and a similarity of 0.8.

    The smallest id stays, with all of its rows if there are several; null ids and texts without words stay as they are.
    """
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for; repeated documents are repeated rows.

    A null source is a source of its own; rows with one id, or one draw, are taken together; null texts have no words.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences, with their places. A null text is the end id alone; equal rows are packed each."""
    return packing.digest(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("source_mixing", mix), ("packing", pack)]
#: SQL can't express the near-duplicate stage's XXH64 fingerprints or the tokens of the packing stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and reread, so that a lost executor repeats one stage at most."""
    root = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"{root}/{k}-{name}")
    return docs
