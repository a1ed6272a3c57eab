"""Cleaning of the documents table: quality, near duplicates, repeated passages, packing.

Each stage works on all that the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._common import Workspace, table
from corpusloom.llm.near_dedup import keep_one, near_dedup
from corpusloom.llm.packing import pack
from corpusloom.llm.quality import learn, rate
from corpusloom.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Null and empty texts are judged as texts without content."""
    rated = rate(docs, learn(docs, table(spark, sf_dir, "labels")), keep=COLUMNS)
    return rated.where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group. Of exact repeats of a row one stays, and of rows without
    doc_id one of each text that no row with a doc_id has, so that the next stage cuts no text out of all its copies."""
    return keep_one(docs, near_dedup(docs)).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; repeated passages are cut out, with the rest's words joined by one space, others' texts are as they were."""
    cut = substring_dedup(docs, keep=COLUMNS)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of 2048 tokens at most."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", packing)]

#: No SQL: the classifier and the tokenizer can't be expressed in it; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents table, with a table written after each but the last."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work.save(docs)
    return docs
