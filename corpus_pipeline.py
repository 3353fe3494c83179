"""A training corpus from raw documents: quality, repeated lines, near copies, benchmark passages, mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.decontaminate import remove_items
from tidemill.llm.helpers import quoted, table
from tidemill.llm.jaccard import keep_one
from tidemill.llm.line_dedup import dedup_lines
from tidemill.llm.mixing import balanced_copies
from tidemill.llm.quality import keep_good
from tidemill.session import scratch_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of earlier ones; a document that has no text left because of that goes."""
    lines, dropped = "__tm_lines", "__tm_dropped"
    kept = dedup_lines(docs, lines_column=lines, dropped_column=dropped)
    left = (F.col(dropped) == 0) | F.coalesce(F.col("text"), F.lit("")).rlike(r"\S")
    return kept.where(left).select(*[quoted(c) for c in docs.columns])


def single_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return keep_one(docs, width=5, num=8, den=10)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of test items."""
    return remove_items(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document, and how many words that is; documents it never takes go."""
    return balanced_copies(docs).where(F.col("copies") > 0)


STAGES = [
    ("quality", good_documents), ("line_dedup", fresh_lines), ("near_copies", single_copies),
    ("decontamination", without_benchmark), ("mixture", mixture),
]

#: The classifier, the near-copy groups and the balanced sample have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes Parquet to the shared folder, which the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
