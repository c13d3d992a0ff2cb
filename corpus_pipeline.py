"""The corpus pipeline: from raw documents to token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's documents.  All but the last
return the columns of ``documents``.

A null doc_id counts as no document's id: such rows are filtered by their text
and never by another row.  Null and empty texts are scored as such by the
classifier; empty tables pass through as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm._common import stored
from skyframe.llm.decontaminate import without_contaminated
from skyframe.llm.mixing import in_mix_order
from skyframe.llm.near_dedup import without_near_duplicates
from skyframe.llm.quality import accepted
from skyframe.llm.token_output import tokens_written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 of five-word shingles)."""
    return without_near_duplicates(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order in which the target weights interleave their sources."""
    return in_mix_order(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ORC, in the mixture's order; a row per document from what was read back.

    The mixing stage's range partitions are files numbered in their order, each
    sorted, so a row's file name and number in it are its place in the mixture,
    in whatever order the files are read.
    """
    return tokens_written(docs, order=(F.col("_metadata.file_name"), F.col("_metadata.row_index")))


STAGES = [("quality classifier", classify), ("MinHash near-dedup", deduplicate), ("benchmark decontamination", decontaminate), ("mixing sources", mix), ("token output", tokenise)]

#: SQL can't express the classifier; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
