"""The operators' queries for the driver: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stored
from .chat import perspectives
from .decontaminate import contaminated
from .filter_audit import filter_audit
from .html_extract import main_texts
from .mixing import mixed
from .near_dedup import near_duplicates
from .private_data import personal_spans, span_digests
from .quality import quality_scores
from .substring_dedup import shared_passages
from .token_counts import context_limits, length_histogram
from .token_output import tokens_written
from .topk import top_k
from .vector_codes import compressed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_limits(stored(length_histogram(table(spark, sf_dir, "documents")), "lengths"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_written(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixed(docs).drop("mix_source")


def op4_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return perspectives(table(spark, sf_dir, "conversations")).withColumn("spans", spans)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(personal_spans(table(spark, sf_dir, "documents")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_token_counts,
        op3_html_extraction,
        op4_bit_sliced_top_k,
        op5_source_mixing,
        op6_token_output,
        op7_minhash_near_dedup,
        op8_decontamination,
        op9_quality_classifier,
        op10_chat_formatting,
        op11_filter_audit,
        op12_private_data,
        op13_vector_codes,
    )
}
