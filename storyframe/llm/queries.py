"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyframe.llm import decontam, editprint, hmm, linededup, mixing, neardup, passages, tokencount, toxicity, urlfilter
from storyframe.llm import negatives, quality, whitening

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
URL_RULES = [urlfilter.Rule("block", "com", "/en/"), urlfilter.Rule("allow", "example.com", "/en/7"),
             urlfilter.Rule("allow", "net", "/de/"), urlfilter.Rule("block", "example.net", "/de/8"),
             urlfilter.Rule("block", "org", "/es/")]


def query(run: Query) -> Query:
    REGISTRY[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.filter_urls(pages, URL_RULES).drop("url")


@query
def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", "keep")


@query
def op5_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


@query
def op10_line_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.line_tokens(table(spark, sf_dir, "documents"), tokencount.read_vocabulary())


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = toxicity.fold(F.col("doc_id"), 5) == 0
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)


@query
def op9_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = toxicity.fold(F.col("doc_id"), 7) == 2
    return hmm.report(table(spark, sf_dir, "documents"), held_out)


@query
def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.neighbour_report(table(spark, sf_dir, "documents"))


@query
def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = toxicity.fold(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.report(table(spark, sf_dir, "documents"), labels, held_out)


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), F.col("embedding").alias("vector"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)
