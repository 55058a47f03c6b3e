"""Registered queries of the training-data operators: each applies its operator, with production
parameters, to its whole table. ``ORACLE`` holds the DuckDB text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate, html_extract, language_id, lexical_search, license_scan, line_align
from fleetlens.llm import mixing, ngram_join, quality_model, quality_rules, substring, token_align, token_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths; theirs are source / thousand of the id / id."""
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    return license_scan.scan(_table(spark, sf_dir, "documents"), path, F.col("text"), keep=["doc_id"])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.digest(quality_rules.clean_lines(docs))


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_align.dedup_lines(docs, most=line_align.LINE_DOCS).select("doc_id", "n_lines", "n_removed_lines", "earlier", "text")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.digest(ngram_join.near_classes(_table(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = language_id.identify(docs, F.col("text"), declared=F.col("lang"), host=F.col("source"))
    return found.select("doc_id", "language", "posterior", "text_language", "n_trigrams", "accepted")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(_table(spark, sf_dir, "documents")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.repeated_passages(_table(spark, sf_dir, "documents")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_benchmark(docs, _table(spark, sf_dir, "benchmark")))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.digest(token_align.align(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.digest(token_count.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_model": op4_quality_model,
    "op5_line_dedup": op5_line_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_language_id": op7_language_id,
    "op8_mixing": op8_mixing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_token_align": op11_token_align,
    "op12_lexical_search": op12_lexical_search,
    "op13_token_count": op13_token_count,
}

ORACLE: dict[str, str] = {
    "op3_quality_rules": quality_rules.ORACLE,
    "op6_ngram_join": ngram_join.ORACLE,
    "op8_mixing": mixing.ORACLE,
    "op9_substring_dedup": substring.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
}
