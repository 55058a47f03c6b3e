"""Corpus pipeline over ``documents``: language ID, line dedup, n-gram Jaccard join, benchmark
decontamination, mixing to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``. Rows without
doc_id pass the stages that compare documents unchanged; rows that share a doc_id become one in
line dedup (the one with the largest text).
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate, language_id, line_align, mixing, ngram_join
from fleetlens.llm.textkit import scratch, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; ``lang`` becomes the one identified."""
    found = language_id.identify(docs, F.col("text"), declared=F.col("lang"), host=F.col("source"))
    return found.where("accepted").withColumn("lang", F.col("language")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without blocks aligned with earlier documents and without short lines that many
    documents hold, as ``op5_line_dedup``; those left without a word go."""
    found = line_align.dedup_lines(docs.select(*COLUMNS), most=line_align.LINE_DOCS)
    return found.where((F.col("n_removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies."""
    docs = docs.select(*COLUMNS)
    copies = ngram_join.near_classes(docs).where("doc_id != component_id").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs.select(*COLUMNS), benchmark)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents once per epoch, with domain, n_tokens and epoch."""
    return mixing.mix(docs.select(*COLUMNS))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", join_near_copies),
    ("decontaminate", remove_benchmark),
    ("mixing", mix_sources),
]

# Patience alignment and the trained language model have no SQL form; the pipeline is tested
# against a plain Python version on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; a stage's working tables are
    deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
