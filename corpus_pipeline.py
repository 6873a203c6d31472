"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
and read again before the next one. All but the last keep documents' columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, ngram_join, spm, substring_dedup, toxicity
from larkspur.llm.shared import ready, remove, shared_folder, table


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at or above the threshold go. The model learns from the labelled rows of what it gets."""
    p = toxicity.ToxicityFit()
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), p))
    return scored.filter(F.col("_score") < p.threshold).select(*docs.columns)


def stage_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return ngram_join.one_of_each(docs)


def stage_substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated sentences and passages go from text; n_chars is the new text's length where a text changed."""
    out = substring_dedup.dedup(docs, substring_dedup.WHOLE)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_ranges") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def stage_sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with token_ids and n_tokens."""
    return spm.encode(docs).withColumnRenamed("_ids", "token_ids").withColumn("n_tokens", F.size("token_ids"))


STAGES = [
    ("toxicity", stage_toxicity),
    ("ngram_jaccard_join", stage_ngram_join),
    ("substring_dedup", stage_substring_dedup),
    ("benchmark_decontamination", stage_decontamination),
    ("sentencepiece", stage_sentencepiece),
]

#: The stages hold learned scores and approximate matches: tests/llm checks them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder and read again; a stage's files go when the next one's are written, the last stay for the caller. Nulls and repeated rows pass as the stages' operators say."""
    ready(spark)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    df = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        stage(spark, df, sf_dir).write.parquet(f"{folder}/{n}-{name}")
        df = spark.read.parquet(f"{folder}/{n}-{name}")
        if n:  # the stage before isn't read any more
            remove(spark, f"{folder}/{n - 1}-{STAGES[n - 1][0]}")
    return df
