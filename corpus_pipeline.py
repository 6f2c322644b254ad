"""Training-corpus pipeline: drop toxic documents, cut repeated lines, keep one document of each near-duplicate group,
drop documents that hold benchmark passages, and encode the rest as sampled pieces.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table; its rows, written and read again, are the next stage's ``docs``. All stages but
the last return the columns of ``documents``. Rows with null or empty texts and null ids pass all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetscope.llm import decontamination, line_dedup, ngram_join, piece_sampling, toxicity
from fleetscope.llm.common import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove_toxic(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.rewrite(docs)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove(docs, _table(spark, sf_dir, "benchmark"), short_items=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_sampling.encode(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", cut_lines), ("ngram_join", keep_one_of_group),
          ("decontamination", drop_leaks), ("piece_sampling", encode)]

ORACLE_SQL = None          # trained and sampled stages have no SQL; tests compare run() with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
