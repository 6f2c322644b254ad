"""Queries of the training-data operators: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, decontamination, embedding_dedup, fill_middle, hard_negatives, line_dedup, ngram_join, piece_sampling, pii, repeated_passages,
               toxicity, url_filter, warc)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark, sf_dir):
    return line_dedup.summary(_table(spark, sf_dir, "documents"))


def op2_piece_sampling(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = piece_sampling.encode(docs, check_col="lossless")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "lossless")


def op3_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_decontamination(spark, sf_dir):
    found = decontamination.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), short_items=True)
    return found.select("doc_id", "item_id", "start", "n_words", F.round("similarity", 6).alias("similarity"), "distance")


def op5_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op6_ngram_join(spark, sf_dir):
    return ngram_join.near_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_url_filter(spark, sf_dir):
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op8_pii(spark, sf_dir):
    return pii.digest(pii.find_spans(_table(spark, sf_dir, "documents")))


def op9_repeated_passages(spark, sf_dir):
    rows = repeated_passages.remove_repeats(_table(spark, sf_dir, "documents")).drop("spans")
    return rows.withColumn("has_repeat", F.col("n_removed") > 0)


def op10_warc(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_fill_middle(spark, sf_dir):
    return fill_middle.digests(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    return hard_negatives.mined(_table(spark, sf_dir, "embeddings"))


def op13_byte_bpe(spark, sf_dir):
    return byte_bpe.digests(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_piece_sampling, op3_embedding_dedup, op4_decontamination, op5_toxicity, op6_ngram_join, op7_url_filter, op8_pii, op9_repeated_passages, op10_warc,
                                     op11_fill_middle, op12_hard_negatives, op13_byte_bpe)}
ORACLE = {"op1_line_dedup": line_dedup.oracle_sql(), "op7_url_filter": url_filter.oracle_sql(), "op10_warc": warc.oracle_sql(),
          "op11_fill_middle": fill_middle.oracle_sql(), "op12_hard_negatives": hard_negatives.oracle_sql()}
