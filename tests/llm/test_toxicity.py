"""Classifier chain: held-out accuracy, planted words, edge cases."""
from pyspark.sql import functions as F

from fleetscope.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def test_held_out(spark):
    sf = SF.replace("0.01", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    chain = T.train(docs, fit)
    assert chain["f1"] >= 0.88, chain["f1"]
    got = T.score(docs, chain).join(held.select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    right = sum((r.toxic and r.y == 1) or (not r.toxic and r.y == 0) for r in got)
    missed, toxic = sum(r.y == 1 and not r.toxic for r in got), sum(r.y for r in got)
    assert right >= 0.97 * len(got) and missed <= 0.2 * toxic, (right, missed, toxic, len(got))
    clean = T.remove_toxic(docs, chain)
    assert clean.columns == docs.columns and 0.8 * toxic < docs.count() - clean.count() < 10 * toxic


def test_edges(spark):
    schema = "doc_id long, text string, quality string, f int"
    docs = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 2), (None, "fine words", "x", 3), (3, "you idiot", "x", 4), (3, "you idiot", "x", 4)], schema)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.toxic for r in T.score(docs, T.train(docs, none)).collect()] == [False] * 5
    one = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (1, 1, None), (None, 1, 1)], none.schema)
    chain = T.train(docs, one)
    assert chain["rows"] == 1 and T.remove_toxic(docs, chain).count() == 5
    assert T.score(docs.limit(0), chain).count() == 0


def test_fit_bound(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert T.train(docs, labels, max_fit_rows=50)["rows"] == 50
