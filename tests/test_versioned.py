"""Versioned tables: updates write touched buckets only, appear at once or not at all, and never change what a reader opened."""

import tempfile

import pytest
from pyspark.sql import functions as F

from fleetscope.plans.reports import publish
from fleetscope.sources import versioned as V


def table(spark, n=200, buckets=8):
    df = spark.range(n).select("id", F.concat(F.lit("V"), (F.col("id") % 10).cast("string")).alias("ident"), F.lit("old").alias("style"))
    return V.VersionedTable.create(df, tempfile.mkdtemp(prefix="fleetscope-table-") + "/t", "ident", buckets)


def rows(t):
    return {r.id: r.style for r in t.read().collect()}


def test_update_by_bucket_key_writes_touched_buckets_only(spark):
    t = table(spark)
    up = spark.createDataFrame([("V3", "new"), ("V99", "unknown"), (None, "none")], "ident string, style string")
    after = t.update(up, "ident", ["style"])
    assert after.version == 2 and rows(after) == {i: "new" if i % 10 == 3 else "old" for i in range(200)}
    touched = {str(r.b) for r in up.where("ident is not null").select(t._bucket().alias("b")).collect()}
    assert {b for b, p in after.manifest["buckets"].items() if t.manifest["buckets"][b] != p} == touched & set(t.manifest["buckets"])
    assert 0 < len(touched) < len(t.manifest["buckets"])
    assert set(rows(t).values()) == {"old"} and rows(V.VersionedTable.open(spark, t.root, 1)) == rows(t)
    assert V.VersionedTable.open(spark, t.root).version == 2


def test_update_by_another_key_and_a_new_column(spark):
    t = table(spark)
    up = spark.createDataFrame([(7, 70), (7, 50), (900, 1)], "id long, limit int")
    after = t.update(up, "id", ["limit"])
    got = {r.id: r.limit for r in after.read().collect()}
    assert len(got) == 200 and got[7] == 70 and {v for k, v in got.items() if k != 7} == {None}
    assert after.read().columns == ["id", "ident", "style", "limit"]


def test_a_task_that_fails_before_the_swap_changes_nothing(spark):
    t = table(spark)
    bad = spark.createDataFrame([("V3", "new")], "ident string, style string").select("ident", F.expr("if(style = 'new', raise_error('lost'), style)").alias("style"))
    with pytest.raises(Exception, match="lost"):
        t.update(bad, "ident", ["style"])
    assert V.VersionedTable.open(spark, t.root).version == 1 and set(rows(V.VersionedTable.open(spark, t.root)).values()) == {"old"}
    assert t.update(spark.createDataFrame([("V3", "new")], "ident string, style string"), "ident", ["style"]).version == 2


def test_two_writers_of_one_version(spark):
    t = table(spark)
    up = spark.createDataFrame([("V1", "a")], "ident string, style string")
    t.update(up, "ident", ["style"])
    with pytest.raises(V.VersionConflict):
        t.update(up.withColumn("style", F.lit("b")), "ident", ["style"])
    assert set(rows(V.VersionedTable.open(spark, t.root)).values()) == {"old", "a"}


def test_empty_updates_and_tables(spark):
    t = table(spark)
    none = spark.createDataFrame([], "ident string, style string")
    assert rows(t.update(none, "ident", ["style"])) == rows(t)
    empty = V.VersionedTable.create(none, tempfile.mkdtemp(prefix="fleetscope-table-") + "/t", "ident")
    assert empty.read().count() == 0 and empty.update(none, "ident", ["style"]).version == 2
    with pytest.raises(LookupError):
        V.VersionedTable.open(spark, tempfile.mkdtemp(prefix="fleetscope-table-") + "/nothing")


def test_hot_key_is_spread_over_files(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("ident"))
    t = V.VersionedTable.create(df.withColumn("style", F.lit("x")), tempfile.mkdtemp(prefix="fleetscope-table-") + "/t", "ident", 4)
    assert t.read().count() == 30_000 and t.update(df.limit(0).withColumn("style", F.lit("y")), "ident", ["style"]).read().count() == 30_000


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_report_sinks(spark, fmt):
    root = tempfile.mkdtemp(prefix="fleetscope-reports-")
    one, two = spark.createDataFrame([("a", 1)], "name string, n int"), spark.createDataFrame([("a", 2), ("b", 3)], "name string, n int")
    assert publish({"r": one}, root, fmt) == {"r": 1} and publish({"r": two, "s": one}, root, fmt) == {"r": 2, "s": 1}
    assert sorted(map(tuple, V.VersionedTable.open(spark, f"{root}/r").read().collect())) == [("a", 2), ("b", 3)]
    assert [tuple(r) for r in V.VersionedTable.open(spark, f"{root}/r", 1).read().collect()] == [("a", 1)]
