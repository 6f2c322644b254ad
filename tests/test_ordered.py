"""Chunked scans equal plain whole-key windows, also with one key holding a third of the rows."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetscope.operators.ordered import attach_group_info, ewm, previous_value, running_sum, stage_chunks


def _data(spark, n=3000, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else f"k{rnd.randint(0, 20)}"      # one key with a third of the rows
        rows.append((key, i, rnd.random() * 1000.0, rnd.choice([None, 1.0, 2.0, 3.0]), rnd.randint(0, 3)))
    df = spark.createDataFrame(rows, "k string, id long, ts double, v double, x int")
    return df.withColumn("_chunk", F.floor(F.col("ts") / 50).cast("long"))


def test_previous_value_matches_lag(spark):
    df = stage_chunks(_data(spark), ["k"], ["ts", "id"])
    got = previous_value(df, ["k"], ["ts", "id"], F.struct(F.col("id").alias("id")), "p")
    w = Window.partitionBy("k").orderBy("ts", "id")
    exp = df.withColumn("e", F.lag("id").over(w))
    a = {r["id"]: (r["p"]["id"] if r["p"] else None) for r in got.select("id", "p").collect()}
    b = {r["id"]: r["e"] for r in exp.select("id", "e").collect()}
    assert a == b


def test_previous_non_null_matches_last(spark):
    df = stage_chunks(_data(spark, seed=2), ["k"], ["ts", "id"])
    got = previous_value(df, ["k"], ["ts", "id"], F.col("v"), "p", skip_nulls=True)
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    exp = df.withColumn("e", F.last("v", ignorenulls=True).over(w))
    a = {r["id"]: r["p"] for r in got.select("id", "p").collect()}
    b = {r["id"]: r["e"] for r in exp.select("id", "e").collect()}
    assert a == b


def test_running_sum_matches_cumsum(spark):
    df = stage_chunks(_data(spark, seed=3), ["k"], ["ts", "id"], checkpoint=False)
    got = running_sum(df, ["k"], ["ts", "id"], {"c": F.col("x").cast("long"), "n": F.lit(1)})
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("ec", F.sum("x").over(w)).withColumn("en", F.count(F.lit(1)).over(w))
    a = {r["id"]: (r["c"], r["n"]) for r in got.collect()}
    b = {r["id"]: (r["ec"], r["en"]) for r in exp.collect()}
    assert a == b


def test_attach_group_info(spark):
    df = _data(spark, seed=4).withColumn("g", (F.col("ts") / 300).cast("long"))
    groups = df.groupBy("k", "g").agg(F.count(F.lit(1)).alias("size"), F.min("_chunk").alias("_min_chunk"),
                                      F.max("_chunk").alias("_max_chunk"))
    got = attach_group_info(df, groups, ["k"], "g", ["size"])
    exp = df.withColumn("e", F.count(F.lit(1)).over(Window.partitionBy("k", "g")))
    assert {r["id"]: r["size"] for r in got.collect()} == {r["id"]: r["e"] for r in exp.collect()}


def test_ewm_long_series_matches_sequential(spark):
    # > 7,000 rows for one key, many chunks and 256-row blocks: the closed form
    # would overflow here, the blocked scan must not
    rnd = np.random.default_rng(7)
    n = 9000
    xs = rnd.random(n) * 10 + 0.1
    rows = [("a", i, float(i), float(xs[i])) for i in range(n)] + [("b", n + i, float(i), 1.0 + i % 3) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, id long, ts double, x double")
    df = df.withColumn("_chunk", F.floor(F.col("ts") / 700).cast("long"))
    df = stage_chunks(df, ["k"], ["ts", "id"])
    alpha = 2 / 21
    got = {r["id"]: r["y"] for r in ewm(df, ["k"], ["ts", "id"], "x", alpha, "y").select("id", "y").collect()}
    y = xs[0]
    for i in range(n):
        y = xs[0] if i == 0 else (1 - alpha) * y + alpha * xs[i]
        assert abs(got[i] - y) <= 1e-12 * max(1.0, abs(y)), (i, got[i], y)
    yb = 1.0
    for i in range(50):
        v = 1.0 + i % 3
        yb = v if i == 0 else (1 - alpha) * yb + alpha * v
        assert abs(got[n + i] - yb) < 1e-12


def test_previous_and_running_in_one_pass(spark):
    from fleetscope.operators.ordered import previous_and_running
    df = stage_chunks(_data(spark, seed=5), ["k"], ["ts", "id"])
    got = previous_and_running(df, ["k"], ["ts", "id"], F.struct(F.col("id").alias("id")), "p",
                               {"c": F.col("x").cast("long")})
    w = Window.partitionBy("k").orderBy("ts", "id")
    exp = (df.withColumn("e", F.lag("id").over(w))
             .withColumn("ec", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    a = {r["id"]: (r["p"]["id"] if r["p"] else None, r["c"]) for r in got.collect()}
    b = {r["id"]: (r["e"], r["ec"]) for r in exp.collect()}
    assert a == b


def test_attach_key_info_keeps_rows_and_partitioning(spark):
    from fleetscope.operators.ordered import attach_key_info
    df = stage_chunks(_data(spark, seed=6), ["k"], ["ts", "id"])
    table = spark.createDataFrame([("hot", 1), ("k3", 2)], "k string, label int")
    got = attach_key_info(df, table, ["k"], ["label"])
    rows = got.collect()
    assert len(rows) == df.count()
    assert all(r["label"] == {"hot": 1, "k3": 2}.get(r["k"]) for r in rows)
    # the readings (the scan with id/ts columns) are never below an exchange: only the small
    # (key, chunk, label) table moves
    lines = got._jdf.queryExecution().executedPlan().toString().splitlines()
    for i, line in enumerate(lines):
        if "Exchange" in line:
            below = lines[i + 1:i + 4]
            assert not any("Scan ExistingRDD" in b and "id#" in b for b in below), lines


def _sequential(xs, alpha):
    out, y = [], None
    for v in xs:
        y = v if y is None else (1 - alpha) * y + alpha * v
        out.append(y)
    return out


def test_ewm_any_span_and_sparse_chunks(spark):
    rnd = np.random.default_rng(9)
    n = 10_500
    xs = np.where(np.arange(n) < n // 2, 1.0, 100.0) + rnd.random(n)       # a level step
    rows = [("a", i, float(i), float(xs[i])) for i in range(n)] + [("s", n + i, i * 4000.0, 2.0 + i % 5) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, id long, ts double, x double")
    df = stage_chunks(df.withColumn("_chunk", F.floor(F.col("ts") / 3600).cast("long")), ["k"], ["ts", "id"])
    for span in (1, 2, 20, 200, 1000):
        alpha = 2 / (span + 1)
        got = {r["id"]: r["y"] for r in ewm(df, ["k"], ["ts", "id"], "x", alpha, "y").select("id", "y").collect()}
        want = _sequential(xs, alpha) + _sequential([2.0 + i % 5 for i in range(700)], alpha)
        worst = max(abs(got[i] - w) / max(1.0, abs(w)) for i, w in enumerate(want))
        assert worst <= 1e-12, (span, worst)


def test_exact_quantiles_equal_percentile(spark):
    from fleetscope.operators.quantiles import exact_quantiles
    rnd = np.random.default_rng(11)
    rows = ([("big", float(v)) for v in rnd.lognormal(size=5000)] + [("ties", float(i % 3)) for i in range(700)]
            + [("one", 5.0), ("two", 1.0), ("two", 2.0), ("none", None)])
    df = spark.createDataFrame(rows, "k string, x double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.33, "d": 0.66, "e": 1.0}
    for keys in (["k"], []):
        want = {tuple(r[k] for k in keys): [r[c] for c in probs] for r in df.where("x is not null").groupBy(*keys).agg(
            *[F.percentile("x", F.lit(p)).alias(c) for c, p in probs.items()]).collect()}
        for small in (0, 600, 65_536):              # all keys by ranks, some, none
            got = {tuple(r[k] for k in keys): [r[c] for c in probs]
                   for r in exact_quantiles(df, keys, "x", probs, small_group=small).collect()}
            assert got.keys() == want.keys()
            assert all(abs(a - b) <= 1e-12 * max(1, abs(b)) for k in want for a, b in zip(got[k], want[k]))
        assert exact_quantiles(df.limit(0), keys, "x", probs).count() == 0
