"""Forests grown on tables: purity, limits, a plain tree by loops, importances, odd tables."""

import numpy as np

from fleetscope.operators import forest as FO


def table(spark, n=300, seed=5):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, 3)), 3)
    y = np.where(x[:, 0] > 0.2, 3.0, -1.0) + 0.5 * x[:, 1] + 0.05 * rng.standard_normal(n)
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(3), x, y


def plain(x, y, cfg, depth=0):
    """Predictions of one tree on its own rows, by loops over every feature and value."""
    best = None
    if len(y) >= cfg.min_split and (cfg.max_depth is None or depth < cfg.max_depth):
        for f in range(x.shape[1]):
            for cut in sorted(set(x[:, f]))[:-1]:
                left = x[:, f] <= cut
                if min(left.sum(), (~left).sum()) < cfg.min_leaf:
                    continue
                gain = y[left].sum() ** 2 / left.sum() + y[~left].sum() ** 2 / (~left).sum() - y.sum() ** 2 / len(y)
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, left)
    if best is None:
        return np.full(len(y), y.mean())
    out = np.empty(len(y))
    for side in (best[1], ~best[1]):
        out[side] = plain(x[side], y[side], cfg, depth + 1)
    return out


def test_one_tree_equals_plain_loops(spark):
    df, x, y = table(spark, n=120)
    for cfg in (FO.ForestConfig(1, max_depth=3, bootstrap=False), FO.ForestConfig(1, min_split=20, min_leaf=4, bootstrap=False)):
        forest = FO.grow(df, ["a", "b", "c"], "y", "id", cfg)
        got = {r.id: r.prediction for r in forest.transform(df, "id").collect()}
        assert np.allclose([got[i] for i in range(120)], plain(x, y - y.mean(), cfg) + y.mean(), atol=1e-6)


def test_child_names_agree(spark):
    rows = spark.range(-50, 50).selectExpr("id * 92233720368547758L as node", "xxhash64(id * 92233720368547758L, 1) a", "xxhash64(id * 92233720368547758L, 0) b").collect()
    assert all((FO._spark_hash(r.node, 1), FO._spark_hash(r.node, 0)) == (r.a, r.b) for r in rows)


def test_small_nodes_in_tasks_equal_levels_on_tables(spark, monkeypatch):
    df, _, _ = table(spark, n=200)
    got = []
    for alone in (0, 30, 10_000):
        monkeypatch.setattr(FO, "ALONE", alone)
        forest = FO.grow(df, ["a", "b", "c"], "y", "id", FO.ForestConfig(3, min_split=4))
        nodes = [(level, r.tree, r.node, r.f, r.bin) for level in range(forest.levels) for r in forest.nodes(spark, level).collect()]
        got.append((sorted(nodes, key=str), sorted(r.prediction for r in forest.transform(df, "id").collect())))
    assert got[0] == got[1] == got[2]


def test_grows_to_purity(spark):
    df, _, y = table(spark)
    forest = FO.grow(df, ["a", "b", "c"], "y", "id", FO.ForestConfig(3, bootstrap=False))
    rows = forest.transform(df, "id").collect()
    assert all(abs(r.prediction - r.y) < 1e-6 for r in rows) and forest.levels > 6


def test_bootstrap_forest_fits_and_ranks_features(spark):
    df, _, y = table(spark)
    train, test = df.where("id % 5 > 0"), df.where("id % 5 = 0")
    forest = FO.grow(train, ["a", "b", "c"], "y", "id", FO.ForestConfig(20))
    rows = forest.transform(test, "id").collect()
    error = np.mean([(r.prediction - r.y) ** 2 for r in rows])
    assert len(rows) == test.count() and error < 0.1 * np.var(y)
    shares = {r.feature: r.importance for r in forest.importances(spark).collect()}
    assert shares["a"] > shares["b"] > shares["c"] and abs(sum(shares.values()) - 1) < 1e-9
    again = FO.Forest.from_values(forest.to_values())
    assert sorted(r.prediction for r in again.transform(test, "id").collect()) == sorted(r.prediction for r in rows)


def test_classifier_with_weights_and_drawn_features(spark):
    rows = [(i, float(i % 3) + 0.1 * (i % 7), float(i % 5), float(i % 3), 1.0 + i % 2) for i in range(210)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double, w double")
    forest = FO.grow(df, ["a", "b"], "y", "id", FO.ForestConfig(8, max_depth=12, min_split=5, min_leaf=2, per_node=1), classes=3, weight="w")
    got = forest.transform(df, "id").collect()
    assert np.mean([r.prediction == r.y for r in got]) > 0.95 and all(abs(sum(r.probability) - 1) < 1e-9 for r in got) and forest.levels <= 13


def test_odd_tables(spark):
    schema = "id long, a double, y double"
    empty = FO.grow(spark.createDataFrame([], schema), ["a"], "y", "id", FO.ForestConfig(2))
    df = spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 1.0), (3, 2.0, 5.0), (4, 2.0, None), (None, 2.0, 5.0)], schema)
    assert [r.prediction for r in empty.transform(df, "id").collect()] == [None] * 5
    forest = FO.grow(df, ["a"], "y", "id", FO.ForestConfig(2, bootstrap=False))
    got = sorted(((r.id or 0), round(r.prediction, 6)) for r in forest.transform(df, "id").collect())
    assert got == [(0, 5.0), (1, 1.0), (2, 1.0), (3, 5.0), (4, 5.0)]


def test_large_node_is_finished_by_one_task(spark):
    """a tree to purity over more than 8,192 rows needs no level on tables; its leaves hold every value."""
    df = spark.range(12_000).selectExpr("id", "CAST(id % 200 AS DOUBLE) a", "CAST(id DIV 200 AS DOUBLE) b", "CAST(id * 7919 % 12000 AS DOUBLE) y")
    forest = FO.grow(df, ["a", "b"], "y", "id", FO.ForestConfig(1, bootstrap=False))
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{forest.path}/best")
    assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    assert spark.read.parquet(f"{forest.path}/nodes").where("f is null").count() == 12_000
    names = np.random.default_rng(1).integers(-2**62, 2**62, 500)
    assert all((FO._children(names, s) == [FO._spark_hash(int(v), s) for v in names]).all() for s in (0, 1))
