"""Boosted trees against plain loops over all rows, features and cuts; partitioning, nulls, saving."""

import tempfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetscope.operators import boosting as BO


def table(spark, n=400, features=3, seed=1, kind="squared", nulls=0.0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, features)), 2)
    signal = 2 * x[:, 0] - (x[:, 1] > 0.3) * x[:, 0] + 0.1 * rng.standard_normal(n)
    y = signal if kind == "squared" else np.digitize(signal, [-1, 1]).astype(float)
    x[rng.random(x.shape) < nulls] = np.nan
    rows = [(f"k{i}", float(y[i]), int(i % 3), *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    names = [f"f{j}" for j in range(features)]
    df = spark.createDataFrame(rows, "key string, y double, fold int, " + ", ".join(f"{c} double" for c in names))
    return df, x, y, names


def plain_tree(bins, g, h, cfg):
    """Best-first (or depth-wise) growth by loops over every feature, cut and side of the nulls."""
    def weight(rows):
        return h[rows].sum() if cfg.second_order else len(rows)

    def score(rows):
        d = weight(rows) + cfg.l2
        return g[rows].sum() ** 2 / d if d > 0 else 0.0

    def best(rows):
        top = None
        for f in range(bins.shape[1]):
            for cut in sorted(set(bins[rows, f]) - {0}):
                for null_left in (False, True) if (bins[rows, f] == 0).any() else (None,):
                    left = (bins[rows, f] <= cut) & (bins[rows, f] > 0) | ((bins[rows, f] == 0) & bool(null_left))
                    a, b = rows[left], rows[~left]
                    if min(len(a), len(b)) < max(cfg.min_leaf, 1) or min(h[a].sum(), h[b].sum()) < cfg.min_hessian:
                        continue
                    gain = score(a) + score(b) - score(rows)
                    if gain > 1e-9 and (top is None or gain > top[0] + 1e-9):
                        top = (gain, f, int(cut), a, b)
        return top
    leaves = [(np.arange(len(g)), 0)]
    done = []
    while leaves and (cfg.max_leaves is None or len(leaves) + len(done) < cfg.max_leaves):
        options = [(best(r) if cfg.max_depth is None or d < cfg.max_depth else None, i) for i, (r, d) in enumerate(leaves)]
        options = [(o, i) for o, i in options if o]
        if not options:
            break
        o, i = max(options, key=lambda x: x[0][0])
        rows, d = leaves.pop(i)
        leaves += [(o[3], d + 1), (o[4], d + 1)]
    out = np.zeros(len(g))
    for rows, _ in leaves:
        out[rows] = g[rows].sum() / (h[rows].sum() + cfg.l2)
    return out


def plain_squared(bins, y, cfg):
    margin = np.full(len(y), y.mean())
    for _ in range(cfg.rounds):
        margin = margin + cfg.rate * plain_tree(bins, y - margin, np.ones(len(y)), cfg)
    return margin


@pytest.mark.parametrize("cfg", [
    BO.BoostConfig(rounds=3, rate=0.1, max_leaves=9, min_leaf=20),
    BO.BoostConfig(rounds=3, rate=0.3, max_depth=3, l2=1.0, min_hessian=5.0, second_order=True),
])
@pytest.mark.parametrize("nulls", [0.0, 0.15])
def test_regressors_equal_plain_loops(spark, cfg, nulls):
    df, x, y, names = table(spark, nulls=nulls)
    model = BO.fit(df.repartition(4), names, "y", cfg, "key").model
    want = plain_squared(BO.binned(x, model.cuts), y, cfg)
    got = {r.key: r.prediction for r in model.transform(df).collect()}
    assert np.allclose([got[f"k{i}"] for i in range(len(y))], want, atol=1e-6)


def test_softmax_equals_plain_loops(spark):
    df, x, y, names = table(spark, n=240, kind="softmax")
    cfg = BO.BoostConfig(objective="softmax", rounds=3, max_depth=3)
    res = BO.fit(df, names, "y", cfg, "key", "fold", 3, 3)
    for run in range(4):
        use = np.arange(240) % 3 != run
        bins, model = BO.binned(x, res.model.cuts), (res.runs + [res.model])[run]
        margin = np.tile(np.log([np.mean(y[use] == k) for k in range(3)]), (240, 1))
        for _ in range(3):
            p = BO.softmax(margin)
            step = np.zeros_like(margin)
            for k in range(3):
                g, h = (y == k) - p[:, k], p[:, k] * (1 - p[:, k])
                leaf = plain_tree_on(bins, g, h, use, cfg)
                step[:, k] = cfg.rate * 2 / 3 * leaf
            margin += step
        assert np.allclose(model.margins(x), margin, atol=1e-5), run
        if run < 3:
            want = np.zeros((3, 3), int)
            np.add.at(want, (y[~use].astype(int), margin[~use].argmax(axis=1)), 1)
            assert (res.held_out[run] == want).all()
    rows = res.model.transform(df).collect()
    assert all(abs(sum(r.probability) - 1) < 1e-9 and r.prediction == np.argmax(r.probability) for r in rows)


def plain_tree_on(bins, g, h, use, cfg):
    """Leaf values (sum of gradients over sum of hessians) of a depth-wise tree grown on ``use``, for all rows."""
    out = np.zeros(len(g))

    def grow(train, rows, depth):
        top = None
        if depth < cfg.max_depth:
            for f in range(bins.shape[1]):
                for cut in sorted(set(bins[train, f])):
                    a, b = train[bins[train, f] <= cut], train[bins[train, f] > cut]
                    if len(a) and len(b):
                        gain = g[a].sum() ** 2 / len(a) + g[b].sum() ** 2 / len(b) - g[train].sum() ** 2 / len(train)
                        if gain > 1e-9 and (top is None or gain > top[0] + 1e-9):
                            top = (gain, f, cut)
        if top is None:
            out[rows] = g[train].sum() / h[train].sum()
            return
        _, f, cut = top
        for side in (True, False):
            grow(train[(bins[train, f] <= cut) == side], rows[(bins[rows, f] <= cut) == side], depth + 1)
    grow(np.flatnonzero(use), np.arange(len(g)), 0)
    return out


@pytest.mark.parametrize("cfg", [BO.BoostConfig(rounds=12, max_leaves=6, subsample=0.7), BO.BoostConfig(objective="softmax", rounds=3, max_depth=4)])
def test_same_model_for_any_partitioning(spark, monkeypatch, cfg):
    """One partition (one job a round) and many partitions (a job a pass, sums shuffled by node) give the same trees."""
    df, _, _, names = table(spark, n=300, kind=cfg.objective, nulls=0.05)
    args = (names, "y", cfg, "key", "fold", 3, 3) if cfg.objective == "softmax" else (names, "y", cfg, "key")
    one = BO.fit(df.coalesce(1), *args).model
    monkeypatch.setattr(BO, "PART_ROWS", 40)
    monkeypatch.setattr(BO, "BLOCK_ROWS", 16)
    many = BO.fit(df.repartition(8), *args).model
    assert one.trees == many.trees and one.cuts == many.cuts


def test_first_second_order_tree_by_hand(spark):
    """x = 1..6 with y = 0, 0, 0, 9, 9, 9: residuals -4.5 and 4.5; lambda 1 gives leaves of -+13.5 / 4 at the cut x <= 3."""
    df = spark.createDataFrame([(str(i), float(i), 0.0 if i <= 3 else 9.0) for i in range(1, 7)], "key string, x double, y double")
    model = BO.fit(df, ["x"], "y", BO.BoostConfig(rounds=1, rate=1.0, max_depth=1, l2=1.0, min_hessian=1.0, second_order=True), "key").model
    tree = model.trees[0][0]
    assert tree.feature == [0, -1, -1] and model.cuts[0][tree.bin[0] - 1] == 3.0
    assert np.allclose(sorted(v for v, f in zip(tree.value, tree.feature) if f < 0), [-13.5 / 4, 13.5 / 4])
    assert abs(tree.gain[0] - 2 * 13.5 ** 2 / 4) < 1e-6


def test_nulls_go_to_the_better_side(spark):
    rows = [(str(i), None if i % 4 == 0 else float(i % 2), 5.0 if i % 4 in (0, 1, 3) else 0.0) for i in range(80)]
    df = spark.createDataFrame(rows, "key string, x double, y double")
    model = BO.fit(df, ["x"], "y", BO.BoostConfig(rounds=1, rate=1.0, max_depth=2), "key").model
    got = {r.key: r.prediction for r in model.transform(df).collect()}
    assert all(abs(got[k] - y) < 1e-6 for k, _, y in rows)


def test_early_stopping_and_saving(spark):
    df, x, _, names = table(spark, n=600)
    cfg = BO.BoostConfig(rounds=60, rate=1.0, max_leaves=20, stop_after=3, stop_rows=100)
    model = BO.fit(df, names, "y", cfg, "key").model
    assert 3 <= len(model.trees) < 60
    path = tempfile.mkdtemp(prefix="fleetscope-boost-") + "/m"
    model.save(spark, path)
    again = BO.BoostedTrees.load(spark, path)
    assert again.trees == model.trees and again.cfg == model.cfg and (again.margins(x) == model.margins(x)).all()
    assert abs(model.featureImportances.sum() - 1) < 1e-9 and model.featureImportances.argmax() == 0


def test_odd_tables(spark):
    schema = "key string, y double, x double"
    cfg = BO.BoostConfig(rounds=2, max_depth=2)
    empty = BO.fit(spark.createDataFrame([], schema), ["x"], "y", cfg, "key").model
    assert empty.trees == [] and empty.margins(np.zeros((2, 1))).tolist() == [[0.0], [0.0]]
    flat = BO.fit(spark.createDataFrame([("a", 3.0, 1.0), ("b", 3.0, None), ("c", None, 1.0)], schema), ["x"], "y", cfg, "key").model
    assert flat.margins(np.array([[np.nan], [2.0]])).tolist() == [[3.0], [3.0]]
    same_x = BO.fit(spark.createDataFrame([("a", 1.0, 7.0), ("b", 3.0, 7.0)], schema), ["x"], "y", cfg, "key").model
    assert np.allclose(same_x.margins(np.array([[7.0]])), 2.0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=40), st.lists(st.floats(-5, 5), min_size=1, max_size=12, unique=True))
def test_bins_follow_the_cuts(values, cuts):
    cuts = sorted(cuts)
    got = BO.binned(np.array(values)[:, None], [cuts])[:, 0]
    for v, b in zip(values, got.tolist()):
        assert all((v <= c) == (b <= i + 1) for i, c in enumerate(cuts))


def test_small_table_takes_no_job_per_round(spark):
    """The runs of a small table are grown side by side in one job, whatever the rounds."""
    df, _, _, names = table(spark, n=200, kind="softmax")
    cfg = BO.BoostConfig(objective="softmax", rounds=30, max_depth=3)
    spark.sparkContext.setJobGroup("small-boost", "small-boost")
    try:
        fit = BO.fit(df, names, "y", cfg, "key", "fold", 3, 3)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [len(m.trees) for m in [*fit.runs, fit.model]] == [30] * 4
    assert sum(int(t.sum()) for t in fit.held_out) == 200
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("small-boost")) < 30
