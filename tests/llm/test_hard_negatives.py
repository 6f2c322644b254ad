"""Hard negatives against all inner products; the intervals really bound; odd rows."""
import math

import numpy as np
import pytest

from fleetscope.llm import hard_negatives as H


def brute(rows, anchor, low=80, k=5):
    """(anchor, positive, rank, negative, scores) from Python integers."""
    good = {}
    for key, label, v in rows:
        if key is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        x = (label, tuple(v))
        good[key] = min(good.get(key, x), x)
    ints = {key: (label, [math.floor(256 * x) for x in v]) for key, (label, v) in good.items()}
    out = set()
    for a, (label, q) in ints.items():
        if not anchor(a):
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), b, other) for b, (other, v) in ints.items() if b != a and len(v) == len(q)]
        scored.sort()
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            hits = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= 100 * -s][:k]
            out |= {(a, p, r + 1, b, -s, -t) for r, (t, b, _) in enumerate(hits)}
    return out


def mined(spark, rows, anchor="id % 3 = 0", columns="vec_id long, embedding array<float>, label int", **kw):
    df = spark.createDataFrame([(a, c, b) for a, b, c in rows], columns).repartition(5)
    return {tuple(r) for r in H.mine(df, __import__("pyspark").sql.functions.expr(anchor), **kw).collect()}


def f32(v):
    return [float(np.float32(x)) for x in v]


def family(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((labels + 2, dim))
    return [(i, int(rng.integers(labels)), f32(centre[rng.integers(labels + 2)] + 0.4 * rng.standard_normal(dim))) for i in range(n)]


@pytest.mark.parametrize("n, dim, labels", [(300, 64, 4), (250, 7, 2), (200, 130, 1), (260, 1, 3)])
def test_equals_all_pairs(spark, n, dim, labels):
    rows = family(n, dim, dim, labels)
    assert mined(spark, rows) == brute(rows, lambda a: a % 3 == 0)


def test_small_blocks_passes_and_a_hot_label(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", 16)
    monkeypatch.setattr(H, "CHUNK", 2)
    rows = [(i, 0 if i % 5 else label, v) for i, label, v in family(240, 16, 9)]
    assert mined(spark, rows) == brute(rows, lambda a: a % 3 == 0)


def test_ties_and_copies(spark):
    rng = np.random.default_rng(2)
    shared = f32(rng.standard_normal(8))
    rows = [(i, i % 2, shared) for i in range(90)] + [(100 + i, i % 3, f32(np.round(rng.standard_normal(8)))) for i in range(60)]
    assert mined(spark, rows) == brute(rows, lambda a: a % 3 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = family(40, 4, 3, 2) + [(50, None, f32([1, 2, 3, 4])), (51, 1, None), (52, 1, [1.0, nan, 0.0, 0.0]), (53, 1, [inf, 0.0, 0.0, 0.0]),
                                  (54, 1, [1.0, None, 0.0, 0.0]), (None, 1, f32([1, 1, 1, 1])), (57, 0, [0.0] * 4), (60, 1, [0.0] * 4), (63, 0, []), (64, 0, []),
                                  (66, 1, []), (69, 1, [1.0, 2.0]), (70, 1, [1.0, 2.0]), (71, 0, [1.0, 1.9]), (3, 0, f32([9, 9, 9, 9])), (3, 0, f32([9, 9, 9, 9]))]
    assert mined(spark, rows) == brute(rows, lambda a: a % 3 == 0)
    assert mined(spark, [], columns="vec_id long, embedding array<float>, label int") == set()
    assert mined(spark, rows, anchor="id > 1000") == set()


def test_scores_beyond_a_long(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, f32(rng.choice([3e15, 2.9e15, 1e3], 3))) for i in range(30)]
    top = 2**63 - 1
    want = {(*r[:4], min(r[4], top), min(r[5], top)) for r in brute(rows, lambda a: a % 3 == 0)}
    assert want and mined(spark, rows) == want


def test_intervals_hold():
    rng = np.random.default_rng(1)
    for dim in (3, 64, 300):
        vectors = np.floor(256 * rng.standard_normal((200, dim)))
        vectors[0] = 0
        rows = H.Block(H._pack([(i, 0, v, []) for i, v in enumerate(vectors)], 7))
        low, high = H.intervals(rows, slice(0, 200), rows, slice(0, 200), 7)
        true = vectors @ vectors.T
        assert (low <= true).all() and (true <= high).all()
        wide = np.linalg.norm(vectors, axis=1)
        assert (high - low)[1:, 1:].mean() < 1.3 * np.outer(wide, wide)[1:, 1:].mean()


def test_whole_table(spark):
    from fleetscope.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding)
            for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op12_hard_negatives"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, lambda a: a % 100 == 0)
