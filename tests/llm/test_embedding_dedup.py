"""Embedding near-dedup against all cosines."""
import numpy as np

from fleetscope.llm import embedding_dedup as E


def brute(rows, t=E.COSINE):
    ok = [lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, (_, v, a) in enumerate(rows):
        for j in range(i):
            if ok[i] and ok[j] and a == rows[j][2] and len(v) == len(rows[j][1]):
                x, y = np.array(v, float), np.array(rows[j][1], float)
                if float((x * y).sum()) / (float(np.sqrt((x * x).sum())) * float(np.sqrt((y * y).sum()))) >= t:
                    n[i] += 1
                    n[j] += 1
                    root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted((r[0] is None, r[0] or 0, n[i], None if r[0] is None else low[find(i)]) for i, r in enumerate(rows))


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, node int, v string")
    got = E.near_vectors(df.repartition(4), **options).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_clusters_copies_and_bad_vectors(spark):
    rnd = np.random.default_rng(3)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            base = rnd.normal(size=16)
            for _ in range(rnd.integers(1, 9)):
                v = (base + rnd.normal(size=16) * rnd.choice([0, 0.05, 0.3])) * rnd.choice([1, 1, 7])
                rows.append((int(k * 37 % 1009), np.float32(v).tolist(), label))
                k += 1
    nan, inf = float("nan"), float("inf")
    rows += [(2001, None, 0), (2002, [0.0] * 16, 0), (2003, [nan] * 16, 0), (2004, [inf] + [1.0] * 15, 0), (2005, [None] * 16, 0), (2006, [1.0, 2.0], 0),
             (2007, [1.0, 2.1], 0), (2008, [], 1), (None, rows[0][1], rows[0][2]), (rows[1][0], rows[1][1], rows[1][2]), (2009, [3e38] * 16, 1), (2010, [1e-30] * 16, 1)]
    check(spark, rows)
    check(spark, rows, interval=3, leaf=1, axes=2)


def test_one_large_group_and_empty(spark):
    rnd = np.random.default_rng(4)
    base = rnd.normal(size=8)
    check(spark, [(i, np.float32(base + rnd.normal(size=8) * 0.4).tolist(), 5) for i in range(300)], interval=32, leaf=8)
    schema = "vec_id long, embedding array<float>, label int"
    hot = [(i, np.float32(rnd.normal(size=6)).tolist(), 5 if i % 9 else 6) for i in range(500)]
    hot += [(1000 + i, np.float32(np.array(v) * 2 + rnd.normal(size=6) * 0.1).tolist(), lab) for i, v, lab in hot[:100]]
    check(spark, hot, interval=4, leaf=2, few=8)            # one label on keys of three axes, one on keys of the first
    check(spark, [(i, v[:2], lab) for i, v, lab in hot[:60]], interval=2, leaf=1, few=0)
    assert E.near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = E.near_vectors(spark.createDataFrame([(4, None, 1)], schema)).collect()
    assert [tuple(r) for r in got] == [(4, 0, 4, True)]


def test_whole_table(spark):
    from fleetscope.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op3_embedding_dedup"](spark, sf).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id) for r in got) == brute(rows)
