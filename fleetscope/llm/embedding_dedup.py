"""Vectors of equal label whose cosine reaches a threshold: epsilon grid order join.

Unit vectors have cosine >= t exactly if their distance is at most eps = sqrt(2 - 2 t). The vectors are turned to the leading
principal axes (of sums of products over all vectors, a d x d matrix), cut into grid cells of width eps and sorted by label
and cell, first axis first. Consecutive runs of the order are intervals of at most ``interval`` vectors, each with its bounding box.
Two intervals meet only if they share a label and neighbouring cells (an equi-join) and their boxes are no more than eps apart. The
cells are those of the first axis; of a label with more than ``few`` intervals those of the first ``JOINED`` axes, so that the intervals of
one large label spread over many keys. A pair of intervals is joined recursively: halves whose boxes are too far apart are skipped, small ones are
compared by cosine in double precision.

Copies: equal vectors of a label are one node with a weight, so a large group of copies is one row. Links are counted
with weights; of the links of a pair of intervals only a spanning forest leaves the task, never all pairs.

Vectors that are null, of zero length, with null or non-finite components, or without a label link with nothing; a null id
has a null component; vectors of different lengths never link; repeated rows count as vectors of their own; an empty table gives no rows;
extra columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, parts, stage

COSINE, AXES, INTERVAL, LEAF = 0.93, 8, 1024, 64
JOINED, FEW = 3, 64


def usable(vectors: DataFrame, id_col, vec_col, label_col) -> DataFrame:
    """(vec_id, label, v, ok) with double components."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    length = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    ok = F.coalesce(F.col(label_col).isNotNull() & v.isNotNull() & finite & (length > 0) & (length < F.lit(float("inf"))), F.lit(False))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"), ok.alias("ok"))


def _moments(dims: int):
    """Sums of unit vectors and of their products, one row per task."""
    def run(batches):
        n, s, p = 0, np.zeros(dims), np.zeros((dims, dims))
        for batch in batches:
            x = _matrix(batch.column("v"), dims)
            n, s, p = n + len(x), s + x.sum(axis=0), p + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tobytes()], pa.binary()), pa.array([p.tobytes()], pa.binary())],
                                         names=["n", "s", "p"])
    return run


def _raw(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _matrix(column, dims: int) -> np.ndarray:
    x = _raw(column, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(nodes: DataFrame, dims: int, axes: int) -> np.ndarray:
    """The d x axes rotation; what reaches the driver is d^2 numbers per combined part."""
    sums = nodes.select("v").mapInArrow(_moments(dims), "n long, s binary, p binary")

    def add(batches):
        n, s, p = 0, np.zeros(dims), np.zeros((dims, dims))
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("n", "s", "p"))):
                n, s, p = n + r[0], s + np.frombuffer(r[1]), p + np.frombuffer(r[2]).reshape(dims, dims)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tobytes()], pa.binary()), pa.array([p.tobytes()], pa.binary())],
                                         names=["n", "s", "p"])
    rows = sums.coalesce(8).mapInArrow(add, "n long, s binary, p binary").collect()
    n = max(sum(r.n for r in rows), 1)
    mean = sum((np.frombuffer(r.s) for r in rows), np.zeros(dims)) / n
    cov = sum((np.frombuffer(r.p).reshape(dims, dims) for r in rows), np.zeros((dims, dims))) / n - np.outer(mean, mean)
    return np.linalg.eigh(cov)[1][:, ::-1][:, :axes]


def _cells(turn, dims: int, eps: float, k: int):
    def run(batches):
        for b in batches:
            y = _matrix(b.column("v"), dims) @ turn
            c = np.floor(y / eps).astype(np.int32)
            cells = [pa.array(c[:, i]) for i in range(k)]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("label"), b.column("weight"), b.column("v"), *cells],
                                             names=["node", "label", "weight", "v", *[f"c{i}" for i in range(k)]])
    return run


def _intervals(dims: int, interval: int, turn):
    """Runs of the sorted order: (interval id, label, first and last cell, box, nodes, weights, vectors)."""
    schema = pa.schema([("iv", pa.string()), ("label", pa.string()), ("cell_lo", pa.int32()), ("cell_hi", pa.int32()), ("lo", pa.list_(pa.float64())),
                        ("hi", pa.list_(pa.float64())), ("nodes", pa.binary()), ("weights", pa.binary()), ("vectors", pa.binary())])

    def run(batches):
        from pyspark import TaskContext
        task, no, held = TaskContext.get().partitionId(), 0, []

        def close(rows):
            nonlocal no
            node, weight, c0 = (np.array(c) for c in zip(*[r[1:4] for r in rows]))
            x = np.stack([r[4] for r in rows])
            y = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))) @ turn
            no += 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(
                (f"{task}-{no}", rows[0][0], int(c0.min()), int(c0.max()), y.min(axis=0), y.max(axis=0),
                 node.astype(np.int64).tobytes(), weight.astype(np.int64).tobytes(), x.tobytes()), schema)], schema=schema)

        for b in batches:
            x = _raw(b.column("v"), dims)
            for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in ("label", "node", "weight", "c0")))):
                if held and (held[0][0] != row[0] or len(held) >= interval or row[3] > held[0][3] + 1):
                    yield close(held)
                    held = []
                held.append((*row, x[i]))
        if held:
            yield close(held)
    return run


def _gap(a, b) -> float:
    d = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float((d * d).sum())


def _join(dims: int, threshold: float, eps: float, turn, leaf: int):
    """Recursive join of interval pairs: weighted link counts per node and a spanning forest of the links."""
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])
    far = (eps * (1 + 1e-9) + 1e-12) ** 2

    def recurse(u, v, i, j, same, found):
        (xr, xn, xy), (yr, yn, yy) = u, v
        if same and j[0] < i[0]:
            return
        p, q = xy[i[0]:i[1]], yy[j[0]:j[1]]
        if _gap((p.min(axis=0), p.max(axis=0)), (q.min(axis=0), q.max(axis=0))) > far:
            return
        if i[1] - i[0] <= leaf and j[1] - j[0] <= leaf:
            cos = (xr[i[0]:i[1]] @ yr[j[0]:j[1]].T) / (xn[i[0]:i[1], None] * yn[None, j[0]:j[1]])
            hit = cos >= threshold
            close = np.abs(cos - threshold) < 1e-9              # decided by the plain sum of products
            for a, b in zip(*np.nonzero(close)):
                s, t = xr[i[0] + a], yr[j[0] + b]
                hit[a, b] = float((s * t).sum()) / (float(np.sqrt((s * s).sum())) * float(np.sqrt((t * t).sum()))) >= threshold
            a, b = np.nonzero(hit)
            a, b = a + i[0], b + j[0]
            if same:
                a, b = a[a < b], b[a < b]
            if len(a):
                found.append((a, b))
            return
        halves = lambda r: [(r[0], (r[0] + r[1]) // 2), ((r[0] + r[1]) // 2, r[1])] if r[1] - r[0] > leaf else [r]
        for x in halves(i):
            for y in halves(j):
                recurse(u, v, x, y, same, found)

    def load(nodes, weights, vectors):
        x = np.frombuffer(vectors).reshape(-1, dims)
        n = np.sqrt((x * x).sum(axis=1))
        return np.frombuffer(nodes, np.int64), np.frombuffer(weights, np.int64), (x, n, (x / n[:, None]) @ turn)

    def run(batches):
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("iv_a", "iv_b", "nodes_a", "weights_a", "vectors_a",
                                                                "nodes_b", "weights_b", "vectors_b"))):
                same = r[0] == r[1]
                na, wa, u = load(*r[2:5])
                nb, wb, v = (na, wa, u) if same else load(*r[5:8])
                found = []
                recurse(u, v, (0, len(na)), (0, len(nb)), same, found)
                if not found:
                    continue
                a, b = (np.concatenate(c) for c in zip(*found))
                count = [np.bincount(a, wb[b], len(na)).astype(np.int64), np.bincount(b, wa[a], len(nb)).astype(np.int64)]
                ids = np.concatenate([na, nb]) if not same else na
                n = np.concatenate(count) if not same else count[0] + count[1]
                root = np.arange(len(ids))
                x, y = a, b if same else b + len(na)
                while True:                                     # labels of the links' forest
                    low = np.minimum(root[x], root[y])
                    new = root.copy()
                    np.minimum.at(new, root[x], low)
                    np.minimum.at(new, root[y], low)
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                inner = np.flatnonzero(root != np.arange(len(root)))
                some = np.flatnonzero(n)
                kind = np.r_[np.zeros(len(some), np.int32), np.ones(len(inner), np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(np.r_[ids[some], ids[inner]]),
                                                  pa.array(np.r_[n[some], ids[root[inner]]])], schema=schema)
    return run


def _keys(axes: int, eps: float, pad: int) -> list:
    """Per axis, the cells that an interval's box covers (``pad`` more on both sides); 0 on the axes its label does not use."""
    # above eps and the tolerance of the box test, so that near boxes have neighbouring cells; wide enough for at most nine cells an axis
    width = F.lit(max(eps * (1 + 1e-6), 0.25))
    covered = [F.sequence(F.col("cell_lo") - pad, F.col("cell_hi") + pad)]
    for i in range(1, axes):
        low, high = (F.floor(F.element_at(c, i + 1) / width).cast("int") for c in ("lo", "hi"))
        covered.append(F.when(F.col("crowded"), F.sequence(low - pad, high + pad)).otherwise(F.array(F.lit(0))))
    return covered


def _spread(box: DataFrame, axes: int, eps: float, pad: int) -> DataFrame:
    """One row of ``box`` per combination of its cells x0, x1, ..."""
    out = box
    for i, cells in enumerate(_keys(axes, eps, pad)):
        out = out.select("*", F.explode(cells).alias(f"x{i}"))
    return out.select("iv", "label", "lo", "hi", *[f"x{i}" for i in range(axes)])


def near_vectors(vectors: DataFrame, id_col="vec_id", vec_col="embedding", label_col="label", cosine: float = COSINE,
                 axes: int = AXES, interval: int = INTERVAL, leaf: int = LEAF, few: int = FEW) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col, label_col).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    key = ["label", "h1", "h2"]
    good = rows.where("ok")
    classes = stage(good.groupBy(*key).agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first"), F.min("v").alias("v"))
                    .withColumn("node", F.xxhash64(*key)).withColumn("dims", F.size("v")), "vec-classes")
    counts, edges = None, None
    for d in sorted(r.dims for r in classes.select("dims").distinct().collect()):      # lengths of vectors: few
        nodes = classes.where(F.col("dims") == d).select("node", "label", "weight", "v")
        k, eps = min(axes, d), float(np.sqrt(2 - 2 * cosine))
        turn = principal_axes(nodes, d, k)
        order = [f"c{i}" for i in range(k)]
        cell_type = "node long, label string, weight long, v array<double>, " + ", ".join(f"{c} int" for c in order)
        sorted_ = (nodes.mapInArrow(_cells(turn, d, eps, k), cell_type).repartitionByRange(parts(spark), "label", *order, "node")
                   .sortWithinPartitions("label", *order, "node"))
        iv = stage(sorted_.mapInArrow(_intervals(d, interval, turn), "iv string, label string, cell_lo int, cell_hi int, lo array<double>, "
                                      "hi array<double>, nodes binary, weights binary, vectors binary"), f"vec-intervals-{d}")
        held = iv.groupBy("label").agg((F.count(F.lit(1)) > few).alias("crowded"))
        box = iv.select("iv", "label", "cell_lo", "cell_hi", "lo", "hi").join(held, "label")
        used = min(JOINED, k)
        left, right = _spread(box, used, eps, 0).alias("a"), _spread(box, used, eps, 1).alias("b")
        same = F.col("a.label") == F.col("b.label")
        for i in range(used):
            same = same & (F.col(f"a.x{i}") == F.col(f"b.x{i}"))
        gap = F.expr("aggregate(transform(sequence(0, size(a.lo) - 1), i -> greatest(0D, a.lo[i] - b.hi[i], b.lo[i] - a.hi[i])), 0D, (s, x) -> s + x * x)")
        pairs = (left.join(right, same & (F.col("a.iv") <= F.col("b.iv"))
                           & (gap <= (eps * (1 + 1e-9) + 1e-12) ** 2))
                 .select(F.col("a.iv").alias("iv_a"), F.col("b.iv").alias("iv_b")).distinct())
        side = lambda s: iv.select(F.col("iv").alias(f"iv_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("nodes", "weights", "vectors")])
        joined = stage(pairs.join(side("a"), "iv_a").join(side("b"), "iv_b").repartition(parts(spark))
                       .select("iv_a", "iv_b", "nodes_a", "weights_a", "vectors_a", "nodes_b", "weights_b", "vectors_b")
                       .mapInArrow(_join(d, cosine, eps, turn, leaf), "kind int, a long, b long"), f"vec-links-{d}")
        c, e = joined.where("kind = 0").select(F.col("a").alias("node"), F.col("b").alias("n")), joined.where("kind = 1").select("a", "b")
        counts, edges = (c, e) if counts is None else (counts.unionByName(c), edges.unionByName(e))
    if counts is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    comp = stage(components(edges), "vec-components").select(F.col("id").alias("node"), F.col("component_id").alias("group"))
    by_class = (classes.join(counts.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(comp, "node", "left")
                .withColumn("group", F.coalesce("group", "node")))
    least = by_class.groupBy("group").agg(F.min("first").alias("least"))
    told = stage(by_class.join(least, "group").select(*key, (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), "least"), "vec-told")
    out = rows.join(told.withColumn("ok", F.lit(True)), [*key, "ok"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("least", "vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
